"""Row states and versions as hidden columns; every transition is a projection or a filter.

``__rid`` is the order of insertion, ``__state`` one of ADDED, MODIFIED, DELETED, UNCHANGED, ``__orig`` the values before
the first change, ``__prop`` the values of an edit in progress (null outside one).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import types as tags
from tabulon.errors import ColumnNotFoundError, InvalidRowStateError, ReadOnlyColumnError, SchemaMismatchError, TypeMismatchError

if TYPE_CHECKING:
    from tabulon.table import Table

RID, STATE, ORIGINAL, PROPOSED = "__rid", "__state", "__orig", "__prop"
ADDED, MODIFIED, DELETED, UNCHANGED, DETACHED = "ADDED", "MODIFIED", "DELETED", "UNCHANGED", "DETACHED"
CHANGED = (ADDED, MODIFIED, DELETED)


def is_changed(state: str) -> bool:
    return state.upper() in CHANGED


def is_unchanged(state: str) -> bool:
    return state.upper() == UNCHANGED


def is_detached(state: str) -> bool:
    return state.upper() == DETACHED


def names(table: Table) -> list[str]:
    return [c.name for c in table.schema.stored]


def current(table: Table) -> Column:
    return F.struct(*[F.col(f"`{n}`") for n in names(table)])


def struct_type(table: Table) -> T.StructType:
    kinds = {f.name: f.dataType for f in table.df.schema.fields}
    return T.StructType([T.StructField(n, kinds[n]) for n in names(table)])


def track(table: Table) -> Table:
    """Adds the hidden columns; the row id is given right after the scan and keeps the order of a local table."""
    if table.tracked:
        return table
    df = table.df if RID in table.df.columns else table.df.withColumn(RID, F.monotonically_increasing_id())
    df = df.withColumn(STATE, F.lit(UNCHANGED)).withColumn(ORIGINAL, current(table)).withColumn(PROPOSED, F.lit(None).cast(struct_type(table)))
    return table.over(df.select(*names(table), RID, STATE, ORIGINAL, PROPOSED), tracked=True)


def add_to_versions(df: DataFrame, name: str, kind: T.DataType) -> DataFrame:
    df = df.withColumn(ORIGINAL, F.col(ORIGINAL).withField(name, F.col(name)))
    return df.withColumn(PROPOSED, F.when(F.col(PROPOSED).isNotNull(), F.col(PROPOSED).withField(name, F.lit(None).cast(kind))))


def cast_column(df: DataFrame, name: str, kind: T.DataType, tracked: bool) -> DataFrame:
    df = df.withColumn(name, F.col(f"`{name}`").try_cast(kind))
    if tracked:
        for version in (ORIGINAL, PROPOSED):
            df = df.withColumn(version, F.when(F.col(version).isNotNull(), F.col(version).withField(name, F.col(version).getField(name).try_cast(kind))))
    return df


def value_column(table: Table, name: str, value: object) -> Column:
    """What ``update`` puts into a column: a constant, a Column, or a function of the row."""
    spec = table.schema[name]
    if isinstance(value, Column):
        return value.cast(spec.data_type)
    if callable(value):
        found = value(table.accessor())
        return (found if isinstance(found, Column) else F.lit(found)).cast(spec.data_type)
    if isinstance(spec.data_type, (T.StructType, T.MapType, T.ArrayType)):
        return F.lit(value).cast(spec.data_type) if value is None else F.from_json(F.lit(__import__("json").dumps(value)), spec.data_type)
    found = tags.convert(value, spec.tag)
    if isinstance(found, str) and spec.max_length is not None and len(found) > spec.max_length:
        raise TypeMismatchError(f"{name!r} holds at most {spec.max_length} characters")
    return F.lit(found).cast(spec.data_type)


def _checked(table: Table, values: Mapping[str, object]) -> dict[str, object]:
    out = {}
    for name, value in values.items():
        spec = table.schema[name]
        if spec.computed or spec.read_only:
            raise ReadOnlyColumnError(f"column {spec.name!r} is {'computed' if spec.computed else 'read-only'}")
        if value is None and not spec.allow_null:
            from tabulon.errors import ConstraintViolationError

            raise ConstraintViolationError(f"column {spec.name!r} takes no null")
        out[spec.name] = value
    return out


def _where(table: Table, where: object) -> Column:
    return F.coalesce(table.condition(where), F.lit(False))


def update(table: Table, where: object, values: Mapping[str, object], validate: bool = True) -> Table:
    """Sets columns of the rows that a filter matches. Equal values change nothing; an unchanged row that changes becomes
    MODIFIED and remembers its values. Deleted rows may not be matched."""
    from tabulon.operators import constraints

    table = track(table)
    found = _checked(table, values)
    hit = _where(table, where)
    if validate and table.df.where(hit & (F.col(STATE) == DELETED)).limit(1).take(1):
        raise InvalidRowStateError("a deleted row cannot be changed")
    hit = hit & (F.col(STATE) != DELETED)
    new = {n: value_column(table, n, v) for n, v in found.items()}
    differs = reduce(lambda a, b: a | b, [~F.col(f"`{n}`").eqNullSafe(c) for n, c in new.items()], F.lit(False))
    changed = hit & differs
    table.emit("rowsChanging", lambda: table.over(table.df.where(changed)).frame())
    for name in new:
        table.emit("columnChanging", lambda n=name: (n, table.over(table.df.where(changed)).frame()))
    columns = [F.when(hit, new[n]).otherwise(F.col(f"`{n}`")).alias(n) if n in new else F.col(f"`{n}`") for n in names(table)]
    first = changed & (F.col(STATE) == UNCHANGED)
    out = table.over(
        table.df.select(
            *columns, RID, F.when(first, MODIFIED).otherwise(F.col(STATE)).alias(STATE), F.when(first, current(table)).otherwise(F.col(ORIGINAL)).alias(ORIGINAL), PROPOSED
        )
    )
    if validate:
        constraints.validate(out, only=list(new))
    for name in new:
        out.emit("columnChanged", lambda n=name: (n, out.get_changes(MODIFIED).frame()))
    out.emit("rowsChanged", lambda: out.get_changes(MODIFIED).frame())
    return out


def delete(table: Table, where: object) -> Table:
    """Marks rows DELETED; they leave keys and aggregates but can be rejected back."""
    table = track(table)
    hit = _where(table, where) & (F.col(STATE) != DELETED)
    table.emit("rowsDeleting", lambda: table.over(table.df.where(hit)).frame())
    # a new row that is deleted remembers that it was new: its original is null
    original = F.when(hit & (F.col(STATE) == ADDED), F.lit(None)).when(hit & (F.col(STATE) == UNCHANGED), current(table)).otherwise(F.col(ORIGINAL))
    out = table.over(table.df.withColumn(ORIGINAL, original).withColumn(STATE, F.when(hit, DELETED).otherwise(F.col(STATE))))
    out.emit("rowsDeleted", lambda: out.rows_by_state(DELETED).frame())
    return out


def frame_of(table: Table, rows: Iterable[object] | DataFrame, fill_defaults: bool = True) -> DataFrame:
    """Rows (mappings, sequences by position, Row objects, or a DataFrame) in the stored columns' types, with defaults."""
    stored = table.schema.stored
    if isinstance(rows, DataFrame):
        known = {}
        for c in rows.columns:
            spec = table.schema.find(c)
            if spec is None or spec.computed:
                raise ColumnNotFoundError(c, table.name)
            known[spec.name] = c
        return rows.select(*[F.col(f"`{known[c.name]}`").cast(c.data_type).alias(c.name) if c.name in known else F.lit(c.default_value()).cast(c.data_type).alias(c.name) for c in stored])
    out = []
    for row in rows:
        if hasattr(row, "asDict"):
            row = row.asDict()
        if not isinstance(row, Mapping):
            row = {c.name: v for c, v in zip(stored, row, strict=False)}  # type: ignore[call-overload]
        own = {}
        for key, value in row.items():
            spec = table.schema[key]
            if spec.computed:
                raise ReadOnlyColumnError(f"column {spec.name!r} is computed")
            own[spec.name] = value
        out.append(tuple(tags.convert(own[c.name] if c.name in own else c.default_value() if fill_defaults else None, tags.of_spark(c.data_type) if c.tag not in ("json", "any") else c.tag) for c in stored))
    return table.spark.createDataFrame(out, T.StructType([T.StructField(c.name, c.data_type) for c in stored]))


def next_id(table: Table) -> Column:
    """Row ids after all of a table's: the number of rows so far shifts the new ones."""
    top = table.df.agg(F.coalesce(F.max(RID), F.lit(-1))).first()[0]
    return F.lit(top + 1) + F.monotonically_increasing_id()


def add_rows(table: Table, rows: Iterable[object] | DataFrame, validate: bool = True, state: str = ADDED) -> Table:
    from tabulon.operators import constraints

    table = track(table)
    new = frame_of(table, rows)
    table.emit("rowsAdding", new)
    prepared = new.withColumn(RID, next_id(table)).withColumn(STATE, F.lit(state.upper())).withColumn(ORIGINAL, current(table)).withColumn(PROPOSED, F.lit(None).cast(struct_type(table)))
    out = table.over(table.df.unionByName(prepared))
    if validate:
        constraints.validate(out)
    out.emit("rowsAdded", new)
    return out


# -- edits ---------------------------------------------------------------------------------------------------------------


def begin_edit(table: Table, where: object, values: Mapping[str, object]) -> Table:
    """Opens an edit on the matching rows; their proposed values are the current ones with ``values`` put in."""
    table = track(table)
    found = _checked(table, values)
    hit = _where(table, where)
    if table.df.where(hit & (F.col(STATE) == DELETED)).limit(1).take(1):
        raise InvalidRowStateError("a deleted row cannot be edited")
    base = F.coalesce(F.col(PROPOSED), current(table))
    proposed = F.struct(*[(value_column(table, n, found[n]) if n in found else base.getField(n)).alias(n) for n in names(table)])
    return table.over(table.df.withColumn(PROPOSED, F.when(hit, proposed).otherwise(F.col(PROPOSED))))


def end_edit(table: Table, where: object = None, validate: bool = True) -> Table:
    """Commits open edits; a row becomes MODIFIED only if something changed."""
    from tabulon.operators import constraints

    table = track(table)
    hit = _where(table, where) & F.col(PROPOSED).isNotNull()
    changed = hit & ~F.col(PROPOSED).eqNullSafe(current(table))
    first = changed & (F.col(STATE) == UNCHANGED)
    columns = [F.when(hit, F.col(PROPOSED).getField(n)).otherwise(F.col(f"`{n}`")).alias(n) for n in names(table)]
    out = table.over(
        table.df.select(
            *columns, RID, F.when(first, MODIFIED).otherwise(F.col(STATE)).alias(STATE), F.when(first, current(table)).otherwise(F.col(ORIGINAL)).alias(ORIGINAL),
            F.when(hit, F.lit(None)).otherwise(F.col(PROPOSED)).alias(PROPOSED),
        )
    )
    if validate:
        constraints.validate(out)
    out.emit("rowsChanged", lambda: out.get_changes(MODIFIED).frame())
    return out


def cancel_edit(table: Table, where: object = None) -> Table:
    table = track(table)
    return table.over(table.df.withColumn(PROPOSED, F.when(_where(table, where), F.lit(None)).otherwise(F.col(PROPOSED))))


# -- accepting and rejecting ---------------------------------------------------------------------------------------------


def accept(table: Table, where: object = None) -> Table:
    """Deleted rows go, the others are UNCHANGED with their values as originals."""
    if not table.tracked:
        return table
    hit = _where(table, where)
    rows = table.df.where(~(hit & (F.col(STATE) == DELETED)))
    return table.over(rows.withColumn(ORIGINAL, F.when(hit, current(table)).otherwise(F.col(ORIGINAL))).withColumn(STATE, F.when(hit, UNCHANGED).otherwise(F.col(STATE))))


def reject(table: Table, where: object = None) -> Table:
    """Added rows go (also those deleted since), modified and deleted ones get their originals back."""
    if not table.tracked:
        return table
    hit = _where(table, where)
    new = (F.col(STATE) == ADDED) | (F.col(STATE) == DELETED) & F.col(ORIGINAL).isNull()
    rows = table.df.where(~(hit & new))
    back = hit & F.col(STATE).isin(MODIFIED, DELETED)
    columns = [F.when(back, F.col(ORIGINAL).getField(n)).otherwise(F.col(f"`{n}`")).alias(n) for n in names(table)]
    return table.over(rows.select(*columns, RID, F.when(back, UNCHANGED).otherwise(F.col(STATE)).alias(STATE), ORIGINAL, F.when(hit, F.lit(None)).otherwise(F.col(PROPOSED)).alias(PROPOSED)))


def clear_changes(table: Table) -> Table:
    if not table.tracked:
        return table
    kept = F.col(STATE) != DELETED
    return table.over(table.df.withColumn(ORIGINAL, F.when(kept, current(table)).otherwise(F.col(ORIGINAL))).withColumn(STATE, F.when(kept, UNCHANGED).otherwise(F.col(STATE))))


def summary(table: Table) -> dict:
    counts = {r[STATE]: r["n"] for r in track(table).df.groupBy(STATE).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {f"{s.lower()}Count": counts.get(s, 0) for s in (ADDED, MODIFIED, DELETED, UNCHANGED)}
    return {"totalRows": sum(counts.values()), **found, "hasChanges": any(counts.get(s) for s in CHANGED), **{f"{s.lower()}Rows": table.get_changes(s).frame for s in CHANGED}}


# -- change sets ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChangeSet:
    """Changes of a table as one DataFrame: state, key, original_key, values, original, changed_columns."""

    table_name: str
    primary_key: tuple[str, ...]
    df: DataFrame

    def _of(self, state: str) -> DataFrame:
        return self.df.where(F.col("state") == state)

    @property
    def added(self) -> DataFrame:
        return self._of(ADDED)

    @property
    def modified(self) -> DataFrame:
        return self._of(MODIFIED)

    @property
    def deleted(self) -> DataFrame:
        return self._of(DELETED)

    def count(self) -> int:
        return self.df.count()

    def has_changes(self) -> bool:
        return bool(self.df.limit(1).take(1))

    def is_empty(self) -> bool:
        return not self.has_changes()

    def to_object(self) -> dict:
        rows = [r.asDict(recursive=True) for r in self.df.orderBy(RID).collect()]
        part = lambda s: [{"state": s, "tableName": self.table_name, "key": r["key"], "originalKey": r["original_key"], "values": r["values"], "originalValues": r["original"], "changedColumns": r["changed_columns"]} for r in rows if r["state"] == s]
        out = {"added": part(ADDED), "modified": part(MODIFIED), "deleted": part(DELETED)}
        return {"tableName": self.table_name, "primaryKey": list(self.primary_key), **out, "count": len(rows), "hasChanges": bool(rows)}

    to_json = to_object


def change_set(table: Table, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> ChangeSet:
    """Keys ignore the column filters; a deleted row's key is its original one."""
    table = track(table)
    wanted = {table.schema[n].name for n in include} if include is not None else set(names(table))
    wanted -= {table.schema[n].name for n in exclude or ()}
    shown = [n for n in names(table) if n in wanted]
    if not shown:
        raise SchemaMismatchError("a change set needs a column")
    original = F.coalesce(F.col(ORIGINAL), current(table))
    key = table.schema.primary_key
    now = F.struct(*[F.col(f"`{n}`") for n in key]) if key else F.lit(None).cast("struct<none: string>")
    before = F.struct(*[original.getField(n).alias(n) for n in key]) if key else now
    differs = F.filter(F.array(*[F.when(~F.col(f"`{n}`").eqNullSafe(original.getField(n)), F.lit(n)) for n in shown]), lambda x: x.isNotNull())
    state = F.col(STATE)
    df = table.df.where(state.isin(*CHANGED)).select(
        RID, state.alias("state"), F.when(state == DELETED, before).otherwise(now).alias("key"), F.when(state == ADDED, F.lit(None)).otherwise(before).alias("original_key"),
        F.struct(*[F.col(f"`{n}`") for n in shown]).alias("values"), F.when(state == ADDED, F.lit(None)).otherwise(F.struct(*[original.getField(n).alias(n) for n in shown])).alias("original"),
        F.when(state == MODIFIED, differs).otherwise(F.array().cast("array<string>")).alias("changed_columns"),
    )
    return ChangeSet(table.name, key, df)


def commands(table: Table) -> dict[str, DataFrame]:
    """What a writer has to insert, update and delete, as three DataFrames."""
    changes = table.get_change_set()
    return {
        "inserts": changes.added.select("key", "values"),
        "updates": changes.modified.select(F.col("original_key").alias("key"), "values", "changed_columns"),
        "deletes": changes.deleted.select("key"),
    }
