"""Table: an immutable, lazy, typed relation over a DataFrame, with optional change tracking.

A table holds a DataFrame of its stored columns, and a schema. Computed columns are added when rows are read. Tracking adds
hidden columns (row id, state, original values, proposed values) at the first mutation only, so plain scans keep pruning and
pushdown. Every operator returns a new table or a DataFrame; nothing runs before an action. Names are snake_case; their
camelCase forms are accepted too.
"""

from __future__ import annotations

import asyncio
import inspect
import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import schema as schemas
from tabulon import types as tags
from tabulon.errors import ColumnNotFoundError, ConstraintViolationError, SchemaMismatchError
from tabulon.functions import criteria as criteria_
from tabulon.functions import expressions as expr
from tabulon.functions.expressions import Typed
from tabulon.operators import constraints, merge, relational, tracking
from tabulon.operators.tracking import ORIGINAL, PROPOSED, RID, STATE
from tabulon.schema import ColumnSpec, TableSchema

HIDDEN = (RID, STATE, ORIGINAL, PROPOSED)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


class Accessor:
    """A row as seen by a function: ``row.name`` or ``row["name"]`` is that column."""

    def __init__(self, resolve: Callable[[str], Typed]):
        self._resolve = resolve

    def __getitem__(self, name: str) -> Column:
        return self._resolve(name).column

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._resolve(name).column


class PythonRow:
    """A row as seen by a function that runs in Python: values by name, in any case."""

    def __init__(self, row: Row):
        self._values = {n.lower(): v for n, v in zip(row.__fields__, row, strict=True)}

    def __getitem__(self, name: str) -> object:
        return self._values[name.lower()]

    def get(self, name: str) -> object:
        return self._values[name.lower()]

    def __getattr__(self, name: str) -> object:
        if name.startswith("__") or name.lower() not in self._values:
            raise AttributeError(name)
        return self._values[name.lower()]


#: What Python raises when a function of a row does with a Column what only a value can do.
_NO_COLUMN = (PySparkException, TypeError, AttributeError)


class Table:
    def __init__(self, df: DataFrame, schema: TableSchema, tracked: bool = False):
        self.df, self.schema, self.tracked = df, schema, tracked

    # -- making --------------------------------------------------------------------------------------------------------

    @staticmethod
    def from_df(df: DataFrame, name: str = "Table", primary_key: object = None, case_sensitive: bool = False) -> Table:
        """Over any DataFrame (a Parquet, CSV, JSON or JDBC scan); no job runs."""
        columns = tuple(ColumnSpec(f.name, f.dataType, tags.of_spark(f.dataType), f.nullable) for f in df.schema.fields)
        schema = TableSchema(name, columns, case_sensitive=case_sensitive)
        return Table(df, schema.with_primary_key(primary_key) if primary_key else schema)  # type: ignore[arg-type]

    @staticmethod
    def read(spark: SparkSession, path: str, name: str | None = None, format: str = "parquet", primary_key: object = None, **options: object) -> Table:  # noqa: A002
        return Table.from_df(spark.read.format(format).options(**options).load(path), name or re.sub(r"\.\w+$", "", path.rstrip("/").rsplit("/", 1)[-1]), primary_key)

    @staticmethod
    def read_jdbc(spark: SparkSession, name: str, primary_key: object = None, **options: object) -> Table:
        return Table.from_df(spark.read.format("jdbc").options(**options).load(), name, primary_key)

    @staticmethod
    def from_objects(spark: SparkSession, records: Iterable[object], **options: object) -> Table:
        from tabulon.sources import loader

        return loader.from_objects(spark, records, **options)

    from_rows = from_records = from_objects

    @staticmethod
    def from_query_result(spark: SparkSession, result: object, **options: object) -> Table:
        from tabulon.sources import loader

        return loader.from_query_result(spark, result, **options)

    @staticmethod
    def empty(spark: SparkSession, name: str = "Table", columns: Sequence[ColumnSpec] = (), primary_key: object = None, case_sensitive: bool = False) -> Table:
        schema = TableSchema(name, tuple(columns), case_sensitive=case_sensitive)
        struct = T.StructType([T.StructField(c.name, c.data_type) for c in schema.stored])
        table = Table(spark.createDataFrame([], struct), schema)
        return table.set_primary_key(primary_key, validate=False) if primary_key else table

    @staticmethod
    def import_schema(spark: SparkSession, schema: Mapping | str) -> Table:
        found = TableSchema.from_json(schema) if isinstance(schema, str) else TableSchema.from_dict(schema)
        struct = T.StructType([T.StructField(c.name, c.data_type) for c in found.stored])
        return Table(spark.createDataFrame([], struct), found)

    deserialize_schema = import_schema

    def over(self, df: DataFrame, schema: TableSchema | None = None, tracked: bool | None = None) -> Table:
        return Table(df, schema or self.schema, self.tracked if tracked is None else tracked)

    # -- schema --------------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def name(self) -> str:
        return self.schema.name

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def renamed(self, name: str) -> Table:
        return self.over(self.df, replace(self.schema, name=name))

    def column(self, name: str | int) -> ColumnSpec:
        return self.schema[name]

    def column_exists(self, name: str) -> bool:
        return self.schema.find(name) is not None

    has_column = column_exists

    def add_column(self, name: str, data_type: object = None, **options: object) -> Table:
        """Existing rows get the default; a column with an expression is computed when rows are read."""
        spec = schemas.column(name, data_type, **options)  # type: ignore[arg-type]
        key = options.get("primary_key") or options.get("primaryKey") or options.get("isPrimaryKey")
        schema = self.schema.with_column(spec)
        df = self.df
        if spec.computed:
            if spec.tag == "any":
                kind = Table(df, schema, self.tracked).frame().schema[name].dataType
                schema = replace(self.schema, columns=(*self.schema.columns, replace(spec, data_type=kind, tag=tags.of_spark(kind))))
            else:
                Table(df, schema, self.tracked).resolve(name)  # an unknown name raises here
        else:
            value = spec.default_value()
            filled = (value if isinstance(value, Column) else F.lit(tags.convert(value, spec.tag) if value is not None else None)).cast(spec.data_type)
            df = df.withColumn(name, filled)
            if self.tracked:
                df = tracking.add_to_versions(df, name, spec.data_type)
                df = df.select(*[c for c in df.columns if c not in HIDDEN], *HIDDEN)
        out = self.over(df, schema)
        out.emit("columnAdded", name)
        return out.set_primary_key([*self.schema.primary_key, name]) if key else out

    def remove_column(self, name: str) -> Table:
        spec = self.schema[name]
        schema = self.schema.without(name)
        df = self.df
        if not spec.computed:
            df = df.drop(spec.name)
            if self.tracked:
                df = df.withColumn(ORIGINAL, F.col(ORIGINAL).dropFields(spec.name)).withColumn(PROPOSED, F.col(PROPOSED).dropFields(spec.name))
        out = self.over(df, schema)
        out.emit("columnRemoved", spec.name)
        return out

    def set_primary_key(self, names: object, validate: bool = True) -> Table:
        out = self.over(self.df, self.schema.with_primary_key(names))  # type: ignore[arg-type]
        return out.validate() if validate else out

    def get_primary_key(self) -> list[str]:
        return list(self.schema.primary_key)

    def clear_primary_key(self) -> Table:
        return self.over(self.df, self.schema.without_primary_key())

    def set_case_sensitive(self, on: bool) -> Table:
        return self.over(self.df, replace(self.schema, case_sensitive=on))

    def export_schema(self) -> dict:
        return self.schema.to_dict()

    get_schema = export_schema

    def serialize_schema(self) -> str:
        return self.schema.to_json()

    def compare_schema(self, other: Table) -> dict:
        return self.schema.compare(other.schema)

    def update_schema(self, source: Table, add_missing: bool = True, remove_extra: bool = False) -> Table:
        """This table in the shape of ``source``: missing columns added, extra ones removed, types cast."""
        out, difference = self, self.compare_schema(source)
        for name in difference["missingColumns"] if add_missing else ():
            spec = source.schema[name]
            out = out.add_column(name, spec.data_type, default=spec.default, expression=spec.expression, caption=spec.caption)
        for name in difference["extraColumns"] if remove_extra else ():
            out = out.remove_column(name)
        for found in difference["typeMismatches"]:
            mine, theirs = out.schema[found["columnName"]], source.schema[found["columnName"]]
            if not mine.computed:
                columns = tuple(replace(c, data_type=theirs.data_type, tag=theirs.tag) if c is mine else c for c in out.schema.columns)
                out = out.over(tracking.cast_column(out.df, mine.name, theirs.data_type, out.tracked), replace(out.schema, columns=columns))
        return out

    # -- names in expressions ------------------------------------------------------------------------------------------

    def resolve(self, path: str, prefix: str = "", version: str = "current", seen: tuple[str, ...] = ()) -> Typed:
        """A column by its case-folded name, a nested field by a dotted path, or a member of the row: ``rowState``,
        ``originalValues.x``, ``proposedValues.x``, ``currentValues.x``."""
        spec = self.schema.find(path)
        if spec is not None:
            return self._of(spec, prefix, version, seen)
        head, _, rest = path.partition(".")
        member = snake(head)
        if member == "row_state" and not rest:
            return Typed(F.col(f"{prefix}{STATE}") if self.tracked else F.lit("UNCHANGED"), "string")
        if member in ("original_values", "proposed_values", "current_values") and rest:
            return self.resolve(rest, prefix, member.split("_")[0], seen)
        if rest and (spec := self.schema.find(head)) is not None:
            return self._nested(self._of(spec, prefix, version, seen).column, spec.data_type, rest.split("."))
        raise ColumnNotFoundError(path, self.name)

    def _of(self, spec: ColumnSpec, prefix: str, version: str, seen: tuple[str, ...]) -> Typed:
        if spec.computed:
            if spec.name in seen:
                raise SchemaMismatchError(f"computed columns in a circle: {' > '.join((*seen, spec.name))}")
            inner = lambda p: self.resolve(p, prefix, version, (*seen, spec.name))
            if callable(spec.expression):
                try:
                    column = spec.expression(Accessor(inner))
                except _NO_COLUMN:
                    if spec.tag == "any":
                        raise SchemaMismatchError(f"computed column {spec.name!r}: give a type, as its function is no column expression") from None
                    column = self.in_python(spec.expression, spec.data_type, lambda v: v, prefix)
                column = column if isinstance(column, Column) else F.lit(column)
                return Typed(column if spec.tag == "any" else column.cast(spec.data_type), expr.kind_of(spec.data_type) if spec.tag != "any" else "other")
            found = expr.compile_value(str(spec.expression), inner)
            if spec.tag == "any":
                return found
            return Typed(found.column.cast(spec.data_type), expr.kind_of(spec.data_type))
        kind = expr.kind_of(spec.data_type)
        if version == "original" and self.tracked:
            return Typed(F.when(F.col(f"{prefix}{STATE}").isin("MODIFIED", "DELETED"), F.col(f"{prefix}{ORIGINAL}").getField(spec.name)).otherwise(F.col(f"{prefix}`{spec.name}`")), kind)
        if version == "proposed" and self.tracked:
            return Typed(F.col(f"{prefix}{PROPOSED}").getField(spec.name), kind)
        return Typed(F.col(f"{prefix}`{spec.name}`"), kind)

    def _nested(self, column: Column, kind: T.DataType, parts: list[str]) -> Typed:
        for place, part in enumerate(parts):
            if isinstance(kind, T.StructType):
                found = next((f for f in kind.fields if self.schema.fold(f.name) == self.schema.fold(part)), None)
                if found is None:
                    return Typed(F.lit(None), "null")
                column, kind = column.getField(found.name), found.dataType
            elif isinstance(kind, T.MapType):
                column, kind = column.getItem(part), kind.valueType
            elif isinstance(kind, T.VariantType):
                return Typed(F.variant_get(column, "$." + ".".join(parts[place:]), "string"), "string")
            elif isinstance(kind, T.StringType):  # JSON text
                return Typed(F.get_json_object(column, "$." + ".".join(parts[place:])), "string")
            else:
                return Typed(F.lit(None), "null")
        return Typed(column, expr.kind_of(kind))

    def accessor(self, prefix: str = "") -> Accessor:
        return Accessor(lambda path: self.resolve(path, prefix))

    def condition(self, where: object) -> Column:
        """A Column from a filter: an expression, a criteria object, a function of a row, or a Column."""
        if where is None:
            return F.lit(True)
        if isinstance(where, Column):
            return where
        if isinstance(where, str):
            return expr.compile_condition(where, self.resolve) if where.strip() else F.lit(True)
        if isinstance(where, Mapping):
            return criteria_.criteria(where, self.resolve)
        if callable(where):
            try:
                found = where(self.accessor())
            except _NO_COLUMN:
                return self.in_python(where, T.BooleanType())
            return found if isinstance(found, Column) else F.lit(bool(found))
        raise SchemaMismatchError(f"no filter: {where!r}")

    def in_python(self, function: Callable, kind: T.DataType, convert: Callable = bool, prefix: str = "", columns: Sequence[str] | None = None) -> Column:
        """The slow path, for functions that are no Column expression (``and``, ``len``, ``in``): values go to Python by Arrow
        batches, row by row. Nothing is pushed down."""
        names = columns if columns is not None else [c.name for c in self.schema.stored]
        whole = F.struct(*[F.col(f"{prefix}`{n}`").alias(n) for n in names])
        return F.udf(lambda row: None if (found := function(PythonRow(row))) is None else convert(found), kind, useArrow=True)(whole)

    # -- reading -------------------------------------------------------------------------------------------------------

    def live(self) -> Table:
        """Without deleted rows."""
        return self.over(self.df.where(F.col(STATE) != "DELETED")) if self.tracked else self

    def order_columns(self) -> list[Column]:
        """The order rows were added in, where the table knows it; else the primary key's."""
        if RID in self.df.columns:
            return [F.col(RID)]
        return [F.col(f"`{k}`") for k in self.schema.primary_key]

    def ordered(self) -> Table:
        order = self.order_columns()
        return self.over(self.df.orderBy(*order)) if order else self

    def stored_frame(self) -> DataFrame:
        return self.df.select(*[F.col(f"`{c.name}`") for c in self.schema.stored])

    def frame(self, where: object = None, hidden: bool = False) -> DataFrame:
        """The rows as a DataFrame with computed columns; ``hidden`` keeps the tracking columns."""
        rows = self.df if where is None else self.df.where(self.condition(where))
        columns = [self.resolve(c.name).column.alias(c.name) if c.computed else F.col(f"`{c.name}`") for c in self.schema.columns]
        return rows.select(*columns, *[c for c in rows.columns if hidden and c in HIDDEN])

    def where(self, where: object) -> Table:
        return self.over(self.df.where(self.condition(where)))

    def select(self, where: object = None, sort: object = None) -> Table:
        return self.select_rows(where, sort)

    def select_rows(self, where: object = None, sort: object = None, state: str | None = None) -> Table:
        """Filtered and sorted; deleted rows are seen unless a state is asked for."""
        from tabulon.view import View

        found = self.where(where) if where is not None else self
        if state is not None:
            found = found.rows_by_state(state)
        return View(found).set_sort(sort).table() if sort is not None else found

    def find_rows(self, where: object) -> Table:
        return self.where(where)

    def find_one(self, where: object) -> Row | None:
        return self.where(where).ordered().frame().limit(1).first()

    def find(self, key: object) -> Row | None:
        """The row with a primary key that is not deleted; a composite key as a list or mapping."""
        rows = self.at_key(key)
        return None if rows is None else rows.live().frame().limit(1).first()

    find_by_primary_key = find

    def at_key(self, key: object) -> Table | None:
        names = self.schema.primary_key
        if not names:
            raise SchemaMismatchError(f"table {self.name!r} has no primary key")
        if isinstance(key, Mapping):
            folded = {self.schema.fold(k): v for k, v in key.items()}
            values = [folded.get(self.schema.fold(n)) for n in names]
        else:
            values = list(key) if isinstance(key, (list, tuple)) else [key]
        if len(values) != len(names):
            raise SchemaMismatchError(f"the primary key of {self.name!r} has {len(names)} columns")
        if any(v is None for v in values):
            return None
        return self.where({n: v for n, v in zip(names, values, strict=True)})

    def rows(self, i: int | None = None):
        """All rows in order, or the i-th one."""
        frame = self.ordered().frame()
        return frame.collect() if i is None else (frame.offset(i).limit(1).first())

    def count(self) -> int:
        return self.df.count()

    count_rows = count

    def __iter__(self) -> Iterator[Row]:
        return self.ordered().frame().toLocalIterator()

    # -- relational operators ------------------------------------------------------------------------------------------

    def compute(self, expression: str, where: object = None) -> object:
        return relational.compute(self, expression, where)

    def group_by(self, keys: object, aggregations: Mapping | None = None) -> DataFrame:
        return relational.group_by(self, keys, aggregations)

    def join(self, other: Table, on: object = None, **options: object) -> Table:
        if "type" in options:
            options["how"] = options.pop("type")
        return relational.join(self, other, on, **{snake(k): v for k, v in options.items()})  # type: ignore[arg-type]

    def distinct(self, names: object, **options: object) -> Table:
        return relational.distinct(self, names, **options)  # type: ignore[arg-type]

    def union(self, other: Table, **options: object) -> Table:
        return relational.union(self, other, **{snake(k): v for k, v in options.items()})  # type: ignore[arg-type]

    def sort(self, name: str, order: str = "asc") -> Table:
        """Nulls last either way; ties keep their order."""
        key = relational.sort_key(self.resolve(name), relational.descending(order))
        return self.over(self.df.orderBy(key, *self.order_columns()))

    def sort_by(self, key: Callable) -> Table:
        return self.over(self.df.orderBy(key(self.accessor()).asc_nulls_last(), *self.order_columns()))

    def sort_multiple(self, *keys: Mapping) -> Table:
        found = [relational.sort_key(self.resolve(k["column"]), relational.descending(k.get("order")), dictionary=False) for k in keys]
        return self.over(self.df.orderBy(*found, *self.order_columns()))

    def create_view(self, filter: object = None, sort: object = None, sort_order: str | None = None):  # noqa: A002
        from tabulon.view import View

        view = View(self)
        view = view.set_filter(filter) if filter is not None else view
        return view.set_sort(sort, sort_order or "asc") if sort is not None else view

    @property
    def default_view(self):
        return self.create_view()

    # -- constraints ---------------------------------------------------------------------------------------------------

    def add_unique_constraint(self, names: object, name: str | None = None, validate: bool = True) -> Table:
        own = tuple(self.schema[n].name for n in ([names] if isinstance(names, str) else names))  # type: ignore[union-attr]
        found = schemas.Unique(name or f"UQ_{self.name}_{'_'.join(own)}", own)
        out = self.over(self.df, replace(self.schema, uniques=(*self.schema.uniques, found)))
        return out.validate() if validate else out

    def get_unique_constraints(self) -> list[dict]:
        return [{"name": u.name, "columns": list(u.columns)} for u in self.schema.uniques]

    def add_check_constraint(self, predicate: object, name: str | None = None, validate: bool = True) -> Table:
        found = schemas.Check(name or f"CK_{self.name}_{len(self.schema.checks) + 1}", predicate)
        out = self.over(self.df, replace(self.schema, checks=(*self.schema.checks, found)))
        return out.validate() if validate else out

    def get_check_constraints(self) -> list[dict]:
        return [{"name": c.name} for c in self.schema.checks]

    def validate(self) -> Table:
        """Raises the first broken constraint; one job for row rules and one for each key."""
        constraints.validate(self)
        return self

    def violations(self, names: object = None) -> DataFrame:
        """Keys that occur more than once, with their counts."""
        return constraints.duplicates(self, [self.schema[n].name for n in ([names] if isinstance(names, str) else names or self.schema.primary_key)])  # type: ignore[union-attr]

    def check_violations(self) -> DataFrame:
        return constraints.check_violations(self)

    # -- changes -------------------------------------------------------------------------------------------------------

    def track(self) -> Table:
        return tracking.track(self)

    def new_row(self, **values: object) -> dict:
        """A row as a dict with defaults; it belongs to no table until it is added."""
        return {c.name: c.default_value() for c in self.schema.stored} | {self.schema[k].name: v for k, v in values.items()}

    def add_row(self, row: object, **options: object) -> Table:
        return self.add_rows([row], **options)  # type: ignore[arg-type]

    def add_rows(self, rows: Iterable[object] | DataFrame, validate: bool = True, state: str = "ADDED") -> Table:
        return tracking.add_rows(self, rows, validate, state)

    def update(self, where: object, values: Mapping[str, object], validate: bool = True) -> Table:
        return tracking.update(self, where, values, validate)

    def delete(self, where: object) -> Table:
        return tracking.delete(self, where)

    def remove(self, where: object) -> Table:
        """Takes rows out for good, whatever their state. A handler of ``rowsRemoving`` that raises prevents it."""
        self.emit("rowsRemoving", self.where(where).frame)
        out = self.over(self.df.where(~F.coalesce(self.condition(where), F.lit(False))))
        self.emit("rowsRemoved", self.where(where).frame)
        return out

    def clear(self) -> Table:
        self.emit("tableClearing", None)
        out = self.over(self.df.limit(0))
        self.emit("tableCleared", None)
        return out

    def get(self, key: object, name: str, version: str = "current") -> object:
        """One value of the row with a primary key, of its current, original or proposed version."""
        rows = self.at_key(key)
        found = None if rows is None else rows.live().df.select(self.resolve(name, version=version.lower()).column).limit(1).first()
        return None if found is None else found[0]

    def begin_load_data(self) -> Table:
        """Constraints rest until ``end_load_data``, which checks them all once."""
        return self.set_enforce_constraints(False)

    def end_load_data(self) -> Table:
        return self.set_enforce_constraints(True)

    def set_enforce_constraints(self, on: bool) -> Table:
        out = self.over(self.df, replace(self.schema, enforced=on))
        return out.validate() if on and not self.schema.enforced else out

    def begin_edit(self, where: object, values: Mapping[str, object] | None = None) -> Table:
        return tracking.begin_edit(self, where, values or {})

    def end_edit(self, where: object = None, validate: bool = True) -> Table:
        return tracking.end_edit(self, where, validate)

    def cancel_edit(self, where: object = None) -> Table:
        return tracking.cancel_edit(self, where)

    def accept_changes(self, where: object = None) -> Table:
        return tracking.accept(self, where)

    accept_all_changes = accept_changes

    def reject_changes(self, where: object = None) -> Table:
        return tracking.reject(self, where)

    reject_all_changes = reject_changes

    def clear_changes(self) -> Table:
        return tracking.clear_changes(self)

    def rows_by_state(self, state: str) -> Table:
        if not self.tracked:
            return self if state.upper() == "UNCHANGED" else self.over(self.df.where(F.lit(False)))
        return self.over(self.df.where(F.col(STATE) == state.upper()))

    get_rows_by_state = rows_by_state

    def get_changes(self, state: str | None = None) -> Table:
        if state is not None:
            return self.rows_by_state(state)
        return self.over(self.df.where(F.col(STATE).isin(*tracking.CHANGED))) if self.tracked else self.over(self.df.where(F.lit(False)))

    def has_changes(self) -> bool:
        return self.tracked and bool(self.get_changes().df.limit(1).take(1))

    def get_changes_summary(self) -> dict:
        return tracking.summary(self)

    def get_change_set(self, include_columns: Sequence[str] | None = None, exclude_columns: Sequence[str] | None = None):
        return tracking.change_set(self, include_columns, exclude_columns)

    def get_commands(self) -> dict[str, DataFrame]:
        return tracking.commands(self)

    def merge(self, source: Table, preserve_changes: bool = False, missing_schema_action: str = "error", validate: bool = True) -> tuple[Table, DataFrame]:
        return merge.merge(self, source, preserve_changes, missing_schema_action, validate)

    def merge_rows(self, rows: object, **options: object) -> tuple[Table, DataFrame]:
        return merge.merge_rows(self, rows, **{snake(k): v for k, v in options.items()})  # type: ignore[arg-type]

    def apply_change_set(self, changes: object, **options: object) -> tuple[Table, DataFrame]:
        return merge.apply_change_set(self, changes, **{snake(k): v for k, v in options.items()})  # type: ignore[arg-type]

    def load_rows(self, rows: object, **options: object) -> Table:
        from tabulon.sources import loader

        return loader.load_rows(self, rows, **options)

    def load_from_query(self, rows: object) -> Table:
        """Replaces the rows by those of a list, a DataFrame, or what a callable, a future or an awaitable gives; nothing
        happens without any."""
        rows = rows() if callable(rows) else rows.result() if hasattr(rows, "result") else rows
        if inspect.isawaitable(rows):
            rows = asyncio.run(_awaited(rows))
        if isinstance(rows, DataFrame):
            return self.load_rows(rows, clear_before_load=True) if rows.limit(1).take(1) else self
        return self.load_rows(rows, clear_before_load=True) if isinstance(rows, (list, tuple)) and rows else self

    load_from_query_async = load_from_query

    def clone(self) -> Table:
        """Tables are immutable: the same rows, schema, states and constraints."""
        return self.over(self.df, replace(self.schema, handlers={}))

    # -- events: called on the driver with a batch ---------------------------------------------------------------------

    def on(self, event: str, handler: Callable) -> Table:
        held = dict(self.schema.handlers)
        held[event] = (*held.get(event, ()), handler)
        return self.over(self.df, replace(self.schema, handlers=held))

    def off(self, event: str, handler: Callable) -> Table:
        held = {k: tuple(h for h in v if k != event or h is not handler) for k, v in self.schema.handlers.items()}
        return self.over(self.df, replace(self.schema, handlers=held))

    def emit(self, event: str, payload: object) -> None:
        """The payload, a lazy DataFrame mostly, is built only if somebody listens."""
        for handler in self.schema.handlers.get(event, ()):
            handler(payload() if callable(payload) else payload)

    # -- output --------------------------------------------------------------------------------------------------------

    def to_objects(self, **options: object) -> list[dict]:
        from tabulon import sinks

        return sinks.to_objects(self, **{snake(k): v for k, v in options.items()})  # type: ignore[arg-type]

    to_array = to_objects

    def to_json(self) -> dict:
        from tabulon import sinks

        return sinks.to_json(self)

    def serialize(self) -> str:
        from tabulon import sinks

        return json.dumps(sinks.serialize(self))

    @staticmethod
    def deserialize(spark: SparkSession, data: str | Mapping) -> Table:
        from tabulon import sinks

        return sinks.deserialize(spark, data)

    def write(self, path: str, format: str = "parquet", mode: str = "errorifexists", **options: object) -> None:  # noqa: A002
        self.live().frame().write.format(format).mode(mode).options(**options).save(path)

    def get_preview(self, rows: int = 10) -> list[dict]:
        from tabulon import debug

        return debug.preview(self, rows)

    def to_console_table(self) -> list[dict]:
        from tabulon import debug

        return debug.preview(self, None)

    def to_debug_view(self, rows: int = 10) -> dict:
        from tabulon import debug

        return debug.view(self, rows)

    def row_debug_view(self, key: object) -> dict | None:
        from tabulon import debug

        return debug.row(self, key)

    def to_debug_string(self, rows: int = 10) -> str:
        from tabulon import debug

        return debug.text(self, rows)

    def __repr__(self) -> str:
        columns = ", ".join(f"{c.name}: {c.tag}" for c in self.schema.columns)
        return f"Table({self.name!r}, [{columns}]{', tracked' if self.tracked else ''})"

    def __getattr__(self, name: str):
        """camelCase forms of the methods."""
        plain = snake(name)
        if plain != name and not name.startswith("_") and hasattr(type(self), plain):
            return getattr(self, plain)
        raise AttributeError(f"Table has no attribute {name!r}")


async def _awaited(rows: object) -> object:
    return await rows  # type: ignore[misc]


__all__ = ["Accessor", "ConstraintViolationError", "Table", "snake"]
