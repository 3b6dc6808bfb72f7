"""Merge, upsert and change-set application as joins: one pass labels each row with its outcome and computes its values.

Every function returns the new table and a frame of outcomes (``outcome``, ``n``); the counts cost a job only when read.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import ConstraintViolationError, DuplicatePrimaryKeyError, SchemaMismatchError
from tabulon.operators import constraints
from tabulon.operators.tracking import ADDED, CHANGED, DELETED, MODIFIED, ORIGINAL, PROPOSED, RID, STATE, UNCHANGED, ChangeSet, current, names, next_id, struct_type, track
from tabulon.schema import ColumnSpec

if TYPE_CHECKING:
    from tabulon.table import Table

OUTCOME = "__outcome"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _outcomes(labelled: DataFrame) -> DataFrame:
    return labelled.where(f"{OUTCOME} IS NOT NULL").groupBy(F.col(OUTCOME).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _fit_schema(table: Table, source: Table, action: str) -> Table:
    action = action.lower()
    if action not in ("add", "ignore", "error"):
        raise SchemaMismatchError(f"unknown missing-schema action {action!r}")
    difference = table.compare_schema(source)
    for found in difference["typeMismatches"]:
        raise SchemaMismatchError(f"merge: column {found['columnName']!r} is {found['thisType']} here and {found['otherType']} in the source")
    missing = [source.schema[n] for n in difference["missingColumns"]]
    if missing and action == "error":
        raise SchemaMismatchError(f"merge: table {table.name!r} lacks {[c.name for c in missing]}")
    mine, theirs = table.schema.primary_key, source.schema.primary_key
    if mine and theirs and [k.lower() for k in mine] != [k.lower() for k in theirs]:
        raise SchemaMismatchError(f"merge: the primary key is {list(mine)} here and {list(theirs)} in the source")
    if action == "add":
        for spec in missing:
            table = table.add_column(
                spec.name, spec.data_type, allow_null=spec.allow_null, default=spec.default, caption=spec.caption, expression=spec.expression, read_only=spec.read_only,
                unique=spec.unique, max_length=spec.max_length, source_column=spec.source_column, metadata=spec.metadata,
            )
        if not mine and theirs:
            table = table.set_primary_key(theirs, validate=False)
    lost = [k for k in table.schema.primary_key if not source.schema.find(k)]
    if lost:
        raise SchemaMismatchError(f"merge: the source {source.name!r} lacks the primary key columns {lost}")
    return table


def _no_null_keys(rows: DataFrame, key: Sequence[str]) -> None:
    if rows.where(_any([F.col(f"`{k}`").isNull() for k in key])).limit(1).take(1):
        raise ConstraintViolationError(f"the primary key {list(key)} of a source row holds a null")


def _same_key(left: str, right: str, key: Sequence[str]) -> Column:
    """Equality of keys; without null-safety, as null keys never match, so the join is one on plain columns."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`") == F.col(f"{right}.`{k}`") for k in key])


def merge(table: Table, source: Table, preserve_changes: bool = False, missing_schema_action: str = "error", validate: bool = True) -> tuple[Table, DataFrame]:
    """Source rows update the row with their key or are added; outcomes are updated, inserted, preserved and skipped. With
    ``preserve_changes`` an added row, and a locally changed value, stays.

    Rows of a source without a primary key may repeat a key: they act in their order, so the last one counts (with
    ``preserve_changes`` the first one that changes a column, as the row has local changes then); each row but one of a key
    has the outcome ``superseded``. A row that one of them changes is updated, even if the last one restores it. A null key raises, and so does a broken constraint, unless ``validate`` is off."""
    if table.name != source.name and table.name != "Table" and source.name != "Table":
        raise SchemaMismatchError(f"merge: table {source.name!r} is not {table.name!r}")
    table = track(_fit_schema(table, source, missing_schema_action))
    key = table.schema.primary_key
    common = [c.name for c in table.schema.stored if (s := source.schema.find(c.name)) and not s.computed]
    live = source.live().df
    order = F.col(RID) if RID in live.columns else F.monotonically_increasing_id()
    incoming = live.select(*[F.col(f"`{source.schema[n].name}`").cast(table.schema[n].data_type).alias(n) for n in common], order.alias(RID))
    gone = source.get_changes(DELETED).df.count() if source.tracked else 0
    present: dict[str, Column] = {n: F.lit(True) for n in common}
    moved = F.lit(False)
    more: list[DataFrame] = []
    if key:
        _no_null_keys(incoming, key)
        if not source.schema.primary_key:
            rest = [n for n in common if n not in key]
            keys = [F.col(f"`{k}`") for k in key]
            counts = incoming.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("n > 0")
            more.append(counts.select(F.lit("superseded").alias("outcome"), F.col("n").cast("long").alias("n")))
            if not rest:
                incoming = incoming.select(*keys).distinct()
            elif preserve_changes:
                held = table.df.where(F.col(STATE) != DELETED).select(*[F.col(f"`{n}`") for n in common], F.lit(True).alias("__t"))
                met = incoming.alias("s").join(held.alias("t"), _same_key("s", "t", key), "left")
                new = F.col("t.__t").isNull()
                first = lambda n: F.when(new | ~F.col(f"s.`{n}`").eqNullSafe(F.col(f"t.`{n}`")), F.col(f"s.{RID}"))
                grouped = met.groupBy(*[F.col(f"s.`{k}`").alias(k) for k in key])
                incoming = grouped.agg(*[F.min_by(F.struct(F.col(f"s.`{n}`").alias("v")), first(n)).alias(n) for n in rest])
                incoming = incoming.select(*keys, *[F.col(f"`{n}`.v").alias(n) for n in rest], *[F.col(f"`{n}`").isNotNull().alias(f"__has_{i}") for i, n in enumerate(rest)])
                present |= {n: F.col(f"s.__has_{i}") for i, n in enumerate(rest)}
            else:
                row = F.struct(*[F.col(f"`{n}`") for n in rest])
                last = incoming.groupBy(*keys).agg(F.max_by(row, RID).alias("__last"), (~F.min(row).eqNullSafe(F.max(row))).alias("__moved"))
                incoming = last.select(*keys, *[F.col("__last").getField(n).alias(n) for n in rest], "__moved")
                moved = F.col("s.__moved")
    if RID in incoming.columns:
        incoming = incoming.drop(RID)
    out, labelled = _upsert(table, incoming, present, preserve_changes, insert=True, update=True, kept_state=None, moved=moved)
    if validate:
        constraints.validate_rest(out)
    outcomes = _outcomes(labelled)
    if gone:
        more.append(table.spark.range(1).select(F.lit("skipped").alias("outcome"), F.lit(gone).cast("long").alias("n")))
    for frame in more:
        outcomes = outcomes.unionByName(frame)
    return out, outcomes.groupBy("outcome").agg(F.sum("n").alias("n")) if more else outcomes


def _upsert(table: Table, incoming: DataFrame, present: Mapping[str, Column], preserve: bool, insert: bool, update: bool, kept_state: str | None, moved: Column | None = None) -> tuple[Table, DataFrame]:
    """``present``: for each incoming column, over the aliased frame ``s``, whether a row has it. ``kept_state``: the state of
    updated and inserted rows (None: changed rows are MODIFIED, new ones ADDED). ``moved``: over ``s`` too, whether a matched
    row is changed in any case, as rows before the last differ from it."""
    key = table.schema.primary_key
    every = names(table)
    struct = struct_type(table)
    held = [c for c in incoming.columns if c in every]
    if not key:
        new = incoming.select(*[F.col(f"`{n}`") if n in held else F.lit(table.schema[n].default_value()).cast(table.schema[n].data_type).alias(n) for n in every])
        rows = new.withColumn(RID, next_id(table)).withColumn(STATE, F.lit(kept_state or ADDED)).withColumn(ORIGINAL, current(table)).withColumn(PROPOSED, F.lit(None).cast(struct))
        return table.over(table.df.unionByName(rows)), rows.select(F.lit("inserted").alias(OUTCOME))
    live, deleted = table.df.where(F.col(STATE) != DELETED), table.df.where(F.col(STATE) == DELETED)
    t, s = live.withColumn("__t", F.lit(True)).alias("t"), incoming.withColumn("__s", F.lit(True)).alias("s")
    both = t.join(s, _same_key("t", "s", key), "full")
    new_row, matched = F.col("t.__t").isNull(), F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull()
    state = F.col(f"t.{STATE}")
    values, changes, keeps = {}, [], []
    for n in every:
        mine = F.col(f"t.`{n}`")
        default = F.lit(table.schema[n].default_value()).cast(table.schema[n].data_type)
        if n not in held:
            values[n] = F.when(new_row, default).otherwise(mine)
            continue
        theirs, given = F.col(f"s.`{n}`"), present.get(n, F.lit(True))
        if n in key:
            values[n] = F.coalesce(mine, theirs)
            continue
        keep = (state == ADDED) | (state == MODIFIED) & ~mine.eqNullSafe(F.col(f"t.{ORIGINAL}").getField(n)) if preserve else F.lit(False)
        differs = given & ~theirs.eqNullSafe(mine)
        take = matched & given & ~keep if update else F.lit(False)
        values[n] = F.when(new_row, F.when(given, theirs).otherwise(default)).when(take, theirs).otherwise(mine)
        changes.append(differs & ~keep)
        keeps.append(differs & keep)
    changed, kept = _any(changes if moved is None else [*changes, moved]) & F.lit(update), _any(keeps)
    outcome = F.when(new_row, "inserted").when(matched & changed, "updated").when(matched & kept, "preserved").when(matched, "skipped")
    row = F.struct(*[values[n].alias(n) for n in every])
    old = F.struct(*[F.col(f"t.`{n}`") for n in every])
    if kept_state is None:
        after = F.when(new_row, ADDED).when(matched & changed & (state == UNCHANGED), MODIFIED).otherwise(state)
        original = F.when(new_row, row).when(matched & changed & (state == UNCHANGED), old).otherwise(F.col(f"t.{ORIGINAL}"))
    else:
        after = F.when(new_row, UNCHANGED).when(matched & changed, kept_state).otherwise(state)
        original = F.when(new_row, row).when(matched & changed, old if kept_state == MODIFIED else row).otherwise(F.col(f"t.{ORIGINAL}"))
    top = table.df.agg(F.coalesce(F.max(RID), F.lit(-1))).first()[0]
    labelled = both.select(
        row.alias("__row"), F.coalesce(F.col(f"t.{RID}"), F.lit(top + 1) + F.monotonically_increasing_id()).alias(RID), after.alias(STATE), original.alias(ORIGINAL),
        F.col(f"t.{PROPOSED}").alias(PROPOSED), outcome.alias(OUTCOME), F.col("t.__t").isNotNull().alias("__t"),
    )
    rows = labelled if insert else labelled.where("__t")
    merged = rows.select(*[F.col("__row").getField(n).alias(n) for n in every], RID, STATE, ORIGINAL, PROPOSED)
    return table.over(merged.unionByName(deleted)), labelled if insert else labelled.withColumn(OUTCOME, F.when(~F.col("__t"), "skipped").otherwise(F.col(OUTCOME)))


def merge_rows(
    table: Table, rows: Iterable[object] | DataFrame, primary_key: object = None, update_existing: bool = True, add_missing: bool = True, mark_modified: bool = False,
    auto_create_columns: bool = True, ignore_extra_columns: bool = False, order_by: str | None = None, validate: bool = True,
) -> tuple[Table, DataFrame]:
    """Upsert of plain rows. A local row touches only the columns it has, and of rows with one key each column's last one
    counts; a DataFrame has all its columns, and of rows with one key the last by ``order_by`` counts (without it, repeated
    keys raise, as a DataFrame has no order). Null keys and broken constraints raise; ``validate=False`` leaves out the
    constraints and the look for repeated keys."""
    from tabulon.sources import inference

    if primary_key:
        table = table.set_primary_key(primary_key, validate=False)
    if not table.schema.primary_key:
        raise SchemaMismatchError("merge_rows needs a primary key")
    table = track(table)
    if isinstance(rows, DataFrame):
        extra = [c for c in rows.columns if c != order_by and not table.schema.find(c)]
        kinds: dict[str, object] = {c: rows.schema[c].dataType for c in extra}
        local: list[Mapping] | None = None
    else:
        local = [r.asDict() if hasattr(r, "asDict") else r for r in rows]  # type: ignore[union-attr]
        extra = list(dict.fromkeys(k for r in local for k in r if not table.schema.find(k)))
        kinds = {c.name: c.data_type for c in inference.infer(local) if c.name in extra}
    if extra and not ignore_extra_columns:
        if not auto_create_columns:
            raise SchemaMismatchError(f"table {table.name!r} has no columns {extra}")
        for c in extra:
            table = table.add_column(c, kinds.get(c))
    key = table.schema.primary_key
    order = F.col("__n")
    given_names = rows.columns if local is None else {k for r in local for k in r}  # type: ignore[union-attr]
    lost = [k for k in key if not any(table.schema.find(n) is table.schema[k] for n in given_names)]
    if lost and given_names:
        raise SchemaMismatchError(f"merge_rows: the rows lack the primary key columns {lost}")
    if local is None:
        own = {table.schema[c].name: c for c in rows.columns if table.schema.find(c)}  # type: ignore[union-attr]
        frame = rows.select(*[F.col(f"`{c}`").cast(table.schema[n].data_type).alias(n) for n, c in own.items()], *([F.col(order_by).alias("__n")] if order_by else []))  # type: ignore[union-attr]
        if order_by:
            rest = [n for n in own if n not in key]
            frame = frame.groupBy(*key).agg(*[F.max_by(F.struct(F.col(f"`{n}`")), order).getField(n).alias(n) for n in rest]) if rest else frame.select(*key).distinct()
        elif validate:
            repeated = frame.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).take(1)
            if repeated:
                raise DuplicatePrimaryKeyError(f"merge_rows: several rows with the key {[repeated[0][k] for k in key]}; give order_by")
        present = {n: F.lit(True) for n in own}
    else:
        specs = [c for c in table.schema.stored if any(table.schema.find(k) is c for r in local for k in r)]
        fields = [T.StructField(c.name, c.data_type) for c in specs] + [T.StructField(f"__has_{i}", T.BooleanType()) for i in range(len(specs))] + [T.StructField("__n", T.LongType())]
        data = []
        for n, r in enumerate(local):
            given = {table.schema[k].name: v for k, v in r.items() if table.schema.find(k)}
            data.append((*(_converted(c, given.get(c.name)) for c in specs), *(c.name in given for c in specs), n))
        frame = table.spark.createDataFrame(data, T.StructType(fields))
        place = {c.name: i for i, c in enumerate(specs)}
        aggregates = []
        for c in specs:
            if c.name not in key:
                has = F.col(f"__has_{place[c.name]}")
                aggregates.append(F.max_by(F.struct(F.col(f"`{c.name}`")), F.when(has, order)).getField(c.name).alias(c.name))
                aggregates.append(F.max(has).alias(f"__has_{place[c.name]}"))
        frame = frame.groupBy(*[F.col(f"`{k}`") for k in key]).agg(*aggregates) if aggregates else frame.select(*key).distinct()
        present = {c.name: F.coalesce(F.col(f"s.__has_{place[c.name]}"), F.lit(False)) for c in specs if c.name not in key}
    _no_null_keys(frame, key)
    out, labelled = _upsert(table, frame, present, False, add_missing, update_existing, MODIFIED if mark_modified else UNCHANGED)
    if validate:
        constraints.validate_rest(out)
    return out, _outcomes(labelled)


def _converted(spec: ColumnSpec, value: object) -> object:
    from tabulon import types as tags

    return tags.convert(value, tags.of_spark(spec.data_type) if spec.tag not in ("json", "any") else spec.tag)


def apply_change_set(
    table: Table, changes: ChangeSet | Mapping, missing_row_action: str = "ignore", conflict_policy: str = "overwrite", strict: bool = False, validate: bool = True
) -> tuple[Table, DataFrame]:
    """Applies changes by key, then by original key (so keys may change). Outcomes: added, modified, deleted, skipped. A row
    with local changes is a conflict: overwritten, preserved or an error. ``strict`` refuses another table's changes, another
    primary key and unknown columns. Of several changes to one row the last kind (added, modified, deleted) counts. Errors,
    a broken constraint among them, leave the table as it was."""
    for value, allowed in ((missing_row_action, ("ignore", "add", "error")), (conflict_policy, ("overwrite", "preserve", "error"))):
        if value not in allowed:
            raise SchemaMismatchError(f"{value!r} is none of {allowed}")
    table = track(table)
    key = table.schema.primary_key
    if not key:
        raise SchemaMismatchError("change sets need a primary key")
    if strict:
        name, theirs = (changes.table_name, changes.primary_key) if isinstance(changes, ChangeSet) else (changes.get("tableName"), changes.get("primaryKey"))
        if name and name != table.name:
            raise SchemaMismatchError(f"changes of table {name!r} do not belong to {table.name!r}")
        if theirs and list(theirs) != list(key):
            raise SchemaMismatchError(f"the changes' primary key is {list(theirs)}, the table's {list(key)}")
        if isinstance(changes, Mapping):
            unknown = [k for part in ("added", "modified", "deleted") for r in changes.get(part, ()) for k in (r.get("values") or {}) if not table.schema.find(k)]
            if unknown:
                raise SchemaMismatchError(f"table {table.name!r} has no columns {unknown}")
    found = changes if isinstance(changes, ChangeSet) else from_object(table, changes)
    held = found.df.schema["values"].dataType.names if isinstance(found.df.schema["values"].dataType, T.StructType) else []
    unknown = [n for n in held if not table.schema.find(n)]
    if unknown and strict:
        raise SchemaMismatchError(f"table {table.name!r} has no columns {unknown}")
    shared = {table.schema[n].name: n for n in held if (c := table.schema.find(n)) and not c.computed}
    rank = F.when(F.col("state") == ADDED, 1).when(F.col("state") == MODIFIED, 2).otherwise(3)
    places = {k: next((n for n in found.df.schema["key"].dataType.names if n.lower() == k.lower()), None) for k in key}
    part = lambda struct, k: F.col(struct).getField(places[k]).cast(table.schema[k].data_type) if places[k] else F.lit(None).cast(table.schema[k].data_type)
    one = [f"__k{i}" for i in range(len(key))]  # the key a change names
    old = [f"__o{i}" for i in range(len(key))]  # the key its row had before: a change's identity
    c = found.df.select("state", "values", *[part("key", k).alias(n) for k, n in zip(key, one, strict=True)], *[F.coalesce(part("original_key", k), part("key", k)).alias(n) for k, n in zip(key, old, strict=True)], rank.alias("__order"))
    c = c.groupBy(*old).agg(F.max_by(F.struct("state", "values", *one), "__order").alias("c")).select("c.*", *old)
    every = names(table)
    # where a change looks for its row: under its key, or else under the original one
    differ = _any([~F.col(a).eqNullSafe(F.col(b)) for a, b in zip(one, old, strict=True)])
    looks = c.select(*old, *[F.col(a).alias(f"__l{i}") for i, a in enumerate(one)], F.lit(1).alias("__pref"))
    looks = looks.unionByName(c.where(differ).select(*old, *[F.col(b).alias(f"__l{i}") for i, b in enumerate(old)], F.lit(2).alias("__pref")))
    live = table.df.where(F.col(STATE) != DELETED).select(F.struct(*[F.col(f"`{x}`") for x in table.df.columns]).alias("row"))
    on = reduce(lambda a, b: a & b, [F.col("row").getField(k) == F.col(f"__l{i}") for i, k in enumerate(key)])
    met = looks.join(live, on).groupBy(*old).agg(F.min_by("row", "__pref").alias("row"))
    joined = c.alias("c").join(met.alias("m"), reduce(lambda a, b: a & b, [F.col(f"c.{o}").eqNullSafe(F.col(f"m.{o}")) for o in old]), "left").select("c.*", "m.row")
    exists = F.col("row").isNotNull()
    state, local = F.col("state"), F.col("row").getField(STATE).isin(*CHANGED)
    verdict = (
        F.when(exists & local & F.lit(conflict_policy == "error"), "conflict")
        .when(exists & local & F.lit(conflict_policy == "preserve"), "skipped")
        .when(~exists & (state != ADDED) & F.lit(missing_row_action == "error") , "missing")
        .when(~exists & (state != ADDED) & F.lit(missing_row_action == "ignore"), "skipped")
        .otherwise(F.lower(state))
    )
    labelled = joined.withColumn(OUTCOME, verdict)
    bad = labelled.where(F.col(OUTCOME).isin("conflict", "missing")).limit(1).take(1) if "error" in (missing_row_action, conflict_policy) else []
    if bad:
        raise SchemaMismatchError(f"change set: {'a row has local changes' if bad[0][OUTCOME] == 'conflict' else 'a row is missing'}: {[bad[0][o] for o in old]}")
    done = labelled.where(F.col(OUTCOME) != "skipped")
    removed = F.col("state") == DELETED
    value = {}
    for n in every:
        default = F.lit(table.schema[n].default_value()).cast(table.schema[n].data_type)
        mine = F.when(exists, F.col("row").getField(n)).otherwise(default)
        value[n] = F.when(removed & exists, mine).otherwise(F.col("values").getField(shared[n]).cast(table.schema[n].data_type)) if n in shared else mine
    after = F.struct(*[value[n].alias(n) for n in every])
    before = F.struct(*[F.col("row").getField(n).alias(n) for n in every])
    was = F.col("row").getField(STATE)
    top = table.df.agg(F.coalesce(F.max(RID), F.lit(-1))).first()[0]
    new = done.select(
        *[value[n].alias(n) for n in every],
        F.coalesce(F.col("row").getField(RID), F.lit(top + 1) + F.monotonically_increasing_id()).alias(RID),
        F.when(removed, DELETED).when(~exists, F.when(F.col("state") == ADDED, ADDED).otherwise(MODIFIED)).when(was == UNCHANGED, F.when(~before.eqNullSafe(after), MODIFIED).otherwise(UNCHANGED)).otherwise(was).alias(STATE),
        F.when(exists & (was == UNCHANGED), before).when(exists, F.col("row").getField(ORIGINAL)).otherwise(after).alias(ORIGINAL),
        F.lit(None).cast(struct_type(table)).alias(PROPOSED),
    )
    # rows that a change has taken, by their typed key; deleted rows never match
    taken = done.where(exists).select(*[F.col("row").getField(k).alias(f"__t{i}") for i, k in enumerate(key)])
    untouched = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"__t{i}") for i, k in enumerate(key)]) & (F.col(STATE) != DELETED)
    kept, fresh = table.over(table.df.join(taken, untouched, "left_anti").select(*table.df.columns)), table.over(new.select(*table.df.columns))
    out = table.over(kept.df.unionByName(fresh.df))
    if validate:
        constraints.validate_parts(out, kept, fresh)
    return out, _outcomes(labelled)


def from_object(table: Table, data: Mapping) -> ChangeSet:
    """A change set from its plain form."""
    fields = [T.StructField(n, table.schema[n].data_type) for n in names(table)]
    held = list(dict.fromkeys(table.schema[k].name for part in ("added", "modified", "deleted") for r in data.get(part, ()) for k in (r.get("values") or {}) if table.schema.find(k)))
    values = T.StructType([f for f in fields if f.name in held])
    keys = T.StructType([next(f for f in fields if f.name == k) for k in table.schema.primary_key])

    def struct(kind: T.StructType, row: Mapping | None) -> tuple | None:
        return None if row is None else tuple(_converted(table.schema[f.name], next((v for k, v in row.items() if k.lower() == f.name.lower()), None)) for f in kind.fields)

    rows = []
    for part, state in (("added", ADDED), ("modified", MODIFIED), ("deleted", DELETED)):
        for r in data.get(part, ()):
            own = r.get("values") or {}
            rows.append((len(rows), state, struct(keys, r.get("key") or own), struct(keys, r.get("originalKey")), struct(values, own), struct(values, r.get("originalValues")), list(r.get("changedColumns") or ())))
    schema = T.StructType([T.StructField(RID, T.LongType()), T.StructField("state", T.StringType()), T.StructField("key", keys), T.StructField("original_key", keys), T.StructField("values", values), T.StructField("original", values), T.StructField("changed_columns", T.ArrayType(T.StringType()))])
    return ChangeSet(data.get("tableName", table.name), table.schema.primary_key, table.spark.createDataFrame(rows, schema))
