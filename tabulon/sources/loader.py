"""Loading local records and query results into tables, with naming, typing and extra-column policies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import types as tags
from tabulon.errors import SchemaMismatchError, TypeMismatchError
from tabulon.operators import constraints
from tabulon.operators.tracking import ORIGINAL, PROPOSED, RID, STATE, current, next_id, struct_type, track
from tabulon.schema import ColumnSpec, TableSchema
from tabulon.sources import inference, results

if TYPE_CHECKING:
    from tabulon.table import Table

DEFAULTS = {
    "table_name": None, "name": None, "primary_key": None, "columns": None, "include_columns": None, "exclude_columns": None, "rename_columns": None,
    "column_name_transform": None, "infer_schema": True, "use_field_metadata": True, "auto_create_columns": True, "validate_schema": True, "convert_types": True,
    "row_state": "UNCHANGED", "allow_null": True, "strict": False, "clear_before_load": False, "append": True, "ignore_extra_columns": False,
    "throw_on_extra_columns": False, "column_metadata": None, "provider": None, "case_sensitive": False, "preserve_original_values": True,
}
RESULT_OPTIONS = ("rows_path", "fields_path", "fields", "recordset_index")


def options_of(given: Mapping[str, object]) -> dict:
    plain = {re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", k).lower(): v for k, v in given.items()}
    unknown = set(plain) - set(DEFAULTS) - set(RESULT_OPTIONS)
    if unknown:
        raise SchemaMismatchError(f"unknown load options {sorted(unknown)}")
    return DEFAULTS | {k: v for k, v in plain.items() if v is not None or DEFAULTS.get(k) is None}


def words(name: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", name) if w]


def transform(name: str, how: object) -> str:
    if callable(how):
        return str(how(name))
    kind = str(how or "none").lower().replace("_", "").replace("-", "")
    parts = words(name)
    if kind in ("none", "") or not parts:
        return name
    if kind in ("snakecase", "snake"):
        return "_".join(p.lower() for p in parts)
    pascal = "".join(p[:1].upper() + p[1:].lower() for p in parts)
    if kind in ("camelcase", "camel"):
        return pascal[:1].lower() + pascal[1:]
    if kind in ("pascalcase", "pascal"):
        return pascal
    raise SchemaMismatchError(f"unknown column name transform {how!r}")


def mapped_names(names: Iterable[str], o: Mapping) -> dict[str, str]:
    """Source name to column name: renamed, then transformed; included and excluded by either name."""
    rename = o["rename_columns"]
    include = {str(n).lower() for n in o["include_columns"]} if o["include_columns"] else None
    exclude = {str(n).lower() for n in o["exclude_columns"] or ()}
    out = {}
    for name in names:
        new = str(rename(name)) if isinstance(rename, Callable) else (rename or {}).get(name, name)  # type: ignore[arg-type, union-attr]
        new = transform(new, o["column_name_transform"])
        if include is not None and not {name.lower(), new.lower()} & include or {name.lower(), new.lower()} & exclude:
            continue
        out[name] = new
    return out


def normalize_rows(rows: Iterable[object], **given: object) -> list[dict]:
    """Records with their final names, without loading them."""
    o = options_of(given)
    plain = [results.record(r, results._names(o["column_metadata"])) for r in rows]
    names = mapped_names(dict.fromkeys(str(k) for r in plain for k in r), o)
    return [{names[str(k)]: v for k, v in r.items() if str(k) in names} for r in plain]


def from_objects(spark: SparkSession, rows: Iterable[object], **given: object) -> Table:
    from tabulon.table import Table

    o = options_of(given)
    table = Table(spark.createDataFrame([], T.StructType([])), TableSchema(str(o["table_name"] or o["name"] or "Table"), case_sensitive=bool(o["case_sensitive"])))
    return load_rows(table, rows, **given)


def from_query_result(spark: SparkSession, result: object, **given: object) -> Table:
    o = options_of(given)
    found = results.map_result(result, o.get("rows_path"), o.get("fields_path"), o.get("fields"), o["provider"], o.get("recordset_index") or 0)  # type: ignore[arg-type]
    rest = {k: v for k, v in o.items() if k in DEFAULTS}
    return from_objects(spark, found.rows, **(rest | {"column_metadata": found.fields, "provider": found.provider}))


def _planned(table: Table, records: Sequence[Mapping], o: Mapping) -> TableSchema:
    """The table's schema with the columns that this load creates."""
    overrides = inference.definitions(o["columns"])
    metadata = inference.from_metadata(o["column_metadata"], o["provider"]) if o["use_field_metadata"] and o["column_metadata"] else []
    names = mapped_names([c.name for c in metadata], o)
    found: dict[str, ColumnSpec] = {}
    for c in metadata:
        if c.name in names:
            found[names[c.name].lower()] = replace(c, name=names[c.name])
    if o["infer_schema"]:
        for c in inference.infer(records, o["allow_null"], table.schema.case_sensitive):
            key = c.name if table.schema.case_sensitive else c.name.lower()
            known = found.get(key)
            if known is None:
                found[key] = c
            elif known.tag == "any":
                found[key] = replace(known, data_type=c.data_type, tag=c.tag)
    for key, spec in overrides.items():
        known = found.get(key)
        typed = spec if spec.tag != "any" or known is None else replace(spec, data_type=known.data_type, tag=known.tag)
        found[key] = replace(typed, name=known.name if known else spec.name)
    schema = table.schema
    extra = [c for c in found.values() if not schema.find(c.name)]
    if schema.columns and extra:
        if o["throw_on_extra_columns"] or (o["strict"] and not o["auto_create_columns"]):
            raise SchemaMismatchError(f"table {table.name!r} has no columns {[c.name for c in extra]}")
        if o["ignore_extra_columns"] or not o["auto_create_columns"]:
            extra = []
    return replace(schema, columns=(*schema.columns, *extra))


def load_rows(table: Table, rows: Iterable[object] | DataFrame, **given: object) -> Table:
    """Appends rows, or replaces all (``clear_before_load``, ``append=False``). A value that does not fit widens its column
    to text, or raises if ``strict``."""
    o = options_of(given)
    if isinstance(rows, DataFrame):
        return _load_frame(table, rows, o)
    records = normalize_rows(rows, **{k: v for k, v in o.items() if k in DEFAULTS})
    if not records and not table.schema.columns and not o["columns"] and not o["column_metadata"]:
        raise SchemaMismatchError("no schema can be inferred from nothing")
    schema = _planned(table, records, o)
    values: dict[str, list] = {c.name: [] for c in schema.stored}
    for record in records:
        own = {c.name: v for k, v in record.items() if (c := schema.find(k))}
        for c in schema.stored:
            values[c.name].append(own.get(c.name) if c.name in own else c.default_value())
    columns = []
    widened: set[str] = set()
    for c in schema.columns:
        if c.computed:
            columns.append(c)
            continue
        kind = c.tag if c.tag in ("json", "any") else tags.of_spark(c.data_type)
        try:
            values[c.name] = [tags.convert(v, kind) for v in values[c.name]] if o["convert_types"] or o["validate_schema"] else values[c.name]
        except TypeMismatchError:
            if o["strict"]:
                raise
            values[c.name] = [tags.convert(v, "any") for v in values[c.name]]
            widened.add(c.name)
            c = replace(c, data_type=T.StringType(), tag="any")  # noqa: PLW2901
        columns.append(c)
    schema = replace(schema, columns=tuple(columns))
    if o["primary_key"]:
        schema = schema.with_primary_key(o["primary_key"])
    struct = T.StructType([T.StructField(c.name, c.data_type) for c in schema.stored] + [T.StructField(RID, T.LongType())])
    data = [(*row, i) for i, row in enumerate(zip(*(values[c.name] for c in schema.stored), strict=True))] if schema.stored else []
    new = table.spark.createDataFrame(data, struct)
    return _placed(table, new, schema, widened, o)


def _load_frame(table: Table, rows: DataFrame, o: Mapping) -> Table:
    names = mapped_names(rows.columns, o)
    frame = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    fresh = [ColumnSpec(f.name, f.dataType, tags.of_spark(f.dataType), True) for f in frame.schema.fields if not table.schema.find(f.name)]
    if table.schema.columns and fresh:
        if o["throw_on_extra_columns"]:
            raise SchemaMismatchError(f"table {table.name!r} has no columns {[c.name for c in fresh]}")
        if o["ignore_extra_columns"] or not o["auto_create_columns"]:
            fresh = []
    schema = replace(table.schema, columns=(*table.schema.columns, *fresh))
    own = {schema[c].name: c for c in frame.columns if schema.find(c)}
    widened = set() if o["strict"] else _unfit(frame, schema, own)
    schema = replace(schema, columns=tuple(replace(c, data_type=T.StringType(), tag="any") if c.name in widened else c for c in schema.columns))
    kinds = {f.name: f.dataType for f in frame.schema.fields}

    def cast(c: str, k: T.DataType) -> Column:
        if schema[c].name in widened and isinstance(kinds[c], (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(F.col(f"`{c}`"))
        return F.col(f"`{c}`").cast(k) if o["strict"] else F.col(f"`{c}`").try_cast(k)

    new = frame.select(*[(cast(own[c.name], c.data_type) if c.name in own else F.lit(c.default_value()).cast(c.data_type)).alias(c.name) for c in schema.stored]).withColumn(RID, F.monotonically_increasing_id())
    if o["primary_key"]:
        schema = schema.with_primary_key(o["primary_key"])
    return _placed(table, new, schema, widened, o)


def _unfit(frame: DataFrame, schema: TableSchema, own: Mapping[str, str]) -> set[str]:
    """The columns with a value that their type cannot hold: its cast is null, or an integer without the value's fraction."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    checks = []
    for name, c in own.items():
        kind, source = schema[name].data_type, kinds[c]
        if schema[name].computed or kind == source or isinstance(kind, T.StringType):
            continue
        value = F.col(f"`{c}`")
        lost = value.try_cast(kind).isNull()
        if isinstance(source, T.FractionalType) and (isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0):
            lost = lost | (value != F.floor(value))
        checks.append(F.coalesce(F.bool_or(value.isNotNull() & lost), F.lit(False)).alias(name))
    found = frame.agg(*checks).first() if checks else None
    return {n for n, unfit in found.asDict().items() if unfit} if found else set()


def _placed(table: Table, new: DataFrame, schema: TableSchema, widened: set[str], o: Mapping) -> Table:
    replaced = o["clear_before_load"] or not o["append"] or not table.schema.columns
    state = str(o["row_state"]).upper()
    out = table.over(new, schema, tracked=False)
    if state != "UNCHANGED" or table.tracked and not replaced:
        out = track(out)
        out = out.over(out.df.withColumn(STATE, F.lit(state)))
    if not replaced:
        base = table
        for c in schema.stored:
            if not base.schema.find(c.name):
                base = base.add_column(c.name, c.data_type, default=c.default)
        if out.tracked:
            base = track(base)
        elif RID not in base.df.columns:
            base = base.over(base.df.withColumn(RID, F.monotonically_increasing_id()))
        held = base.df
        for name in widened:
            held = held.withColumn(name, F.col(f"`{name}`").cast("string"))
        if out.tracked:
            held = held.withColumn(ORIGINAL, F.when(F.col(ORIGINAL).isNotNull(), F.col(ORIGINAL).cast(struct_type(out)))).withColumn(PROPOSED, F.col(PROPOSED).cast(struct_type(out)))
        shifted = out.df.withColumn(RID, next_id(base) + F.lit(0)) if not isinstance(out.df.schema[RID].dataType, T.LongType) else out.df.withColumn(RID, F.col(RID) + (base.df.agg(F.coalesce(F.max(RID), F.lit(-1))).first()[0] + 1))
        out = out.over(held.unionByName(shifted))
    if o["validate_schema"]:
        constraints.validate(out)
    out.emit("rowsAdded", lambda: new.drop(RID))
    return out


__all__ = ["current", "from_objects", "from_query_result", "load_rows", "normalize_rows"]
