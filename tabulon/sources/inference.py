"""Schema inference over local records, and column definitions from driver metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import types as T

from tabulon import types as tags
from tabulon.errors import SchemaMismatchError
from tabulon.schema import ColumnSpec, column


def infer(records: Sequence[Mapping], allow_null: bool | None = True, case_sensitive: bool = False) -> list[ColumnSpec]:
    """A column for each name, in the order met; types by reconciling all values, nullability by looking if not given."""
    spelled: dict[str, str] = {}
    kinds: dict[str, set[str]] = {}
    full: dict[str, int] = {}
    samples: dict[str, list] = {}
    for record in records:
        for name, value in record.items():
            key = name if case_sensitive else str(name).lower()
            spelled.setdefault(key, str(name))
            kinds.setdefault(key, set()).add(tags.of_value(value))
            full[key] = full.get(key, 0) + (value is not None)
            if value is not None:
                samples.setdefault(key, []).append(value)
    out = []
    for key, name in spelled.items():
        tag = tags.reconcile(kinds[key])
        nullable = full[key] < len(records) if allow_null is None else allow_null
        out.append(ColumnSpec(name, spark_type(tag, samples.get(key, [])), tag, nullable))
    return out


def spark_type(tag: str, samples: list) -> T.DataType:
    """Lists and mappings of one scalar kind become arrays and maps of it, other ones text."""
    if tag == "array":
        inner = tags.reconcile({tags.of_value(x) for v in samples for x in v})
        return T.ArrayType(tags.to_spark(inner if inner in ("string", "number", "integer", "boolean", "date") else "string"))
    if tag == "object":
        inner = tags.reconcile({tags.of_value(x) for v in samples if isinstance(v, Mapping) for x in v.values()})
        return T.MapType(T.StringType(), tags.to_spark(inner if inner in ("string", "number", "integer", "boolean", "date") else "string"))
    return tags.to_spark(tag)


def definitions(columns: object) -> dict[str, ColumnSpec]:
    """Column overrides: a list of names or definitions, or a mapping of name to type or definition."""
    out: dict[str, ColumnSpec] = {}
    items: Iterable = columns.items() if isinstance(columns, Mapping) else ((None, c) for c in columns or ())  # type: ignore[union-attr]
    for name, given in items:
        if isinstance(given, ColumnSpec):
            spec = given
        elif isinstance(given, Mapping):
            own = name or given.get("name") or given.get("columnName")
            if not own:
                raise SchemaMismatchError(f"a column definition without a name: {given!r}")
            spec = column(str(own), given.get("type") or given.get("dataType"), **given)
        elif name is None:
            spec = column(str(given), "any")
        else:
            spec = column(str(name), given)
        out[spec.name.lower()] = spec
    return out


def from_metadata(fields: object, provider: str | None = None, tiny_int_one_is_boolean: bool = True) -> list[ColumnSpec]:
    """Driver fields: a list, or a mapping of name to field."""
    if isinstance(fields, Mapping):
        fields = [dict(v, name=v.get("name", k)) if isinstance(v, Mapping) else {"name": k, "type": v} for k, v in fields.items()]
    out = []
    for field in fields or ():  # type: ignore[union-attr]
        spec = from_field(field, provider, tiny_int_one_is_boolean)
        if spec:
            out.append(spec)
    return out


def from_field(field: object, provider: str | None = None, tiny_int_one_is_boolean: bool = True) -> ColumnSpec | None:
    if isinstance(field, str):
        return column(field, "any")
    if not isinstance(field, Mapping):
        return None
    name = next((field[k] for k in ("name", "columnName", "column_name", "field", "column") if field.get(k)), None)
    if not name:
        return None
    kind = next((field[k] for k in ("dataTypeID", "columnType", "dbTypeName", "type", "dataType", "typeName", "declaredType") if field.get(k) is not None), None)
    tag = tags.from_database(kind, provider, field, tiny_int_one_is_boolean)
    nullable = next((bool(field[k]) for k in ("nullable", "allowNull", "isNullable") if field.get(k) is not None), True)
    length = next((field[k] for k in ("maxLength", "columnLength", "length", "byteSize") if isinstance(field.get(k), int)), None) if tag == "string" else None
    spec = column(str(name), tag, source_column=str(name), max_length=length if length and length > 0 else None, metadata={k: field[k] for k in ("precision", "scale") if k in field} or None)
    return replace(spec, allow_null=nullable)
