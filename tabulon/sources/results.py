"""Shapes in which database clients return results, mapped to records, fields and a provider; on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from tabulon.errors import SchemaMismatchError

# Members under which clients hand over their rows and fields.
WRAPPERS = ("data", "result", "items", "records", "values", "documents", "docs")
FIELD_NAMES = ("fields", "columns", "columnMetadata", "metaData")


class ResultRows(list):
    """A list of rows that carries metadata, as some clients return it."""

    def __init__(self, rows: Sequence = (), **metadata: object):
        super().__init__(rows)
        self.__dict__.update(metadata)


@dataclass(frozen=True)
class Mapped:
    rows: list[dict]
    fields: object
    provider: str | None
    recordsets: list[list[dict]]


def _at(value: object, path: object) -> object:
    for part in path.split(".") if isinstance(path, str) else path:  # type: ignore[union-attr]
        value = value.get(part) if isinstance(value, Mapping) else getattr(value, part, None)
        if value is None:
            return None
    return value


def _rows(value: object) -> bool:
    return isinstance(value, (list, tuple))


def _fields_of(value: object) -> object:
    for name in FIELD_NAMES:
        found = value.get(name) if isinstance(value, Mapping) else getattr(value, name, None)
        if found is not None:
            return found
    return None


def is_mysql_pair(value: object) -> bool:
    """``[rows, fields]``: the second a list of fields, each with a name and a type or length, or empty."""
    if not _rows(value) or len(value) != 2 or not all(map(_rows, value)):  # type: ignore[arg-type]
        return False
    fields = value[1]  # type: ignore[index]
    return all(isinstance(f, Mapping) and "name" in f and ("columnType" in f or "columnLength" in f or "type" in f) for f in fields)


def provider_of(fields: object) -> str | None:
    first = next(iter(fields.values() if isinstance(fields, Mapping) else fields), None) if fields else None  # type: ignore[union-attr]
    if isinstance(first, Mapping):
        for key, provider in (("dataTypeID", "pg"), ("columnType", "mysql"), ("dbTypeName", "oracle"), ("fetchType", "oracle"), ("declaredType", "sqlite")):
            if key in first:
                return provider
    return None


def _names(fields: object) -> list[str]:
    items = fields.keys() if isinstance(fields, Mapping) else fields or ()
    return [str(f.get("name") or f.get("columnName") or f.get("field")) if isinstance(f, Mapping) else str(f) for f in items]  # type: ignore[union-attr]


def records(rows: Sequence, fields: object) -> list[dict]:
    """Positional rows get their fields' names; other rows become plain mappings."""
    names = _names(fields)
    return [record(r, names) for r in rows]


def record(row: object, names: Sequence[str] = ()) -> dict:
    if isinstance(row, Mapping):
        return dict(row)
    for method in ("asDict", "as_dict", "to_dict", "model_dump", "toJSON", "_asdict"):
        if callable(found := getattr(row, method, None)):
            return dict(found())
    if isinstance(row, (list, tuple)):
        if not names:
            raise SchemaMismatchError("positional rows need fields")
        return dict(zip(names, row, strict=False))
    if hasattr(row, "__dict__"):
        return {k: v for k, v in vars(row).items() if not k.startswith("_")}
    raise SchemaMismatchError(f"no record: {row!r}")


def extract_rows(result: object, **options: object) -> list[dict]:
    """The records of a query result."""
    return map_result(result, **options).rows  # type: ignore[arg-type]


def extract_recordsets(result: object, **options: object) -> list[list[dict]]:
    """The records of every record set of a query result."""
    return map_result(result, **options).recordsets  # type: ignore[arg-type]


def map_result(result: object, rows_path: object = None, fields_path: object = None, fields: object = None, provider: str | None = None, recordset_index: int = 0) -> Mapped:
    """In this order: a given path, a MySQL pair, a list, ``rows``, ``recordset``, ``recordsets``, a wrapper."""
    own = fields if fields is not None else _at(result, fields_path) if fields_path else None

    def done(rows: Sequence, found: object, kind: str | None, sets: list | None = None) -> Mapped:
        found = own if own is not None else found
        plain = records(rows, found)
        return Mapped(plain, found, provider or kind or provider_of(found), sets if sets is not None else [plain])

    if rows_path:
        rows = _at(result, rows_path)
        if not _rows(rows):
            raise SchemaMismatchError(f"no rows at {rows_path!r}")
        return done(rows, _fields_of(result), None)  # type: ignore[arg-type]
    if is_mysql_pair(result):
        return done(result[0], result[1], "mysql")  # type: ignore[index]
    if _rows(result):
        return done(result, _fields_of(result), None)  # type: ignore[arg-type]
    if isinstance(result, Mapping):
        if _rows(result.get("rows")):
            found = _fields_of(result)
            kind = provider_of(found) or ("oracle" if "metaData" in result else "sqlite" if "columns" in result else None)
            return done(result["rows"], found, kind)
        if _rows(result.get("recordset")):
            sets = [records(s, None) for s in result.get("recordsets") or [result["recordset"]]]
            found = _fields_of(result["recordset"]) or _fields_of(result)
            return done(result["recordset"], found, "mssql", sets)
        if _rows(result.get("recordsets")):
            sets = [records(s, _fields_of(s)) for s in result["recordsets"]]
            if not 0 <= recordset_index < max(1, len(sets)):
                raise SchemaMismatchError(f"no record set {recordset_index}")
            return done(result["recordsets"][recordset_index] if sets else [], _fields_of(result), "mssql", sets)
        for name in WRAPPERS:
            inner = result.get(name)
            if _rows(inner) or isinstance(inner, Mapping):
                return map_result(inner, None, None, own if own is not None else _fields_of(result), provider, recordset_index)
    raise SchemaMismatchError("this is no query result of a known shape")
