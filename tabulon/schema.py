"""Columns, keys and constraints of a table; comparison, update and JSON form of schemas."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from tabulon import types as tags
from tabulon.errors import ColumnNotFoundError, SchemaMismatchError


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: T.DataType
    tag: str
    allow_null: bool = True
    default: object = None  # a constant, or a function called for each new row or batch
    caption: str | None = None
    expression: object = None  # text of the expression language, or a function of a row accessor
    read_only: bool = False
    unique: bool = False
    max_length: int | None = None
    source_column: str | None = None
    metadata: object = None

    @property
    def computed(self) -> bool:
        return self.expression is not None

    def default_value(self) -> object:
        return self.default() if callable(self.default) else self.default

    def to_dict(self) -> dict:
        return {
            "name": self.name, "dataType": self.tag, "sparkType": self.data_type.jsonValue(), "allowNull": self.allow_null,
            "defaultValue": None if callable(self.default) else self.default, "caption": self.caption or self.name,
            "expression": self.expression if isinstance(self.expression, str) else None, "readOnly": self.read_only,
            "unique": self.unique, "maxLength": self.max_length, "sourceColumn": self.source_column,
        }


def column(name: str, data_type: str | T.DataType | None = None, **options: object) -> ColumnSpec:
    """A column from a tag or a Spark type; ``options`` in snake or camel case."""
    known = {"allowNull": "allow_null", "defaultValue": "default", "default_value": "default", "readOnly": "read_only", "maxLength": "max_length", "sourceColumn": "source_column"}
    own = {known.get(k, k): v for k, v in options.items() if v is not None and k not in ("primary_key", "primaryKey", "isPrimaryKey", "type", "dataType", "name", "columnName", "sparkType")}
    spark = tags.to_spark(data_type if data_type is not None else "any")
    tag = tags.of_spark(data_type) if isinstance(data_type, T.DataType) else tags.normalize(data_type)
    if own.get("expression") is not None:
        own["read_only"] = True
    return ColumnSpec(name, spark, tag, **own)  # type: ignore[arg-type]


@dataclass(frozen=True)
class Check:
    name: str
    predicate: object  # text of the expression language, or a function of a row accessor


@dataclass(frozen=True)
class Unique:
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSchema:
    name: str = "Table"
    columns: tuple[ColumnSpec, ...] = ()
    primary_key: tuple[str, ...] = ()
    uniques: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    case_sensitive: bool = False
    enforced: bool = True  # constraints; off between the beginning and the end of a load
    handlers: Mapping[str, tuple[Callable, ...]] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        seen: dict[str, str] = {}
        for c in self.columns:
            if self.fold(c.name) in seen:
                raise SchemaMismatchError(f"columns {seen[self.fold(c.name)]!r} and {c.name!r} of table {self.name!r} have one name")
            seen[self.fold(c.name)] = c.name

    def fold(self, name: str) -> str:
        return name if self.case_sensitive else name.lower()

    def find(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if self.fold(c.name) == self.fold(name)), None)

    def __getitem__(self, name: str | int) -> ColumnSpec:
        if isinstance(name, int):
            if not 0 <= name < len(self.columns):
                raise ColumnNotFoundError(str(name), self.name)
            return self.columns[name]
        if (found := self.find(name)) is None:
            raise ColumnNotFoundError(name, self.name)
        return found

    @property
    def stored(self) -> list[ColumnSpec]:
        return [c for c in self.columns if not c.computed]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def with_column(self, spec: ColumnSpec) -> TableSchema:
        if self.find(spec.name):
            raise SchemaMismatchError(f"table {self.name!r} has a column {spec.name!r} already")
        return replace(self, columns=(*self.columns, spec))

    def without(self, name: str) -> TableSchema:
        gone = self[name].name
        if gone in self.primary_key:
            raise SchemaMismatchError(f"{gone!r} is part of the primary key of {self.name!r}")
        uniques = tuple(u for u in self.uniques if gone not in u.columns)
        return replace(self, columns=tuple(c for c in self.columns if c.name != gone), uniques=uniques)

    def with_primary_key(self, names: str | Iterable[str]) -> TableSchema:
        key = tuple(self[n].name for n in ([names] if isinstance(names, str) else names))
        columns = tuple(replace(c, allow_null=False, unique=c.unique or len(key) == 1) if c.name in key else c for c in self.columns)
        return replace(self, columns=columns, primary_key=key)

    def without_primary_key(self) -> TableSchema:
        return replace(self, primary_key=())

    # -- comparison and update -----------------------------------------------------------------------------------------

    def compare(self, other: TableSchema) -> dict:
        """What ``other`` has and this one lacks (missing), the reverse (extra), and where common columns differ."""
        common = [(c, other.find(c.name)) for c in self.columns]
        missing = [c.name for c in other.columns if not self.find(c.name)]
        extra = [c.name for c, o in common if o is None]
        kinds = [{"columnName": c.name, "thisType": c.tag, "otherType": o.tag} for c, o in common if o and c.tag != o.tag]
        nulls = [{"columnName": c.name, "thisNullable": c.allow_null, "otherNullable": o.allow_null} for c, o in common if o and c.allow_null != o.allow_null]
        return {"missingColumns": missing, "extraColumns": extra, "typeMismatches": kinds, "nullabilityMismatches": nulls, "isMatch": not (missing or extra or kinds or nulls)}

    # -- JSON ----------------------------------------------------------------------------------------------------------

    def to_dict(self) -> dict:
        single = [{"name": f"UQ_{self.name}_{c.name}", "columns": [c.name]} for c in self.columns if c.unique and c.name not in self.primary_key]
        named = [{"name": u.name, "columns": list(u.columns)} for u in self.uniques]
        columns = [c.to_dict() | {"isPrimaryKey": c.name in self.primary_key} for c in self.columns if not callable(c.expression)]
        return {"tableName": self.name, "columns": columns, "primaryKey": list(self.primary_key), "uniqueConstraints": single + named, "caseSensitive": self.case_sensitive}

    @staticmethod
    def from_dict(data: Mapping) -> TableSchema:
        columns = []
        for c in data.get("columns", ()):
            kind = T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": c["sparkType"], "nullable": True, "metadata": {}}]})["x"].dataType if c.get("sparkType") else c.get("dataType", c.get("type"))
            spec = column(c.get("name") or c["columnName"], kind, **{k: v for k, v in c.items() if k in ("caption", "expression", "unique", "allowNull", "defaultValue", "readOnly", "maxLength", "sourceColumn")})
            columns.append(replace(spec, tag=tags.normalize(c.get("dataType", c.get("type", spec.tag)))))
        key = data.get("primaryKey") or [c.get("name") or c["columnName"] for c in data.get("columns", ()) if c.get("isPrimaryKey")]
        schema = TableSchema(data.get("tableName") or data.get("name") or "Table", tuple(columns), (), (), (), bool(data.get("caseSensitive", False)))
        uniques = tuple(Unique(u["name"], tuple(u["columns"])) for u in data.get("uniqueConstraints", ()) if len(u["columns"]) > 1)
        schema = replace(schema, uniques=uniques)
        return schema.with_primary_key(key) if key else schema

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    @staticmethod
    def from_json(text: str) -> TableSchema:
        return TableSchema.from_dict(json.loads(text))
