"""Type tags, their lattice, provider type maps, and their Spark types."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections.abc import Iterable, Mapping

from pyspark.sql import types as T

TAGS = ("string", "number", "integer", "bigint", "boolean", "date", "json", "object", "array", "buffer", "any")

# Names that drivers and people use for a tag.
ALIASES = {
    "bool": "boolean", "int": "integer", "int2": "integer", "int4": "integer", "int8": "bigint", "long": "bigint",
    "double": "number", "decimal": "number", "numeric": "number", "float": "number", "datetime": "date",
    "timestamp": "date", "timestamptz": "date", "varchar": "string", "nvarchar": "string", "text": "string",
    "char": "string", "blob": "buffer", "bytea": "buffer",
}
# Own additions.
MORE_ALIASES = {"smallint": "integer", "tinyint": "integer", "real": "number", "binary": "buffer"}

# PostgreSQL type OIDs.
POSTGRES = {
    16: "boolean", 17: "buffer", 18: "string", 20: "bigint", 21: "integer", 23: "integer", 25: "string",
    700: "number", 701: "number", 1042: "string", 1043: "string", 1082: "date", 1114: "date", 1184: "date",
    114: "json", 1700: "number", 2950: "string", 3802: "json",
}

# MySQL protocol column type codes.
MYSQL = {
    0: "number", 1: "integer", 2: "integer", 3: "integer", 4: "number", 5: "number", 6: "null", 7: "date",
    8: "bigint", 9: "integer", 10: "date", 11: "string", 12: "date", 13: "integer", 14: "date", 15: "string",
    16: "buffer", 245: "json", 246: "number", 247: "string", 248: "string", 249: "buffer", 250: "buffer",
    251: "buffer", 252: "buffer", 253: "string", 254: "string", 255: "object",
}

# SQL Server type names.
SQL_SERVER = {
    "bigint": "bigint", "binary": "buffer", "bit": "boolean", "char": "string", "date": "date",
    "datetime": "date", "datetime2": "date", "datetimeoffset": "date", "decimal": "number", "float": "number",
    "image": "buffer", "int": "integer", "money": "number", "nchar": "string", "ntext": "string",
    "numeric": "number", "nvarchar": "string", "real": "number", "smalldatetime": "date", "smallint": "integer",
    "smallmoney": "number", "text": "string", "time": "string", "timestamp": "buffer", "tinyint": "integer",
    "uniqueidentifier": "string", "varbinary": "buffer", "varchar": "string", "xml": "string",
}

# What a SQLite or Oracle type name contains, tried in this order.
SQLITE = (
    ("integer", "integer"), ("int", "integer"), ("real", "number"), ("double", "number"), ("float", "number"),
    ("numeric", "number"), ("decimal", "number"), ("text", "string"), ("varchar", "string"), ("char", "string"),
    ("clob", "string"), ("blob", "buffer"), ("boolean", "boolean"), ("date", "date"), ("datetime", "date"), ("json", "json"),
)
ORACLE = (
    ("bfile", "buffer"), ("binary_double", "number"), ("binary_float", "number"), ("blob", "buffer"), ("char", "string"),
    ("clob", "string"), ("date", "date"), ("float", "number"), ("integer", "integer"), ("json", "json"), ("long", "string"),
    ("nchar", "string"), ("nclob", "string"), ("number", "number"), ("nvarchar2", "string"), ("raw", "buffer"),
    ("rowid", "string"), ("timestamp", "date"), ("varchar", "string"), ("varchar2", "string"),
)

PROVIDERS = {
    "pg": "postgres", "postgres": "postgres", "postgresql": "postgres", "postgres.js": "postgres",
    "mysql": "mysql", "mysql2": "mysql", "mariadb": "mysql",
    "mssql": "mssql", "sqlserver": "mssql", "tedious": "mssql",
    "sqlite": "sqlite", "sqlite3": "sqlite", "better-sqlite3": "sqlite",
    "oracle": "oracle", "oracledb": "oracle",
}


def normalize(tag: object) -> str:
    """A tag for any spelling; unknown names stay as they are, in lower case."""
    if tag is None:
        return "any"
    name = str(tag).strip().lower()
    return ALIASES.get(name) or MORE_ALIASES.get(name, name)


def of_value(value: object) -> str:
    """The tag of a runtime value; a whole float counts as integer."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if abs(value) < 2**53 else "bigint"
    if isinstance(value, float):
        return "integer" if value.is_integer() and abs(value) < 2**53 else "number"
    if isinstance(value, decimal.Decimal):
        return "number"
    if isinstance(value, (dt.datetime, dt.date)):
        return "date"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray, memoryview)):
        return "buffer"
    if isinstance(value, (list, tuple, set)):
        return "array"
    return "object"


def reconcile(tags: Iterable[str | None]) -> str:
    """The one tag for values of several."""
    kinds = {normalize(t) for t in tags if t not in (None, "null", "undefined")}
    if len(kinds) == 1:
        return kinds.pop()
    if kinds == {"integer", "number"}:
        return "number"
    if kinds == {"object", "json"}:
        return "json"
    return "any"


def from_postgres(oid: object) -> str:
    return POSTGRES.get(_number(oid), "any")


def from_mysql(code: object, metadata: Mapping | None = None, tiny_int_one_is_boolean: bool = True) -> str:
    metadata = metadata or {}
    length = metadata.get("columnLength", metadata.get("length"))
    if _number(code) == 1 and length == 1 and tiny_int_one_is_boolean:
        return "boolean"
    return MYSQL.get(_number(code), "any")


def from_sql_server(name: object) -> str:
    return SQL_SERVER.get(_type_name(name), "any")


def from_sqlite(name: object) -> str:
    return next((tag for part, tag in SQLITE if part in _type_name(name)), "any")


def from_oracle(name: object) -> str:
    return next((tag for part, tag in ORACLE if part in _type_name(name)), "any")


def from_database(kind: object, provider: str | None = None, metadata: Mapping | None = None, tiny_int_one_is_boolean: bool = True) -> str:
    """The tag of a driver's type; without a provider the shape of the metadata decides."""
    metadata = metadata or {}
    known = PROVIDERS.get((provider or "").lower())
    if known is None:
        known = "postgres" if "dataTypeID" in metadata else "mysql" if "columnType" in metadata else "oracle" if "dbTypeName" in metadata else None
    if known == "postgres":
        return from_postgres(kind)
    if known == "mysql":
        return from_mysql(kind, metadata, tiny_int_one_is_boolean)
    if known == "mssql":
        return from_sql_server(kind)
    if known == "sqlite":
        return from_sqlite(kind)
    if known == "oracle":
        return from_oracle(kind)
    tag = normalize(kind)
    return tag if tag in TAGS else "any"


def _type_name(name: object) -> str:
    if not isinstance(name, str):
        name = getattr(name, "__name__", None) or getattr(name, "name", None) or (name.get("name") if isinstance(name, Mapping) else name) or ""
    return str(name).strip().lower()


def _number(code: object) -> int:
    try:
        return int(code)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return -1


# -- Spark types -------------------------------------------------------------------------------------------------------

_SPARK = {
    "string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "bigint": T.DecimalType(38, 0), "boolean": T.BooleanType(),
    "date": T.TimestampType(), "json": T.StringType(), "object": T.MapType(T.StringType(), T.StringType()), "array": T.ArrayType(T.StringType()),
    "buffer": T.BinaryType(), "any": T.StringType(), "null": T.StringType(),
}


def to_spark(tag: str | T.DataType) -> T.DataType:
    """The Spark type of a tag. ``json`` and ``any`` are kept as text (groupable, sortable); Spark types pass through."""
    if isinstance(tag, T.DataType):
        return tag
    name = normalize(tag)
    if name not in _SPARK:
        from tabulon.errors import SchemaMismatchError

        raise SchemaMismatchError(f"unknown type {tag!r}")
    return _SPARK[name]


def of_spark(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, T.DecimalType):
        return "bigint" if kind.scale == 0 else "number"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.BinaryType):
        return "buffer"
    if isinstance(kind, T.VariantType):
        return "json"
    return "any"


TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def convert(value: object, tag: str, strict: bool = False) -> object:
    """A driver-side value in a tag's type. What does not fit raises TypeMismatchError if strict, else stays as it is."""
    from tabulon.errors import TypeMismatchError

    if value is None:
        return None
    tag = normalize(tag)
    try:
        if tag == "number":
            if isinstance(value, bool) or isinstance(value, str) and not value.strip():
                raise ValueError(value)
            found = float(value)  # type: ignore[arg-type]
            if math.isnan(found) and not (isinstance(value, float) and math.isnan(value)):
                raise ValueError(value)
            return found
        if tag == "integer":
            if isinstance(value, bool) or isinstance(value, str) and not value.strip():
                raise ValueError(value)
            found = float(value) if not isinstance(value, int) else value  # type: ignore[arg-type]
            if found != int(found):
                raise ValueError(value)
            return int(found)
        if tag == "bigint":
            return decimal.Decimal(int(value))  # type: ignore[call-overload]
        if tag == "boolean":
            if isinstance(value, bool):
                return value
            if isinstance(value, (int, float)):
                return value != 0
            text = str(value).strip().lower()
            if text in TRUE or text in FALSE:
                return text in TRUE
            raise ValueError(value)
        if tag == "date":
            if isinstance(value, dt.datetime):
                return value
            if isinstance(value, dt.date):
                return dt.datetime(value.year, value.month, value.day, tzinfo=dt.UTC)
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                return dt.datetime.fromtimestamp(value / 1000, dt.UTC)
            found = dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
            return found if found.tzinfo else found.replace(tzinfo=dt.UTC)
        if tag == "string":
            return text_of(value)
        if tag in ("json", "any"):
            import json

            if tag == "json" and isinstance(value, str):
                json.loads(value)
                return value
            return value if isinstance(value, str) else json.dumps(value, default=str, separators=(",", ":"))
        if tag == "object":
            if not isinstance(value, Mapping):
                raise ValueError(value)
            return value
        if tag == "array":
            if not isinstance(value, (list, tuple)):
                raise ValueError(value)
            return list(value)
        if tag == "buffer":
            return value.encode() if isinstance(value, str) else bytes(value)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError, decimal.InvalidOperation) as e:
        if strict:
            raise TypeMismatchError(f"{value!r} is no {tag}") from e
        raise TypeMismatchError(f"{value!r} is no {tag}") from e
    return value


def text_of(value: object) -> str:
    """A value as text: whole floats without a fraction, booleans in lower case, instants in ISO form."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, dt.datetime):
        utc = value.astimezone(dt.UTC) if value.tzinfo else value
        return utc.strftime("%Y-%m-%dT%H:%M:%S.") + f"{utc.microsecond // 1000:03d}Z"
    return str(value)
