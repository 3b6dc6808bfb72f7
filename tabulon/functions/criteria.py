"""Criteria objects and single comparisons as Catalyst conditions."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import SchemaMismatchError
from tabulon.functions.expressions import Typed, as_text, equal

#: Operator spellings by meaning.
OPERATORS = {
    "=": "eq", "==": "eq", "===": "eq", "$eq": "eq", "!=": "ne", "!==": "ne", "<>": "ne", "$ne": "ne",
    ">": "gt", "$gt": "gt", ">=": "gte", "$gte": "gte", "<": "lt", "$lt": "lt", "<=": "lte", "$lte": "lte",
    "in": "in", "$in": "in", "contains": "contains", "$contains": "contains", "startswith": "startswith", "endswith": "endswith",
}


def literal(value: object) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "boolean", True)
    if isinstance(value, str):
        return Typed(F.lit(value), "string")
    if isinstance(value, (dt.datetime, dt.date)):
        return Typed(F.lit(value), "date")
    return Typed(F.lit(value), "number")


def compare(column: Typed, op: str, value: object) -> Column:
    """A condition for a WHERE; null is no match, but for equality, which is null-safe."""
    name = OPERATORS.get(op.lower().strip())
    if name is None:
        raise SchemaMismatchError(f"unknown operator {op!r}")
    if name == "eq":
        return equal(column, literal(value))
    if name == "ne":
        return ~equal(column, literal(value))
    if name == "in":
        if not isinstance(value, (list, tuple, set, frozenset)):
            return F.lit(False)
        held = [v for v in value if v is not None]
        found = column.column.isin(*held) if held else F.lit(False)
        return found | column.column.isNull() if len(held) < len(value) else found
    if name == "contains":
        return F.when(column.column.isNull(), F.lit("null")).otherwise(as_text(column)).contains(str(value)) if column.kind != "string" else column.column.contains(str(value))
    if name in ("startswith", "endswith"):
        text = column.column if column.kind == "string" else as_text(column)
        return text.startswith(str(value)) if name == "startswith" else text.endswith(str(value))
    found = literal(value)
    a, b = column.column, found.column
    if column.kind == "date" and found.kind == "string":
        b = b.cast("timestamp")
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[name]


def matches(column: Typed, wanted: object) -> Column:
    """One entry of a criteria object: a literal, a pattern, or operators that must all hold."""
    if isinstance(wanted, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.IGNORECASE), ("s", re.DOTALL), ("m", re.MULTILINE)) if wanted.flags & bit)
        text = column.column if column.kind == "string" else as_text(column)
        return F.coalesce(text.rlike((f"(?{flags})" if flags else "") + wanted.pattern), F.lit(False))
    if isinstance(wanted, Mapping):
        if not wanted:
            raise SchemaMismatchError("empty criteria for a column")
        return reduce(lambda a, b: a & b, [compare(column, str(op), v) for op, v in wanted.items()])
    return equal(column, literal(wanted))


def criteria(wanted: Mapping[str, object], resolve: Callable[[str], Typed]) -> Column:
    """All entries must hold; an empty object matches every row."""
    return reduce(lambda a, b: a & b, [matches(resolve(name), value) for name, value in wanted.items()], F.lit(True)) if wanted else F.lit(True)
