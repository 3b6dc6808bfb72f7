"""Relational operators as Catalyst plans: aggregates, grouping, joins, distinct, union, sorts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.errors import SchemaMismatchError
from tabulon.functions.expressions import Typed, kind_of, tokenize
from tabulon.schema import TableSchema, column

if TYPE_CHECKING:
    from tabulon.table import Table

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def aggregate(name: str, value: Typed | None, empty_sum_is_zero: bool = False) -> Column:
    """COUNT counts rows without a column and non-null values with one. Text has dictionary order."""
    name = name.upper()
    if name not in AGGREGATES:
        raise SchemaMismatchError(f"unknown aggregate {name}")
    if name == "COUNT":
        return F.count(F.lit(1) if value is None else value.column)
    if value is None:
        raise SchemaMismatchError(f"{name} needs a column")
    if name == "SUM":
        total = F.sum(value.column.cast("double"))
        return F.coalesce(total, F.lit(0.0)) if empty_sum_is_zero else total
    if name == "AVG":
        return F.avg(value.column.cast("double"))
    if value.kind == "string":
        by = F.when(value.column.isNotNull(), F.collation_key(value.column)) if hasattr(F, "collation_key") else F.collate(value.column, "UNICODE")
        return F.min_by(value.column, by) if name == "MIN" else F.max_by(value.column, by)
    return F.min(value.column) if name == "MIN" else F.max(value.column)


def compute(table: Table, expression: str, where: object = None) -> object:
    """One aggregate over the rows that are not deleted; a scalar."""
    kinds, parts = zip(*tokenize(expression), strict=True) if expression.strip() else ((), ())
    if len(parts) != 4 or kinds[0] != "name" or parts[0].upper() not in AGGREGATES or (parts[1], parts[3]) != ("(", ")") or kinds[2] != "name" and parts[2] != "*":
        raise SchemaMismatchError(f"{expression!r} is no aggregate")
    rows = table.live().frame(where)
    value = None if parts[2] == "*" else table.resolve(parts[2])
    return rows.agg(aggregate(parts[0], value).alias("value")).first()[0]


def group_by(table: Table, keys: object, aggregations: Mapping[str, Mapping | str] | None = None) -> DataFrame:
    """A frame of keys and aggregates; null is a group; without keys one row if there are rows."""
    keys = [keys] if isinstance(keys, str) or callable(keys) else list(keys or ())  # type: ignore[arg-type]
    names, columns = [], []
    for place, key in enumerate(keys):
        if callable(key):
            names.append(f"key{place}")
            columns.append(key(table.accessor()))
        else:
            names.append(table.schema[key].name)
            columns.append(table.resolve(key).column)
    out = []
    for name, spec in (aggregations or {"count": {"fn": "COUNT"}}).items():
        spec = {"fn": spec} if isinstance(spec, str) else spec
        fn = spec.get("fn") or spec.get("function") or spec.get("aggregate") or "COUNT"
        target = spec.get("column") or spec.get("arg")
        value = None if target in (None, "*") else table.resolve(target)
        out.append(aggregate(fn, value, empty_sum_is_zero=True).alias(name))
    rows = table.live().frame()
    if not columns:
        return rows.agg(F.count(F.lit(1)).alias("__rows"), *out).where("__rows > 0").drop("__rows")
    return rows.groupBy(*[c.alias(n) for c, n in zip(columns, names, strict=True)]).agg(*out)


def join(
    left: Table, right: Table, on: str | Sequence[str] | None = None, left_key: object = None, right_key: object = None, how: str = "inner",
    select: Callable | None = None, table_name: str | None = None, primary_key: object = None,
) -> Table:
    """An equi-join in which null keys match. Of equal names the right value wins, in the left place; a left row without a
    partner keeps its own. ``select(left, right)`` maps names to columns instead."""
    how = how.lower()
    if how not in ("inner", "left"):
        raise SchemaMismatchError(f"unknown join type {how!r}")
    lk, rk = (left_key if left_key is not None else on), (right_key if right_key is not None else on)
    if lk is None or rk is None:
        raise SchemaMismatchError("a join needs keys")

    def keys(table: Table, key: object, prefix: str) -> list[Typed]:
        def one(k: object) -> list[Typed]:
            if callable(k):
                found = k(table.accessor(prefix))
                return [Typed(c, "other") for c in (found if isinstance(found, (list, tuple)) else [found])]
            return [table.resolve(k, prefix)]  # type: ignore[arg-type]

        return [t for k in ([key] if isinstance(key, str) or callable(key) else key) for t in one(k)]  # type: ignore[union-attr]

    a, b = left.live().stored_frame().alias("l"), right.live().stored_frame().withColumn("__hit", F.lit(True)).alias("r")
    pairs = list(zip(keys(left, lk, "l."), keys(right, rk, "r."), strict=True))
    for x, y in pairs:
        if x.kind != y.kind and "other" not in (x.kind, y.kind):
            raise SchemaMismatchError(f"join keys of kinds {x.kind} and {y.kind} never match")
    joined = a.join(b, reduce(lambda p, q: p & q, [x.column.eqNullSafe(y.column) for x, y in pairs]), how)
    if select is not None:
        chosen = select(left.accessor("l."), right.accessor("r."))
        from tabulon.table import Table

        return Table.from_df(joined.select(*[c.alias(n) for n, c in chosen.items()]), table_name or f"{left.name}_{right.name}", primary_key, case_sensitive=left.schema.case_sensitive)
    columns, specs = [], []
    for c in left.schema.stored:
        other = right.schema.find(c.name)
        if other is None or other.computed:
            columns.append(F.col(f"l.`{c.name}`").alias(c.name))
            specs.append(c)
        else:
            own = F.col(f"r.`{other.name}`")
            columns.append((own if how == "inner" else F.when(F.col("r.__hit"), own).otherwise(F.col(f"l.`{c.name}`"))).alias(c.name))
            specs.append(replace(other, name=c.name))
    for c in right.schema.stored:
        if not (mine := left.schema.find(c.name)) or mine.computed:
            columns.append(F.col(f"r.`{c.name}`").alias(c.name))
            specs.append(c)
    plain = tuple(replace(s, unique=False, allow_null=True, read_only=False) for s in specs)
    schema = TableSchema(table_name or f"{left.name}_{right.name}", plain, case_sensitive=left.schema.case_sensitive)
    out = left.over(joined.select(*columns), schema, tracked=False)
    return out.set_primary_key(primary_key) if primary_key else out


def distinct(table: Table, names: str | Sequence[str], order_by: Sequence[str] | None = None, table_name: str | None = None) -> Table:
    """The first whole row of each key: by insertion where the table knows it, else by ``order_by``, the primary key, or all
    columns. The rows of a key meet as a partial minimum, so no group is gathered."""
    keys = [table.schema[n].name for n in ([names] if isinstance(names, str) else names)]
    rows, stored = table.live(), [c.name for c in table.schema.stored]
    order = [F.col(f"`{table.schema[c].name}`") for c in order_by] if order_by else rows.order_columns() or [F.col(f"`{c}`") for c in stored]
    rank = F.struct(*[F.struct(c.isNull().alias("n"), c.alias("v")).alias(f"o{i}") for i, c in enumerate(order)])
    found = rows.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.df.columns]), rank).alias("first"))
    schema = replace(table.schema, name=table_name or f"{table.name}_distinct", columns=tuple(table.schema.stored))
    return table.over(found.select("first.*"), schema, tracked=table.tracked)


def union(left: Table, right: Table, table_name: str | None = None, primary_key: object = None, validate: bool = True) -> Table:
    """All rows of both by column name; columns that only the right table has are null on the left."""
    missing = [c.name for c in left.schema.stored if not (o := right.schema.find(c.name)) or o.computed]
    if missing:
        raise SchemaMismatchError(f"union: table {right.name!r} lacks {missing}")
    mine = left.live().stored_frame()
    names = {right.schema[c.name].name: c.name for c in left.schema.stored}
    other = right.live().stored_frame().withColumnsRenamed(names)
    extra = [replace(c, allow_null=True) for c in right.schema.stored if not left.schema.find(c.name)]
    schema = replace(left.schema, name=table_name or f"{left.name}_{right.name}", columns=(*left.schema.stored, *extra))
    out = left.over(mine.unionByName(other, allowMissingColumns=True), schema, tracked=False)
    if primary_key is not None:
        out = out.set_primary_key(primary_key, validate) if primary_key else out.clear_primary_key()
    elif schema.primary_key and validate:
        out.validate()
    return out


# -- sorts ---------------------------------------------------------------------------------------------------------------


def descending(order: str | None) -> bool:
    name = (order or "asc").strip().lower()
    if name not in ("asc", "desc"):
        raise SchemaMismatchError(f"unknown sort order {order!r}")
    return name == "desc"


def sort_key(value: Typed, down: bool, nulls_first_when_down: bool = False, dictionary: bool = True) -> Column:
    by = F.collate(value.column, "UNICODE") if value.kind == "string" and dictionary else value.column
    if down:
        return by.desc_nulls_first() if nulls_first_when_down else by.desc_nulls_last()
    return by.asc_nulls_last()


def parse_sort(text: str) -> list[tuple[str, str]]:
    """``"a ASC, b DESC"``."""
    out = []
    for part in text.split(","):
        words = part.split()
        if not words or len(words) > 2:
            raise SchemaMismatchError(f"no sort: {text!r}")
        out.append((words[0], words[1] if len(words) > 1 else "asc"))
    return out


__all__ = ["AGGREGATES", "aggregate", "column", "compute", "distinct", "group_by", "join", "parse_sort", "sort_key", "union"]
