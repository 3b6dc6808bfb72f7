"""Set-based validation: one aggregation for all row rules, one grouping for each key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import ConstraintViolationError, DuplicatePrimaryKeyError, TypeMismatchError

if TYPE_CHECKING:
    from tabulon.table import Table


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def duplicates(table: Table, names: Sequence[str], nulls_count: bool = True) -> DataFrame:
    """Keys of several rows that are not deleted. A unique constraint exempts keys with a null."""
    rows = table.live().df
    if not nulls_count:
        rows = rows.where(~_any([F.col(f"`{n}`").isNull() for n in names]))
    return rows.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def _truthy(table: Table, predicate: object) -> Column:
    return F.coalesce(table.condition(predicate), F.lit(False))


def check_violations(table: Table) -> DataFrame:
    """Rows that break a check, with the first one's name."""
    if not table.schema.checks:
        return table.live().frame().withColumn("check_name", F.lit(None).cast("string")).where(F.lit(False))
    name = F.coalesce(*[F.when(~_truthy(table, c.predicate), F.lit(c.name)) for c in table.schema.checks])
    rows = table.live()
    return rows.over(rows.df.withColumn("check_name", name).where("check_name IS NOT NULL")).df


def row_rules(table: Table, keyed: bool = True) -> list[tuple[str, type[Exception], Column]]:
    """(message, error, broken) of the rules that one row alone can break."""
    rules: list[tuple[str, type[Exception], Column]] = []
    for c in table.schema.stored:
        own = F.col(f"`{c.name}`")
        if c.name in table.schema.primary_key and not keyed:
            pass
        elif c.name in table.schema.primary_key:
            rules.append((f"primary key column {c.name!r} is null", ConstraintViolationError, own.isNull()))
        elif not c.allow_null and not table.df.schema[c.name].nullable:
            continue
        elif not c.allow_null:
            rules.append((f"column {c.name!r} takes no null", ConstraintViolationError, own.isNull()))
        if c.max_length is not None and isinstance(c.data_type, T.StringType):
            rules.append((f"column {c.name!r} holds at most {c.max_length} characters", TypeMismatchError, F.coalesce(F.length(own) > c.max_length, F.lit(False))))
    rules += [(f"check {c.name!r} does not hold", ConstraintViolationError, ~_truthy(table, c.predicate)) for c in table.schema.checks]
    return rules


def validate_rest(table: Table) -> None:
    """Validation after a merge, which leaves primary keys whole: of all other rules. Without any, nothing runs."""
    validate(table, [c.name for c in table.schema.stored if c.name not in table.schema.primary_key], keyed=False)


def validate_parts(whole: Table, kept: Table, fresh: Table) -> None:
    """Validation of a table whose ``kept`` rows held all rules before the few ``fresh`` ones came: those are looked at alone,
    their keys against the kept ones, and the whole only where there are unique constraints."""
    if not whole.schema.enforced:
        return
    validate(fresh)
    key = whole.schema.primary_key
    if key:
        names = [F.col(f"`{k}`").alias(f"__f{i}") for i, k in enumerate(key)]
        keys = fresh.live().df.select(*names)
        met = kept.live().df.join(keys, reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"__f{i}") for i, k in enumerate(key)]), "left_semi").limit(1).take(1)
        if met:
            raise DuplicatePrimaryKeyError(f"primary key of table {whole.name!r} occurs twice: {[met[0][k] for k in key]}")
    if whole.schema.uniques or any(c.unique and (c.name,) != key for c in whole.schema.stored):
        validate_rest(whole)


def validate(table: Table, only: Sequence[str] | None = None, keyed: bool = True) -> None:
    """Raises the first broken rule. ``only``: the columns that changed; keys without one of them still hold. ``keyed``:
    whether primary key columns may have become null."""
    if not table.schema.enforced:
        return
    rules = row_rules(table, keyed)
    if rules:
        broken = table.live().df.agg(*[F.coalesce(F.max(b.cast("int")), F.lit(0)).alias(f"r{i}") for i, (_, _, b) in enumerate(rules)]).first()
        for i, (message, error, _) in enumerate(rules):
            if broken[f"r{i}"]:
                raise error(f"{message} in table {table.name!r}")
    key = table.schema.primary_key
    keys = [(key, DuplicatePrimaryKeyError, "primary key", True)] if key else []
    keys += [((c.name,), ConstraintViolationError, f"unique column {c.name!r}", False) for c in table.schema.stored if c.unique and (c.name,) != key]
    keys += [(u.columns, ConstraintViolationError, f"unique constraint {u.name!r}", False) for u in table.schema.uniques]
    for names, error, what, nulls in keys:
        if only is not None and not set(names) & set(only):
            continue
        found = duplicates(table, names, nulls).limit(1).take(1)
        if found:
            raise error(f"{what} of table {table.name!r} occurs {found[0]['n_rows']} times: {[found[0][n] for n in names]}")
