"""The expression language and criteria over null-rich rows."""

from __future__ import annotations

import math
import re

import pytest
from tabulon import Table
from tabulon.errors import ColumnNotFoundError, SchemaMismatchError

ROWS = [(1, 1.5, "Ann", True, None), (2, None, "bob", False, 4), (3, -2.5, None, None, 0), (4, 0.0, "", True, 7)]


@pytest.fixture(scope="module")
def table(spark):
    return Table.from_df(spark.createDataFrame(ROWS, "id long, x double, s string, b boolean, n long"), "t", "id")


def ids(table, where):
    return sorted(r["id"] for r in table.where(where).frame().collect())


@pytest.mark.parametrize(
    ("where", "found"),
    [
        ("x > 0", [1]), ("x >= 0 OR n = 0", [1, 3, 4]), ("NOT (x > 0)", [2, 3, 4]), ("x = NULL", [2]), ("x != NULL", [1, 3, 4]), ("s = 'bob' AND b = false", [2]),
        ("b", [1, 4]), ("s", [1, 2]), ("n", [2, 4]), ("!b", [2, 3]), ("s < 'B'", [1, 4]), ("n != 4", [1, 3, 4]), ("id = '1'", []), ("(id > 2) OR (s = 'Ann')", [1, 3, 4]),
        ("LEN(s) = 0", [3, 4]), ("COALESCE(n, id) = 1", [1]), ("IIF(b, 1, 0) = 1", [1, 4]), ("x <> 1.5", [2, 3, 4]), ("id % 2 = 0 && id > 2", [4]),
    ],
)
def test_conditions(table, where, found):
    assert ids(table, where) == found


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("x + n", [1.5, 4.0, -2.5, 7.0]), ("x - n", [1.5, -4.0, -2.5, -7.0]), ("id * 2", [2.0, 4.0, 6.0, 8.0]), ("s + id", ["Ann1", "bob2", "3", "4"]), ("ROUND(x)", [2.0, 0.0, -2.0, 0.0]),
        ("ABS(x)", [1.5, 0.0, 2.5, 0.0]), ("UPPER(s)", ["ANN", "BOB", "", ""]), ("ISNULL(s, 'none')", ["Ann", "bob", "none", ""]), ("-id", [-1.0, -2.0, -3.0, -4.0]), ("7 % id", [0.0, 1.0, 1.0, 3.0]),
        ("-7 % 4", [-3.0] * 4), ("LEN(s)", [3, 3, 0, 0]), ("'a\\'b'", ["a'b"] * 4), ("1 + 2 * 3", [7.0] * 4), ("(1 + 2) * 3", [9.0] * 4),
    ],
)
def test_values(table, text, values):
    assert [r["v"] for r in table.add_column("v", "any", expression=text).ordered().frame().collect()] == values


def test_division_by_zero(table):
    found = [r["v"] for r in table.add_column("v", "number", expression="id / x").ordered().frame().collect()]
    assert found[0] == 1 / 1.5 and found[1] == found[3] == math.inf
    assert math.isnan(table.add_column("v", "number", expression="1 % 0").frame().first()["v"])


@pytest.mark.parametrize("text", ["FOO(x)", "x >", "(x", "x # 1", "IIF(b, 1)", "x 1"])
def test_broken_expressions(table, text):
    with pytest.raises(SchemaMismatchError):
        table.where(text)


def test_unknown_column(table):
    with pytest.raises(ColumnNotFoundError):
        table.where("nothing = 1")


def test_circular_columns(table):
    with pytest.raises((SchemaMismatchError, ColumnNotFoundError)):
        table.add_column("p", "number", expression="q + 1").add_column("q", "number", expression="p + 1").frame()


def test_criteria(table):
    assert ids(table, {"id": {"$gt": 1, "$lt": 4}}) == [2, 3]
    assert ids(table, {"n": {"$in": [4, None]}}) == [1, 2]
    assert ids(table, {"n": {"$ne": 4}}) == [1, 3, 4]
    assert ids(table, {"S": re.compile("^B", re.IGNORECASE)}) == [2]
    assert ids(table, {"s": {"$contains": "n"}}) == [1]
    assert ids(table, {"s": None}) == [3]
    assert ids(table, {}) == [1, 2, 3, 4]
    assert ids(table, lambda r: r.id > 2) == [3, 4]
    with pytest.raises(SchemaMismatchError):
        table.where({"id": {"$nope": 1}})


def test_pushdown(spark):
    t = Table.read(spark, "/root/testdata/sf0.001/lineitem.parquet")
    plan = t.select("l_quantity >= 10 AND l_returnflag = 'R'").frame().select("l_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "EqualNullSafe(l_returnflag,R)" in plan or "EqualTo(l_returnflag,R)" in plan
    assert "l_comment" not in plan.split("ReadSchema")[-1]
