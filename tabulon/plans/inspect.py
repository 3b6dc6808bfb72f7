"""What Catalyst made of a DataFrame: the nodes of its plan, for tests and for reviews of a query before it runs at scale."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

#: Nodes that run Python row by row or batch by batch, and joins that compare everything with everything.
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInArrow", "FlatMapGroupsInPandas", "PythonMapInArrow")
ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical(df: DataFrame) -> str:
    """The physical plan as text, before any adaptive change, with whole lists of filters and columns."""
    conf, name = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
    before = conf.get(name)
    conf.set(name, "100000")
    try:
        return df._jdf.queryExecution().sparkPlan().toString()
    finally:
        conf.set(name, before)


def nodes(df: DataFrame) -> Counter[str]:
    """How often each kind of node occurs in the executed plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", text, re.MULTILINE))


def exchanges(df: DataFrame) -> int:
    return nodes(df)["Exchange"]


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that reach each file scan."""
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", physical(df))


def read_columns(df: DataFrame) -> list[list[str]]:
    """The columns that each file scan reads."""
    return [re.findall(r"(\w+):", x) for x in re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", physical(df), re.MULTILINE)]


def all_pairs(df: DataFrame) -> bool:
    found = nodes(df)
    return any(found[x] for x in ALL_PAIRS)


def in_python(df: DataFrame) -> bool:
    found = nodes(df)
    return any(found[x] for x in PYTHON)
