"""Connected components of a link table by alternating stars, each round written to the shared folder.

Links are first thinned to a spanning forest within each partition. Then, until every vertex hangs on its smallest one:
the large star hangs the larger neighbours of each vertex on its smallest neighbour, the small star its smaller ones. Both
are a partial minimum for each vertex, which needs no gathering, and one join of the links with it; the links of a vertex with a
large share of them meet in one partition of that join, which adaptive execution splits (the thinning leaves at most one link
a vertex and partition, so a hub's links are those to distinct vertices). The driver gathers nothing but a yes or no a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Cut

LINKS = "hi long, lo long"
#: Links taken at once when a partition is thinned.
THIN_LINKS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) of all vertices but the smallest ones."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(ids))
    while True:  # hook the larger root on the smaller, then let everyone point at their root
        x, y = parent[left], parent[right]
        apart = x != y
        if not apart.any():
            break
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    below = parent != np.arange(len(ids))
    return ids[below], ids[parent[below]]


def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most one link for each vertex, of every so many links of a partition."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def out() -> pa.RecordBatch:
        hi, lo = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])

    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        held.append((a, b))
        count += len(a)
        if count >= THIN_LINKS:
            yield out()
            held, count = [], 0
    if count:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every vertex of ``links`` (its first two columns, longs); component_id is the smallest id."""
    a, b = links.columns[:2]
    pairs = links.select(F.col(a).cast("long").alias("hi"), F.col(b).cast("long").alias("lo")).where("hi <> lo")
    now = Cut(pairs.mapInArrow(thin, LINKS), "links")
    while True:
        both = now.df.union(now.df.select("lo", "hi"))
        least = both.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = now.df.join(least, "lo").select("hi", F.least("m", "lo").alias("lo")).distinct()
        large_cut = Cut(large, "links")
        now.drop()
        least = large_cut.df.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large_cut.df.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", "m")).distinct()
        )
        now = Cut(small, "links")
        large_cut.drop()
        loose = now.df.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hi")
        deep = now.df.join(now.df.select(F.col("hi").alias("lo")), "lo", "left_semi").select("hi")
        if not loose.limit(1).union(deep.limit(1)).take(1):
            break
    roots = now.df.select(F.col("lo").alias("id"), F.col("lo").alias("component_id")).distinct()
    return now.df.select(F.col("hi").alias("id"), F.col("lo").alias("component_id")).union(roots)
