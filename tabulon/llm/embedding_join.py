"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits recursively at the mean of a random projection; vectors within a margin of the split go to both sides,
so a close pair is parted only if both ends lie farther than the margin from the cut. Large leaves are split over the whole
table (two sums for each leaf are all the driver sees), those that fit a task inside one task, down to leaves in which all
vectors are compared by matrix products in double precision. A pair that meets in several leaves counts in the smallest
common leaf only, so link counts are plain sums and no table of pairs exists; each leaf hands on a spanning forest of its
links for the union. A leaf that does not shrink (a dense group) is compared block by block in as many tasks as it needs.

Identical vectors are one class with a multiplicity; their copies are never expanded into pairs.

The search is approximate: a pair may be parted in all trees. Tests measure the recall against brute force; no pair below
the threshold is ever linked. Defined results: a vector that is null, empty, zero, or holds null or non-finite components
links with nothing and is its own component; vectors of different lengths never link. Extra columns are ignored. Rows that
repeat an id are vectors each. A row with a null id links with nothing, has no component and is not kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import Cut, tidy
from tabulon.llm.components import components, forest

TREES = 6
#: Leaves up to this size are split on within one task, larger ones over the whole table; vectors, and bytes of them.
TASK_VECTORS, TASK_BYTES = 16_384, 32 << 20
#: All vectors of a leaf are compared; long vectors have smaller leaves.
LEAF_VECTORS, LEAF_BYTES = 1_024, 4 << 20
#: A leaf of more vectors than this is compared in blocks, each pair of blocks by itself.
BLOCK_VECTORS, BLOCK_BYTES = 4_096, 16 << 20
#: A child with more than this share of its parent means the parent is dense and stays whole.
DENSE = 0.9
#: Margin of a split, in standard deviations of a random projection of a pair just at the threshold.
MARGIN = 0.3
#: Leaves whose split points are sent to all tasks at most; beyond, leaves are split inside tasks.
MOST_SPLITS = 1_000_000
NEAR = 1e-9


def _seed(*parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") >> 1


def _direction(leaf: int, size: int) -> np.ndarray:
    x = np.random.Generator(np.random.PCG64(leaf)).standard_normal(size)
    return x / math.sqrt(float(x @ x))


def margin(threshold: float, size: int) -> float:
    return MARGIN * math.sqrt(2 - 2 * threshold) / math.sqrt(size)


def _valid(vector: list | None) -> bool:
    """Whether a vector has a direction."""
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def _prepare(kind: str):
    """Vectors packed as they are, in numbers of ``kind``, with a digest of their values; null where they link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, digests = [], []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                vector = value.as_py()
                fits = key.is_valid and _valid(vector)
                packed.append(np.array(vector, kind).tobytes() if fits else None)
                digests.append(hashlib.blake2b((np.array(vector, np.float64) + 0.0).tobytes(), digest_size=16).digest() if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "digest", "packed"])

    return run


def _units(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors of one length as rows of length one, in double precision."""
    x = _matrix(column, kind).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _small(kind: str):
    """Units in single precision, which is enough to find leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, batch in _by_length(whole, 1):
                small = [x.tobytes() for x in _units(batch.column(1), kind).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary()), batch.column(2)], names=["cid", "small", "leaves"])

    return run


def _matrix(column: pa.Array, kind: type | str = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=kind).reshape(len(column), -1)


def _roots(trees: int):
    """A leaf for each tree, by the vectors' length alone."""
    length = F.length("packed")
    return F.array(*[F.xxhash64(F.lit(t), length).bitwiseAND(F.lit(2**63 - 1)) for t in range(trees)])


def _child(leaf: int, side: int) -> int:
    return _seed(leaf, side)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(numbers in a vector, if they are single, and the rows with vectors of that length)."""
    lengths = np.array([len(x.as_py()) // 4 for x in batch.column(column)])
    for size in np.unique(lengths):
        yield int(size), batch.filter(pa.array(lengths == size))


def _leaf_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, vectors, sum of projections, numbers in a vector) of a task."""
    sums: dict[int, list[float]] = {}
    for whole in batches:
        for size, batch in _by_length(whole, 0):
            x, leaves = _matrix(batch.column(0), np.float32), batch.column(1)
            ends = np.asarray(leaves.offsets)
            rows, flat = np.repeat(np.arange(len(x)), np.diff(ends)), leaves.flatten().to_numpy(zero_copy_only=False)
            for leaf in np.unique(flat):
                own = x[rows[flat == leaf]] @ _direction(int(leaf), size)
                held = sums.setdefault(int(leaf), [0, 0.0, size])
                held[0] += len(own)
                held[1] += float(own.sum())
    if sums:
        columns = [pa.array(list(sums), pa.int64()), *(pa.array([v[i] for v in sums.values()], k) for i, k in enumerate((pa.int64(), pa.float64(), pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["leaf", "n", "total", "size"])


def _split(threshold: float, splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = splits.value
        for whole in batches:
            for size, batch in _by_length(whole, 1):
                x, leaves, width = _matrix(batch.column(1), np.float32), batch.column(2).to_pylist(), margin(threshold, size)
                out = []
                for row, own in zip(x, leaves, strict=True):
                    new = []
                    for leaf in own:
                        if leaf not in means:
                            new.append(leaf)
                            continue
                        at = float(row @ _cached_direction(leaf, size)) - means[leaf]
                        if at <= width:
                            new.append(_child(leaf, 0))
                        if at >= -width:
                            new.append(_child(leaf, 1))
                    out.append(new)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], names=["cid", "small", "leaves"])

    return run


_directions: dict[tuple[int, int], np.ndarray] = {}


def _cached_direction(leaf: int, size: int) -> np.ndarray:
    if (leaf, size) not in _directions:
        if len(_directions) > 4096:
            _directions.clear()
        _directions[leaf, size] = _direction(leaf, size)
    return _directions[leaf, size]


def _leaves_within(x: np.ndarray, leaf: int, width: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of the leaves below, by the same recursive splits."""
    todo = [(leaf, np.arange(len(x)), 0)]
    most = max(32, min(LEAF_VECTORS, LEAF_BYTES // (8 * x.shape[1])))
    while todo:
        leaf, rows, misses = todo.pop()
        if len(rows) <= most or misses > 2:
            yield leaf, rows
            continue
        at = x[rows] @ _direction(leaf, x.shape[1]).astype(x.dtype)
        at -= at.mean()
        sides = rows[at <= width], rows[at >= -width]
        if max(map(len, sides)) > DENSE * len(rows):  # another direction may part it; a few tries, then it stays whole
            todo.append((_seed(leaf, 2), rows, misses + 1))
        else:
            todo += [(_child(leaf, side), part, misses) for side, part in enumerate(sides) if len(part)]


def _assign(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table["small"].combine_chunks(), np.float32)
        cids = table["cid"].to_numpy()
        out = [(np.full(len(rows), leaf, np.int64), cids[rows]) for leaf, rows in _leaves_within(x, table["leaf"][0].as_py(), margin(threshold, x.shape[1]))]
        return pa.table({"cid": pa.array(np.concatenate([c for _, c in out])), "leaf": pa.array(np.concatenate([v for v, _ in out]))})

    return run


def _compare(threshold: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        leaf, low, high = (table[c][0].as_py() for c in ("leaf", "low", "high"))
        order = np.argsort(table["cid"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        x, cids, copies, blocks = _units(table["packed"].combine_chunks(), kind), table["cid"].to_numpy(), table["copies"].to_numpy(), table["block"].to_numpy()
        # leaves before this one in which two members may have met already, as bits
        lists = table["leaves"].combine_chunks()
        rows, flat = np.repeat(np.arange(len(x)), np.diff(np.asarray(lists.offsets))), lists.flatten().to_numpy(zero_copy_only=False)
        before = flat < leaf
        names, place = np.unique(flat[before], return_inverse=True)
        bits = np.zeros((len(x), len(names) // 64 + 1), dtype=np.uint64)
        np.bitwise_or.at(bits, (rows[before], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))

        links = np.zeros(len(x), dtype=np.int64)
        hi, lo = [], []
        for start in range(0, len(x), 1024):
            products = x[start : start + 1024] @ x.T
            i, j = np.nonzero(products >= threshold - NEAR)
            i, g = i + start, products[i, j]
            keep = i < j
            if low != high:
                keep &= blocks[i] != blocks[j]
            i, j, g = i[keep], j[keep], g[keep]
            for at in np.nonzero(np.abs(g - threshold) < NEAR)[0]:
                g[at] = math.fsum(x[i[at]] * x[j[at]])
            keep = g >= threshold
            i, j = i[keep], j[keep]
            for a in range(0, len(i), 200_000):
                p, q = i[a : a + 200_000], j[a : a + 200_000]
                first = np.ones(len(p), dtype=bool)
                for word in range(bits.shape[1]):
                    first &= bits[p, word] & bits[q, word] == 0
                p, q = p[first], q[first]
                links += np.bincount(p, weights=copies[q], minlength=len(x)).astype(np.int64)
                links += np.bincount(q, weights=copies[p], minlength=len(x)).astype(np.int64)
                if len(p):
                    h, r = forest(cids[p], cids[q])
                    hi.append(h)
                    lo.append(r)
        if hi:
            h, r = forest(np.concatenate(hi), np.concatenate(lo))
        else:
            h = r = np.array([], np.int64)
        some = links > 0
        a, b, n = np.concatenate((cids[some], h)), np.concatenate((np.zeros(some.sum(), np.int64), r)), np.concatenate((links[some], np.zeros(len(h), np.int64)))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=np.arange(len(a)) < some.sum()), "links": pa.array(n, pa.int64())})

    return run


FOREST = "cid long, small binary, leaves array<long>"


def near_vectors(df: DataFrame, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding", trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs with cosine >= threshold."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    element = df.schema[column].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"  # single numbers travel as such, all cosines are double
    prepared = Cut(rows.mapInArrow(_prepare(kind), "vec_id long, digest binary, packed binary"), "vectors")
    valid = prepared.df.where("digest IS NOT NULL")
    # equal vectors are one class: a number, its smallest id, how often it occurs, and one of its (equal) vectors
    classes = valid.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("packed").alias("packed"))
    classes = Cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    now = Cut(classes.df.select("cid", "packed", _roots(trees).alias("leaves")).mapInArrow(_small(kind), FOREST), "forest")

    parents: dict[int, int] = {}  # of leaves that a split made: the vectors of their parent
    dense: set[int] = set()
    while True:
        sums = now.df.select("small", "leaves").mapInArrow(_leaf_sums, "leaf long, n long, total double, size long")
        sums = sums.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("size").alias("size"))
        large = sums.where(f"n > {TASK_VECTORS} OR n * size * 8 > {TASK_BYTES}").orderBy(F.desc("n"), "leaf").limit(MOST_SPLITS)
        with tidy(spark):
            found = large.collect()
        dense |= {r["leaf"] for r in found if r["n"] > DENSE * parents.get(r["leaf"], math.inf)}
        means = {r["leaf"]: r["total"] / r["n"] for r in found if r["leaf"] not in dense}
        if not means:
            break
        parents |= {_child(r["leaf"], side): r["n"] for r in found if r["leaf"] in means for side in (0, 1)}
        split = Cut(now.df.mapInArrow(_split(threshold, spark.sparkContext.broadcast(means)), FOREST), "forest")
        now.drop()
        now = split

    placed = now.df.select("cid", "small", F.explode("leaves").alias("leaf"))
    whole = F.broadcast(spark.createDataFrame([(x,) for x in dense], "leaf long"))  # of the leaves split over the whole table
    within = placed.join(whole, "leaf", "left_anti").groupBy("leaf").applyInArrow(_assign(threshold), "cid long, leaf long")
    kept = placed.select("cid", "leaf").join(whole, "leaf", "left_semi").select("cid", "leaf")
    lists = Cut(within.union(kept).groupBy("cid").agg(F.collect_set("leaf").alias("leaves")), "leaves")
    now.drop()
    final = classes.df.select("cid", "packed", "copies").join(lists.df, "cid").select("cid", "packed", "copies", "leaves")
    spread = final.withColumn("leaf", F.explode("leaves"))
    counts = lists.df.join(classes.df.select("cid", F.length("packed").alias("size")), "cid").select(F.explode("leaves").alias("leaf"), "size")
    counts = counts.groupBy("leaf").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_VECTORS, F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    spread = spread.join(counts, "leaf").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "copies", "packed", "leaves"
    )
    found = Cut(met.groupBy("leaf", "low", "high").applyInArrow(_compare(threshold, kind), "a long, b long, links long"), "compared")
    lists.drop()
    numbers = found.df.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    parts = components(found.df.where("b IS NOT NULL").select("a", "b"))
    named = classes.df.select("cid", "digest", "rep", "copies").join(numbers, "cid", "left").join(parts.withColumnRenamed("id", "cid"), "cid", "left")
    named = Cut(named.select("digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "cid").alias("part")), "named")
    smallest = named.df.groupBy("part").agg(F.min("rep").alias("component_id"))
    known = valid.select("vec_id", "digest").join(named.df.join(smallest, "part").select("digest", "n_links", "component_id"), "digest").select("vec_id", "n_links", "component_id")
    alone = prepared.df.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
