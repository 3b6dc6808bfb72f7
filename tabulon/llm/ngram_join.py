"""Near-duplicate documents by an exact Jaccard join of word n-gram sets.

All-pairs search with rare-first prefix filtering. Every shingle is counted over all documents in a table of fixed size;
ordering a document's shingles by that count (then by hash) is one global order, and two sets that reach the threshold
must share one of their first ``n - ceil(t n) + 1`` shingles. Only those prefixes are joined. Candidates pass

* the length filter: t * longer <= shorter,
* the positional filter: what stands behind the shared shingle must still be able to reach the needed overlap,
* the suffix filter: cutting both hash-sorted sets at the same pivots bounds the overlap piece by piece,

and then one verification of the complete sets for each pair. Documents with the same set form one class (by a digest of
the whole set) before anything is joined. To keep large groups of near copies from giving all their
pairs, the first pass joins each prefix shingle's classes with one of them only, its hub; what these links connect needs no
further comparison, and the second pass takes the pairs of a shingle's classes in different components. No pair is lost:
a qualifying pair shares a prefix shingle, and is either connected already or compared.

A class is named by a 64-bit number of its 128-bit digest. Should two classes get one number, the numbers are drawn anew
with another seed, so a number always stands for one set. Every intermediate table is deleted as soon as it was read.

Defined results of ``near_duplicates``: null or blank text has an empty set, links with nothing and is its own component. Fewer words than n
give one shingle of all words. Ties and repeated rows: equal sets share a class, whose members all are linked. Extra columns
are ignored. A row with a null key comes back with its size, without a component, and links with nothing.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Cut, by_row, claim, tidy
from tabulon.llm.components import components

#: Slots of the table of shingle counts (fixed, so its size is bounded whatever the corpus) and slots of one of its rows.
COUNT_BITS = 24
BLOCK_BITS = 18
#: Most bits of the filter that says which sets a verification needs (32 MB); it only ever lets too many pass.
FILTER_BITS = 28
WORDS_REMEMBERED = 200_000
CHARS_REMEMBERED = 4_000_000
#: Classes that a task remembers to have met.
CLASSES_REMEMBERED = 100_000
#: Hashes in the sets that a verifying task remembers.
NUMBERS_REMEMBERED = 2_000_000
#: Cuts of the suffix filter.
PIVOTS = 7

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A-Z to a-z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words. The words met first are the frequent ones: once as many are remembered as may be, others are not."""

    chars = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_REMEMBERED and self.chars < CHARS_REMEMBERED:
            self.chars += len(word)
            self[word] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.chars = 0


_words = _Words()


def _begin() -> None:
    claim("shingles", _words.forget)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct n-grams of words; ASCII letters in lower case."""
    words = (text or "").encode("utf-8", errors="replace").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total = mix(total * _ODD + ids[k : len(words) - size + 1 + k])
    return np.unique(total)


def class_of(hashes: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """(number of a class, what tells classes of one number apart): signed 64-bit parts of a digest of the whole set."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16, salt=seed.to_bytes(4, "big")).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def needed_overlap(a: int, b: int, percent: int) -> int:
    """The least intersection with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Suffix filter, then the sets themselves."""
    need = needed_overlap(len(x), len(y), percent)
    if min(len(x), len(y)) < need:
        return False
    if len(y) > 4 * PIVOTS:
        at_y = np.arange(1, PIVOTS + 1) * len(y) // (PIVOTS + 1)
        at_x = np.searchsorted(x, y[at_y])
        parts_y, parts_x = np.diff(at_y, prepend=0, append=len(y)), np.diff(at_x, prepend=0, append=len(x))
        if np.minimum(parts_x, parts_y).sum() < need:
            return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


# -- pass 1: sizes, classes and counts -------------------------------------------------------------------------------


SURVEY = "doc_id long, size long, cls long, mark long, block int, counts binary"


def _survey(n: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        names = [x.split(" ")[0] for x in SURVEY.split(", ")]
        table = np.zeros(1 << bits, dtype=np.uint32)
        counted: set[int] = set()
        for batch in batches:
            sizes, classes, marks = [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), n)
                cls, mark = class_of(own, seed)
                sizes.append(len(own))
                classes.append(cls)
                marks.append(mark)
                if cls not in counted:  # copies within a task count once; which ones meet there only moves the order
                    if len(counted) < CLASSES_REMEMBERED:
                        counted.add(cls)
                    table[own >> np.uint64(64 - bits)] += 1  # slots repeated within one document count once
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, classes, marks)), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=names)
        width = 1 << min(BLOCK_BITS, bits)
        blocks = [(i, table[i * width : (i + 1) * width]) for i in range(len(table) // width)]
        packed = [(i, zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)) for i, x in blocks if x.any()]
        if packed:
            m = len(packed)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(4)), pa.array([i for i, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names=names)

    return run


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of each block; a partition holds whole blocks, few of them. Counts leave as their logarithm in eighths."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = _unpack(data.as_py()).astype(np.uint64)
            sums[block] = sums[block] + own if block in sums else own
    for block, total in sums.items():
        steps = np.minimum(255, np.floor(8 * np.log2(total.astype(np.float64) + 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary())], names=["block", "counts"])


def _count_table(survey: DataFrame, bits: int) -> np.ndarray:
    width = 1 << min(BLOCK_BITS, bits)
    table = np.zeros(1 << bits, dtype=np.uint8)
    rows = survey.where("block IS NOT NULL").select("block", "counts").repartition((1 << bits) // width, "block").mapInArrow(_add_blocks, "block int, counts binary")
    with tidy(survey.sparkSession):
        found = rows.collect()  # at most 2**bits bytes, whatever the corpus
    for row in found:
        table[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return table


# -- pass 2: prefixes --------------------------------------------------------------------------------------------------


def _prefixes(n: int, bits: int, percent: int, table, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        counts, seen = table.value, set()
        for batch in batches:
            tokens, classes, places, lengths = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), n)
                if not len(own) or (cls := class_of(own, seed)[0]) in seen:
                    continue
                if len(seen) < CLASSES_REMEMBERED:
                    seen.add(cls)
                length = prefix_length(len(own), percent)
                rank = counts[own >> np.uint64(64 - bits)]
                # `own` is sorted by hash and the sort is stable: ordered by count, then hash
                first = own[np.argsort(rank, kind="stable")[:length]]
                tokens.append(first.view(np.int64))
                classes.append(cls)
                lengths.append(length)
                places.append((np.int64(len(own)) << 32) + np.arange(length))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(classes, np.int64), lengths)), pa.array(np.concatenate(places))], names=["token", "cls", "place"])

    return run


# -- verification ------------------------------------------------------------------------------------------------------


def _filter(ids: DataFrame, number: int) -> tuple[bytes, int]:
    """A bitmap of the hashed ids of a one-column table: at most 2**FILTER_BITS bits, 16 for each id below that."""
    name = ids.columns[0]
    bits = max(16, (16 * number).bit_length())
    rows = (
        ids.select(hash_bit(name, bits).alias("bit"))
        .groupBy(F.expr("bit DIV 32768").alias("block"))
        .agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("map"))
    )
    out = bytearray(1 << (bits - 3))
    with tidy(ids.sparkSession):
        for row in rows.collect():
            out[row["block"] * 4096 : (row["block"] + 1) * 4096] = row["map"]
    return bytes(out), bits


def hash_bit(column: str, bits: int):
    return F.expr(f"shiftrightunsigned(xxhash64(`{column}`), {64 - bits})")


def _sets(n: int, bitmap, seed: int):
    """Class and packed text of the rows that the bitmap lets through, or of all rows without one. A text packs far smaller
    than the hashes of its shingles, which are made again where two sets meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        _begin()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            if bitmap is not None:
                batch = batch.filter(_among(bitmap.value, batch.column(1)))
            texts = [t.as_py() or "" for t in batch.column(0)]
            classes = [class_of(shingles(t, n), seed)[0] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array([pack(t.encode("utf-8", errors="replace")) for t in texts], pa.binary())], names=["cls", "packed"])

    return run


def _among(bitmap: bytes, bits: pa.Array) -> pa.Array:
    held, at = np.frombuffer(bitmap, np.uint8), bits.to_numpy(zero_copy_only=False)
    return pa.array(held[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)


def _only(bitmap):
    """The rows whose bit, their last column, is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(_among(bitmap.value, batch.column(batch.num_columns - 1)))
            yield kept.select(list(range(batch.num_columns - 1)))

    return run


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        _begin()
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}  # sets that more than one pair may need: the rows are sorted by y, and hubs repeat
        numbers = 0

        def set_of(cls: int, packed: pa.Scalar) -> np.ndarray:
            nonlocal numbers
            if cls not in known:
                if numbers > NUMBERS_REMEMBERED:
                    known.clear()
                    numbers = 0
                known[cls] = shingles(unpack(packed.as_py()).decode("utf-8", errors="replace"), n)
                numbers += len(known[cls])
            return known[cls]

        for batch in batches:
            keep = []
            for x, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                keep.append(reaches(set_of(x, a), set_of(y, b), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    return run


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int, seed: int) -> Cut:
    """The pairs of classes that reach the threshold; every pair is verified once, on its complete sets.

    A class's set is made again from the text of one document of it. As long as they fit a bitmap of bounded size, it lets
    these documents (and a few more, which meet no pair) through; beyond, a semi-join does. Packed texts are shuffled once for
    each side of their pairs."""
    needed = pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "cls")
    ids = Cut(classes.join(needed, "cls").select(F.col("rep").alias("doc_id")), "needed")
    number = ids.df.count()
    if 16 * number < 1 << FILTER_BITS:
        held, bits = _filter(ids.df, number)
        bitmap = docs.sparkSession.sparkContext.broadcast(held)
        rows = docs.select("text", hash_bit("doc_id", bits).alias("bit"))
    else:
        bitmap = None
        rows = docs.join(ids.df.distinct(), "doc_id", "left_semi").select("text")
    sets = rows.mapInArrow(_sets(n, bitmap, seed), "cls long, packed binary")
    left = pairs.join(sets.select(F.col("cls").alias("x"), F.col("packed").alias("px")), "x")
    both = left.join(sets.select(F.col("cls").alias("y"), F.col("packed").alias("py")), "y").select("x", "y", "px", "py")
    links = Cut(both.mapInArrow(_verify(n, percent), "x long, y long"), "verified")
    ids.drop()
    return links


def _fits(percent: int) -> str:
    """The length and the positional filter on two places (size * 2**32 + position)."""
    size, position = "({} DIV 4294967296)", "({} & 4294967295)"
    a, b, i, j = size.format("{a}"), size.format("{b}"), position.format("{a}"), position.format("{b}")
    return f"{percent} * greatest({a}, {b}) <= 100 * least({a}, {b}) and least({a} - {i}, {b} - {j}) >= ceil({percent} * ({a} + {b}) / {100 + percent}.0D)"


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", column: str = "text", count_bits: int = COUNT_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size) of every row; ``key`` is an integer column. Two documents link when
    100 * intersection >= percent * union of their n-gram sets; component_id is the smallest linked doc_id."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text"))
    seed = 0
    while True:
        survey = Cut(rows.mapInArrow(_survey(n, count_bits, seed), SURVEY), "survey")
        sized = survey.df.where("block IS NULL").select("doc_id", "size", "cls", "mark")
        found = sized.where("size > 0 AND doc_id IS NOT NULL").groupBy("cls")
        marks = Cut(found.agg(F.min("size").alias("size"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"), F.min("mark").alias("low"), F.max("mark").alias("top")), "marks")
        if not marks.df.where("low <> top").limit(1).take(1):
            break
        seed += 1  # two classes with one number
        survey.drop()
        marks.drop()
    classes = marks.df.select("cls", "size", "rep", "class_size")
    docs = rows.where("doc_id IS NOT NULL")
    table = docs.sparkSession.sparkContext.broadcast(_count_table(survey.df, count_bits))
    every = Cut(docs.mapInArrow(_prefixes(n, count_bits, percent, table, seed), "token long, cls long, place long"), "prefixes")
    # Shingles that stand in one prefix only, most of them, meet nothing. Counting them shuffles one number a row; while the
    # others fit a bitmap of bounded size, it spares the rest the shuffle of the join.
    met = Cut(every.df.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token"), "met")
    rows_met, number = every.df, met.df.count()
    if 16 * number < 1 << FILTER_BITS:
        held, bits = _filter(met.df, number)
        rows_met = rows_met.withColumn("bit", hash_bit("token", bits)).mapInArrow(_only(docs.sparkSession.sparkContext.broadcast(held)), "token long, cls long, place long")
    prefixes = Cut(rows_met.join(met.df, "token", "left_semi"), "shared")
    every.drop()
    met.drop()
    # The hub of a shingle: its class with the most shared shingles in its prefix. The text that others are copies of shares
    # nearly all of its own, so it links with far more of them than any copy does.
    weights = prefixes.df.groupBy("cls").agg(F.count(F.lit(1)).alias("weight"))
    weighted = prefixes.df.join(weights, "cls")
    hubs = weighted.groupBy("token").agg(F.max(F.struct("weight", "cls", "place")).alias("hub")).select("token", F.col("hub.cls").alias("hub"), F.col("hub.place").alias("hub_place"))
    fits = _fits(percent)
    stars = prefixes.df.join(hubs, "token").where("cls <> hub").where(fits.format(a="hub_place", b="place"))
    stars = Cut(stars.select(F.least("hub", "cls").alias("x"), F.greatest("hub", "cls").alias("y")).distinct(), "stars")
    links = _links(docs, classes, stars.df, n, percent, seed)
    joined = Cut(components(links.df), "joined")

    labelled = prefixes.df.join(joined.df.withColumnRenamed("id", "cls"), "cls", "left").select("token", "cls", "place", F.coalesce("component_id", "cls").alias("part"))
    labelled = Cut(labelled, "labelled")
    prefixes.drop()
    joined.drop()
    mixed = labelled.df.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("top")).where("low <> top").select("token")
    open_ = Cut(labelled.df.join(mixed, "token", "left_semi"), "open")
    labelled.drop()
    a = open_.df.select("token", F.col("cls").alias("x"), F.col("place").alias("px"), F.col("part").alias("ax"))
    b = open_.df.select("token", F.col("cls").alias("y"), F.col("place").alias("py"), F.col("part").alias("ay"))
    crossing = a.join(b, "token").where("ax <> ay and x < y").where(fits.format(a="px", b="py"))
    rest = Cut(crossing.select("x", "y").distinct().join(stars.df, ["x", "y"], "left_anti"), "crossing")
    open_.drop()
    stars.drop()
    more = _links(docs, classes, rest.df, n, percent, seed)
    rest.drop()
    final = components(links.df.union(more.df))
    links.drop()
    more.drop()

    whole = classes.join(final.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "size", "rep", "class_size", F.coalesce("component_id", "cls").alias("part"))
    whole = Cut(whole, "classes")
    marks.drop()
    smallest = whole.df.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = whole.df.join(smallest, "part").select("cls", "component_id", "class_size")
    alone = F.col("doc_id").isNull() | (F.col("size") == 0)
    return (
        sized.select("doc_id", "size", F.when(~alone, F.col("cls")).alias("cls")).join(named, "cls", "left")
        .select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
    )


def drop_near_copies(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with the smallest key (of rows with one key, any one)."""
    rows, name = by_row(df, key)
    gone = near_duplicates(rows, n, percent, name, column).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return rows.join(gone, F.col(name).cast("long") == F.col("__gone"), "left_anti").select(*df.columns)


def similarity(a: str, b: str, n: int) -> float:
    """The plain definition, for tests."""
    x, y = set(shingles(a, n).tolist()), set(shingles(b, n).tolist())
    return len(x & y) / len(x | y) if x and y else math.nan
