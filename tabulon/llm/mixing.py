"""Mixing sources to target weights with a low-discrepancy slot schedule; DataFrame operations only.

Targets: a share of all tokens, divided by weight; a source stops at its cap and the excess is shared by weight among the
others (closed form: sources in order of cap by weight, running sums give the water level).

Schedule: slot i of the mix stands at the golden-ratio point (i * g) mod 2**32, mapped through the cumulative targets to a
source, and is ranked among that source's slots. A source's documents, in the order of a seeded digest, form a tape of its
tokens, repeated as often as its target asks and cut into blocks of BLOCK_TOKENS; its k-th slot takes its k-th block, the
last one cut where the target ends. The points leave a source a few slots over or short; slots over are dropped, the few
blocks short follow in closing slots, spread evenly over them. The taken words of a document are what the scheduled blocks
cover of it, its first slot is that of its first block, and the mix of documents is in slot order.

Nothing is ranked in one task: slots and tapes are ranked within buckets, and only bucket sums (a bounded number for each
source) are summed up in order. The windows over sources see one row, or a few, for each source.

Defined results: a null or blank text has size 0 and is taken 0 times. A null source is a source of its own, the last in
order. Without any words all targets are 0. Ties in the digest are ordered by key, so reruns agree; repeated rows each have
a place on the tape, and rows with null keys too. Extra columns are ignored by ``mix`` and kept by ``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import WORD_PATTERN, by_row, cut

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Parts of a percent of all tokens.
SHARE_PERCENT = 150
CAP_TIMES = 2
#: The golden-ratio step on a ring of 2**32 points.
GOLDEN_STEP = 2654435769
RING = 2**32
#: Tokens of a block, of which a slot takes one.
BLOCK_TOKENS = 1024
#: Parts of a tape and of the slots within which ranks are counted.
TAPE_BUCKETS = 4096
SLOT_CHUNK = 65_536
#: Parts of the ring by which points meet the sources they may belong to.
RING_CELLS = 4096
SEED = "mix"


def sizes_of(df: DataFrame, key: str = "doc_id", column: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, source, size) of every row."""
    words = F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap_times: int = CAP_TIMES) -> DataFrame:
    """(source, source_size, weight, target), one row for each source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighted = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place)).withColumn("cap", F.col("source_size") * cap_times)
    # in this order the first sources are full, and the first open one has the level of all open ones
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * share_percent / F.lit(100.0)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = weighted.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared * F.col("weight"))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def tape(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``: the tokens before each row on its source's tape."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = sizes.withColumn("digest", digest).withColumn("bucket", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(sums, inner["source"].eqNullSafe(sums["s"]) & (inner["bucket"] == sums["b"])).select("row", "doc_id", "source", "size", (F.col("base") + F.col("inner")).alias("start"))


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """(slot, source, block): the mix in order; every block of every source's repeated tape once."""
    run = Window.orderBy(F.col("source").asc_nulls_last())
    so_far, everything = run.rowsBetween(Window.unboundedPreceding, Window.currentRow), run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("target").over(everything)
    cuts = plan.where("target >= 1").select(
        "source",
        F.ceil(F.floor("target") / block).cast("long").alias("blocks"),
        F.floor(F.sum("target").over(so_far) / whole * RING).cast("long").alias("upper"),
        F.row_number().over(run).alias("place"),
        F.count(F.lit(1)).over(everything).alias("places"),
        F.floor(whole / block).cast("long").alias("slots"),
    )
    cuts = cuts.withColumn("lower", F.coalesce(F.lag("upper").over(run), F.lit(0))).withColumn("upper", F.when(F.col("place") == F.col("places"), F.lit(RING)).otherwise(F.col("upper")))
    slots = cuts.agg(F.max("slots").alias("n")).first()["n"] or 0
    cell = RING // RING_CELLS
    met = cuts.where("upper > lower").select("source", "blocks", "lower", "upper", F.explode(F.sequence(F.expr(f"lower DIV {cell}"), F.expr(f"(upper - 1) DIV {cell}"))).alias("cell"))
    points = plan.sparkSession.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN_STEP, F.lit(RING)).alias("point"))
    points = points.withColumn("cell", F.expr(f"point DIV {cell}")).withColumn("chunk", F.expr(f"slot DIV {SLOT_CHUNK}"))
    owned = points.join(met, "cell").where("point >= lower and point < upper").select("slot", "chunk", "source", "blocks")
    # rank = slots of the source in earlier chunks + rank in the chunk
    sums = owned.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "chunk").orderBy("slot")
    inner = owned.withColumn("inner", F.row_number().over(within) - 1)
    ranked = inner.join(sums, inner["source"].eqNullSafe(sums["s"]) & (inner["chunk"] == sums["c"])).select("slot", "source", "blocks", (F.col("base") + F.col("inner")).alias("block"))
    regular = ranked.where("block < blocks").select("slot", "source", "block")
    held = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("held")).withColumnRenamed("source", "s")
    short = cuts.join(held, cuts["source"].eqNullSafe(held["s"]), "left").withColumn("held", F.coalesce("held", F.lit(0))).where("held < blocks")
    closing = short.select("source", "place", "held", "blocks", F.explode(F.sequence(F.col("held"), F.col("blocks") - 1)).alias("block"))
    shift = F.pmod(F.col("place") * GOLDEN_STEP, F.lit(RING)) / F.lit(float(RING))
    closing = closing.withColumn("position", (F.col("block") - F.col("held") + shift) / (F.col("blocks") - F.col("held")))
    order = Window.orderBy("position", F.col("source").asc_nulls_last())  # a few rows for each source
    return regular.union(closing.select((F.lit(slots) + F.row_number().over(order) - 1).alias("slot"), "source", "block"))


def placements(df: DataFrame, key: str, column: str, source: str, weights: tuple[int, ...], share_percent: int, cap_times: int, block: int) -> DataFrame:
    """Each time a row comes by on its source's repeated tape, in parts by block: (row, doc_id, source, size, source_size,
    target, turn, left: words taken this time, opens: is it the first part, words, slot); without a block where none is taken."""
    sizes = cut(sizes_of(df, key, column, source), "sizes")
    plan = cut(targets(sizes, weights, share_percent, cap_times), "targets")
    slots = schedule(plan, block)
    mine = plan.withColumnRenamed("source", "s").select("s", "source_size", "target", F.floor("target").cast("long").alias("wanted"))
    rows = tape(sizes)
    rows = rows.join(mine, rows["source"].eqNullSafe(mine["s"])).drop("s")
    # the part before the target's end, cut at block borders
    turns = F.sequence(F.lit(0), F.lit(cap_times - 1))
    came = rows.withColumn("turn", F.explode(turns)).withColumn("a", F.col("turn") * F.col("source_size") + F.col("start"))
    came = came.withColumn("z", F.least(F.col("a") + F.col("size"), F.col("wanted"))).withColumn("left", F.greatest(F.col("z") - F.col("a"), F.lit(0)))
    spans = F.when(F.col("left") > 0, F.sequence(F.expr(f"a DIV {block}"), F.expr(f"(z - 1) DIV {block}")))
    parts = came.withColumn("block", F.explode_outer(spans))
    own = slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "slot")
    met = parts.join(own, parts["source"].eqNullSafe(own["s"]) & (parts["block"] == own["b"]), "left")
    words = F.when(F.col("b").isNotNull(), F.least("z", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)).otherwise(0)
    opens = F.coalesce(F.col("b") == F.expr(f"a DIV {block}"), F.lit(False))
    return met.select("row", "doc_id", "source", "size", "source_size", "target", "turn", "left", opens.alias("opens"), words.cast("long").alias("words"), "slot")


def mix(
    df: DataFrame, key: str = "doc_id", column: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
    cap_times: int = CAP_TIMES, block: int = BLOCK_TOKENS,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, source) of every row; taken counts repeats, first_slot is null
    where nothing is taken."""
    placed = placements(df, key, column, source, weights, share_percent, cap_times, block)
    return placed.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "source"
    )


def repeat_documents(
    df: DataFrame, key: str = "doc_id", column: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
    cap_times: int = CAP_TIMES, block: int = BLOCK_TOKENS,
) -> DataFrame:
    """The mix as rows of ``df``, in slot order: each row once for every time that any of it is taken (the last one of a
    source may be cut by its target, and comes whole)."""
    rows, name = by_row(df, key)
    placed = placements(rows, name, column, source, weights, share_percent, cap_times, block).where("opens")
    times = placed.select(F.col("doc_id").alias("__key"), F.col("slot").alias("__slot"))
    mixed = rows.join(times, F.col(f"`{name}`") == F.col("__key"))
    return mixed.orderBy("__slot", "__key").select(*[rows[c] for c in df.columns])
