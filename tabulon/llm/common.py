"""What the operators of this subpackage share: shared-folder checkpoints, Arrow helpers, digests."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of a "word": ASCII white space, \x20 and \x09-\x0D. ``bytes.split()`` cuts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset and all runs in one process, as in
    tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = checkpoint.get() if checkpoint.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tabulon-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be reached any more
            return


atexit.register(_delete_written)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within are deleted when each action ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Cut:
    """A DataFrame written to the shared folder: its lineage ends there, so a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, label: str, compression: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        with tidy(self.spark):
            df.write.option("compression", compression).parquet(self.path)
        _written.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that nothing reads any more."""
        _delete(self.spark, self.path)
        _written.remove((self.spark, self.path))


def cut(df: DataFrame, label: str) -> DataFrame:
    return Cut(df, label).df


ROW = "__row"


def by_row(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``df`` and a column that names each of its rows: the key, if every row has one of its own. Otherwise the rows are
    written once, with numbers in the order of their keys (rows without a key last)."""
    shared = df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k IS NULL")
    with tidy(df.sparkSession):
        if not shared.limit(1).take(1):
            return df, key
    return cut(df.orderBy(F.col(f"`{key}`").asc_nulls_last()).withColumn(ROW, F.monotonically_increasing_id()), "rows"), ROW


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


_holder: tuple[str, Callable[[], object]] | None = None


def claim(name: str, forget: Callable[[], object]) -> None:
    """Called by a task before it fills a memory that outlives it. Workers are reused, so what another operator remembers
    is forgotten first: a worker holds one operator's memory at a time."""
    global _holder
    if _holder is not None and _holder[0] != name:
        _holder[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _holder = (name, forget)


def text_slices(column: pa.Array, chars: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows of about so many characters; null counts as empty."""
    held: list[str] = []
    first = total = 0
    for at, text in enumerate(column):
        held.append(text.as_py() or "")
        total += len(held[-1])
        if total >= chars or len(held) >= 10_000:
            yield first, held
            held, first, total = [], at + 1, 0
    if held:
        yield first, held


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def file_bytes(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(f"tokenizer file {path} is not on this machine")
    return path
