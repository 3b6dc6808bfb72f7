"""Exact deduplication by Grace hashing with complete-content comparison.

1. Every map task folds its own rows first: an open-addressing table that compares complete contents keeps one record for
   each distinct text of the task (its best row and its count), so a text with a third of all rows is sent once per task.
2. The records are partitioned by hash. A task writes a partition that outgrows its memory to spill files by the next hash
   bits, again and again, until each bucket fits an open-addressing table that compares complete contents.
3. A narrow join over record numbers gives every row its group.

Contents travel as zstd blocks; equal contents are told by their bytes, never by a digest alone.

Defined results: null text is empty text; texts that differ only in ``\\x20\\x09-\\x0D`` are equal; of equal texts the row
with the most code points, then the smallest key stays, a null key only if all are null. Repeated rows each count. Other
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import by_row, cut

WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of content that a folding task holds before it hands its records on.
FOLD_BYTES = 48 << 20
#: Bytes of content that a bucket's table may hold; larger buckets are spilled.
BUCKET_BYTES = 96 << 20
SPILL_FANOUT = 16
MOST_LEVELS = 12
#: Stands for a null key in comparisons: larger than all others.
LAST = 2**63

FOLDED = "doc_id long, record long, hash long, content binary, digest string, best_id long, best_points long, n_rows long"
GROUPED = "record long, keep_id long, group_size long, text_sha256 string"


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry number, an entry its hash and complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _same(self, entry: int, content: bytes) -> bool:
        held = self.contents[entry]
        return held == content or zstandard.decompress(held) == zstandard.decompress(content)

    def put(self, hashed: int, content: bytes) -> tuple[int, bool]:
        """(entry, is it new)."""
        slots, mask = self.slots, len(self.slots) - 1
        slot = hashed & mask
        while (entry := slots[slot]) >= 0:
            if self.hashes[entry] == hashed and self._same(entry, content):
                return entry, False
            slot = (slot + 1) & mask
        entry = slots[slot] = len(self.hashes)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, hashed in enumerate(self.hashes):
            slot = hashed & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


def _better(points: int, key: int | None, best_points: int, best: int | None) -> bool:
    return points > best_points or points == best_points and (LAST if key is None else key) < (LAST if best is None else best)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, text) to one row each, those that stand for a distinct text of the task with its content."""
    names = [x.strip().split(" ")[0] for x in FOLDED.split(",")]
    first_record = TaskContext.get().partitionId() << 40
    compress = zstandard.ZstdCompressor(level=1).compress
    table, members, best, digests = ContentTable(), [], [], []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal first_record, table, members, best, digests
        seen: set[int] = set()
        for start in range(0, len(members), 2000):
            rows = []
            for key, entry in members[start : start + 2000]:
                if entry in seen:
                    rows.append((key, first_record + entry, None, None, None, None, None, None))
                else:
                    seen.add(entry)
                    best_id, best_points, n = best[entry]
                    rows.append((key, first_record + entry, table.hashes[entry] - 2**63, table.contents[entry], digests[entry], best_id, best_points, n))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        first_record += len(best)
        table, members, best, digests = ContentTable(), [], [], []

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            content = text.encode().translate(None, WHITE)
            digest = hashlib.sha256(content)
            entry, new = table.put(struct.unpack_from(">Q", digest.digest())[0], compress(content))
            if new:
                best.append([key, len(text), 1])
                digests.append(digest.hexdigest())
            else:
                held = best[entry]
                held[2] += 1
                if _better(len(text), key, held[1], held[0]):
                    held[0], held[1] = key, len(text)
            members.append((key, entry))
            if table.bytes + 100 * len(members) > FOLD_BYTES:
                yield from flush()
    if members:
        yield from flush()


_HEAD = struct.Struct("<qQqqqB64sI")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for record, hashed, content, digest, best_id, best_points, n in zip(*columns, strict=True):
            yield record, hashed + 2**63, content, digest, best_id, best_points, n


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            record, hashed, best_id, points, n, has_id, digest, size = _HEAD.unpack(head)
            yield record, hashed, f.read(size), digest.decode(), best_id if has_id else None, points, n


class _Spill:
    """A folder of bucket files, gone when the task ends."""

    def __init__(self) -> None:
        self.folder: str | None = None
        self.count = 0

    def open(self) -> list:
        self.folder = self.folder or tempfile.mkdtemp(prefix="grace-")
        self.count += SPILL_FANOUT
        return [open(os.path.join(self.folder, str(self.count + i)), "wb") for i in range(SPILL_FANOUT)]  # noqa: SIM115

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _write(file, row: tuple) -> None:
    record, hashed, content, digest, best_id, points, n = row
    file.write(_HEAD.pack(record, hashed, best_id or 0, points, n, best_id is not None, digest.encode(), len(content)))
    file.write(content)


def _group(rows: Iterator[tuple], level: int, spill: _Spill, most_bytes: int) -> Iterator[tuple]:
    """(record, keep_id, group_size, digest) of a bucket's records."""
    table, groups, records = ContentTable(), [], []
    rows = iter(rows)
    for row in rows:
        record, hashed, content, digest, best_id, points, n = row
        entry, new = table.put(hashed, content)
        if new:
            groups.append([best_id, points, n, digest])
        else:
            held = groups[entry]
            held[2] += n
            if _better(points, best_id, held[1], held[0]):
                held[0], held[1] = best_id, points
        records.append((record, entry, best_id, points, n))
        if table.bytes > most_bytes and level < MOST_LEVELS:
            break
    else:
        for record, entry, *_ in records:
            best_id, _, n, digest = groups[entry]
            yield record, best_id, n, digest
        return
    # too large: what the table holds and all that follows goes to files by the next hash bits
    files = spill.open()
    shift = 60 - 4 * level
    for record, entry, best_id, points, n in records:
        hashed = table.hashes[entry]
        _write(files[hashed >> shift & 15], (record, hashed, table.contents[entry], groups[entry][3], best_id, points, n))
    del table, records
    for row in rows:
        _write(files[row[1] >> shift & 15], row)
    for file in files:
        file.close()
    for file in files:
        yield from _group(_read(file.name), level + 1, spill, most_bytes)
        os.remove(file.name)


def grace(batches: Iterator[pa.RecordBatch], most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    spill = _Spill()
    names = [x.strip().split(" ")[0] for x in GROUPED.split(",")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    try:
        for row in _group(_records(batches), 0, spill, most_bytes or BUCKET_BYTES):
            out.append(row)
            if len(out) == 10_000:
                yield batch()
                out = []
        if out:
            yield batch()
    finally:
        spill.close()


def exact_groups(df: DataFrame, key: str = "doc_id", column: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``df``. ``key`` must be an integer column; of
    repeated rows with the kept key each is marked kept."""
    folded = cut(df.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(fold, FOLDED), "folded")
    records = folded.where("content IS NOT NULL").select("record", "hash", "content", "digest", "best_id", "best_points", "n_rows").repartition("hash")
    groups = records.mapInArrow(lambda batches: grace(batches, bucket_bytes), GROUPED)
    return (
        folded.select("doc_id", "record").join(groups, "record").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
    )


def drop_copies(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each text; of rows with the same key and text any one stays."""
    rows, name = by_row(df, key)
    kept = exact_groups(rows, name, column).where("kept").select(F.col("doc_id").alias("__kept_id"))
    return rows.join(kept, F.col(name).cast("long") == F.col("__kept_id"), "left_semi").select(*df.columns)
