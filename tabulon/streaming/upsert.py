"""Upserts from a stream: every micro-batch is merged into a table that is kept as versioned Parquet folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tabulon.table import Table


class StreamingUpsert:
    """``stream.writeStream.foreachBatch(StreamingUpsert(table, path, order_by="ts"))``. Each batch reads the last version,
    merges the batch by primary key (the latest row of a key by ``order_by`` counts) and writes the next version, so the plan
    does not grow; a batch that is run again writes its version again."""

    def __init__(self, table: Table, path: str, order_by: str | None = None, on_version: Callable[[Table, int], None] | None = None):
        self.table, self.path, self.order_by, self.on_version = table, path.rstrip("/"), order_by, on_version

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        known = [c for c in batch.columns if self.table.schema.find(c) or c == self.order_by]
        merged, _ = self.table.merge_rows(batch.select(*known), order_by=self.order_by, ignore_extra_columns=True)
        merged.live().stored_frame().write.mode("overwrite").parquet(f"{self.path}/version={epoch}")
        fresh = self.table.spark.read.parquet(f"{self.path}/version={epoch}")
        self.table = self.table.over(fresh.select(*[c.name for c in self.table.schema.stored]), tracked=False)
        if self.on_version:
            self.on_version(self.table, epoch)
