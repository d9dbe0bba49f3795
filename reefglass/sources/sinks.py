"""Sinks: a table of whole snapshots that batches and streams merge into.

Every write makes a new version folder, then names it in a pointer file, so a reader sees a whole snapshot and a lost job leaves the
last one standing. A stream's batch that is delivered again after a failure is recognised by its number and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.operators import catalog_ops


class SnapshotTable:
    """A table under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def pointer(self) -> tuple[int, int]:
        """(version, last batch); (0, -1) before the first write."""
        fs, path = self._fs()
        found = [s.getPath().getName() for s in fs.globStatus(path(f"{self.path}/current-*")) or ()]
        return max((tuple(int(x) for x in n.removeprefix("current-").split("_")) for n in found), default=(0, -1))

    def read(self) -> DataFrame | None:
        """The current snapshot, None before the first write."""
        version, _ = self.pointer()
        return self.spark.read.parquet(f"{self.path}/v{version}") if version else None

    def replace(self, df: DataFrame, batch: int | None = None) -> None:
        """A full rebuild: the rows become the new snapshot. The one before it is kept for readers that still use it."""
        version, last = self.pointer()
        df.write.mode("overwrite").parquet(f"{self.path}/v{version + 1}")
        fs, path = self._fs()
        fs.create(path(f"{self.path}/current-{version + 1}_{last if batch is None else batch}")).close()
        fs.delete(path(f"{self.path}/v{version - 1}"), True)

    def upsert(self, df: DataFrame, keys: list[str], order: Column | None = None, batch: int | None = None) -> None:
        """Merges rows by their keys; of several rows of a key the last by ``order`` counts."""
        now = self.read()
        if now is None:
            now = df.limit(0)
        self.replace(catalog_ops.upsert(now, df, keys, order), batch)

    def merge_batches(self, keys: list[str], order: Column | None = None, change: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: every batch is merged once. ``change`` alters the rows first, such as clearing the mark of stale ones."""

        def run(df: DataFrame, batch: int) -> None:
            if batch > self.pointer()[1]:
                self.upsert(df if change is None else change(df), keys, order, batch)

        return run


def cleared(df: DataFrame, mark: str = "stale_marked_at") -> DataFrame:
    """Rows that were indexed again carry no mark."""
    return df.withColumn(mark, F.lit(None).cast(df.schema[mark].dataType))
