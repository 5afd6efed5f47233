"""A keyed table whose updates rewrite only the buckets that they touch.

Rows are dealt to a fixed number of buckets by a hash of their key.  A manifest, one
small JSON folder per epoch, names the folder that holds each bucket's current
rows.  An update merges and writes the buckets of its own keys into a folder of its
epoch, and then a manifest that points there for these and to the old folders for
all others.  Readers see the newest manifest that was completely written; an epoch that is
tried again starts from the manifest before it and ends with the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairband.operators.refresh import cache_upsert
from fairband.session import materialize

BUCKETS = 64


class BucketTable:
    def __init__(self, spark: SparkSession, base: str, key: str = "player_pk", buckets: int = BUCKETS):
        self.spark, self.base, self.key, self.buckets = spark, base, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _newest(self, before: int | None) -> str | None:
        from fairband.streaming.rollup import latest_snapshot
        return latest_snapshot(self.spark, f"{self.base}/manifests", before)

    def manifest(self, before: int | None = None) -> dict[int, str]:
        """Bucket -> folder of the newest complete epoch (before ``before``)."""
        path = self._newest(before)
        return {r["bucket"]: r["path"] for r in self.spark.read.schema("bucket int, path string").json(path).collect()} if path else {}

    def next_epoch(self) -> int:
        path = self._newest(None)
        return int(path.rsplit("_", 1)[1]) + 1 if path else 0

    def read(self, only: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """Current rows (of some buckets); None where there are none."""
        paths = [p for b, p in sorted(self.manifest(before).items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def upsert(self, updates: DataFrame, epoch: int | None = None) -> list[int]:
        """Insert or replace by key, newest ``computed_at`` first; returns the buckets that were rewritten."""
        epoch = self.next_epoch() if epoch is None else epoch
        updates = materialize(updates.filter(F.col(self.key).isNotNull()), "bucket-updates")
        touched = sorted(r["b"] for r in updates.select(self.bucket().alias("b")).distinct().collect())
        if not touched:
            return []
        current = self.read(touched, before=epoch)
        merged = cache_upsert(updates.limit(0) if current is None else current, updates, self.key)
        folder = f"{self.base}/data/epoch_{epoch:06d}"
        (merged.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(folder))
        entries = self.manifest(before=epoch) | {b: f"{folder}/bucket={b}" for b in touched}
        (self.spark.createDataFrame(sorted(entries.items()), "bucket int, path string").coalesce(1)
         .write.mode("overwrite").json(f"{self.base}/manifests/snapshot_{epoch:06d}"))
        return touched
