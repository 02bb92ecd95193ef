"""A change feed applied as its files arrive."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.operators import upsert

#: Buckets of the state, fixed when a state begins.
BUCKETS = 64


class BucketedState:
    """The state of a feed in buckets of keys below ``root``: a change writes the buckets it touches, the others stay where they are.

    ``CURRENT``, replaced by one rename, names the folder of every bucket. Folders that it no longer names are deleted
    when the version after that is published, so a reader of the version before is not disturbed.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        facts = self._facts()
        self.buckets = facts["buckets"] if facts else buckets

    def _facts(self) -> dict | None:
        text = storage.read_text(self.spark, f"{self.root}/CURRENT")
        return json.loads(text) if text else None

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], upsert.STATE)
        return self.spark.read.schema(upsert.STATE).parquet(*[f"{self.root}/{p}" for p in paths])

    def state(self) -> DataFrame:
        """The newest change of every key, tombstones included."""
        facts = self._facts()
        return self._read(sorted(facts["folders"].values()) if facts else [])

    def apply(self, deliveries: DataFrame) -> None:
        """Apply deliveries and publish the outcome. Applied again they change nothing."""
        bucket = F.pmod(F.xxhash64("table_name", "entry_key"), F.lit(self.buckets)).cast("int").alias("bucket")
        scratch = storage.Scratch(self.spark, "feed")
        changes = scratch.keep(upsert.valid_changes(deliveries), "changes")
        # at most as many rows as there are buckets
        touched = sorted(r.bucket for r in changes.select(bucket).distinct().collect())
        facts = self._facts() or {"version": 0, "buckets": self.buckets, "folders": {}, "left": []}
        before = self._read([facts["folders"][str(b)] for b in touched if str(b) in facts["folders"]])
        version = facts["version"] + 1
        while storage.exists(self.spark, f"{self.root}/v{version}"):
            version += 1
        if touched:
            rows = changes.unionByName(before).mapInArrow(upsert.reduce_batches, upsert.STATE).withColumn("bucket", bucket).repartition(len(touched), "bucket")
            kept = rows.drop("bucket").mapInArrow(upsert.upsert_bucket, upsert.STATE)
            kept.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.root}/v{version}")
        folders = facts["folders"] | {str(b): f"v{version}/bucket={b}" for b in touched}
        left = [facts["folders"][str(b)] for b in touched if str(b) in facts["folders"]]
        storage.write_text(self.spark, f"{self.root}/CURRENT", json.dumps({"version": version, "buckets": self.buckets, "folders": folders, "left": left}))
        for path in facts["left"]:
            storage.discard(self.spark, f"{self.root}/{path}")
        scratch.clear()


def apply_stream(deliveries: DataFrame, root: str, checkpoint: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Apply what is new in the streaming frame ``deliveries`` to the state published under ``root``; returns that state.

    Each micro-batch continues the published state in the buckets it touches and publishes the next version. A batch that is run again after a
    failure changes nothing, since a change is applied only over an older one.
    """
    kept = BucketedState(deliveries.sparkSession, root, buckets)

    def step(batch: DataFrame, number: int) -> None:
        BucketedState(batch.sparkSession, root, kept.buckets).apply(batch)

    query = deliveries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return kept.state()


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table, a folder or a single file, as a stream of its files."""
    pattern = storage.as_pattern(path)
    reader = spark.readStream.schema(spark.read.parquet(pattern).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(pattern)
