"""Has this key been seen before?

A stream whose keyed state lives in RocksDB on disk, with checkpoints in the shared folder and no watermark, so
that no key ever expires. The state of a key is the position of its first occurrence, and when the key was first seen.
Each micro-batch takes the states of the keys it touched, as they are after it, beside its own records, and says of
each record whether it is its key's first or a repeat; nothing of earlier batches is read for that. Where a later
batch brings an earlier position, the record that had been called first is corrected, so the answer is exact whatever
the order in which files arrive. Rows are pre-aggregated per key before they are shuffled to the state, so a hot key
sends one row per task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold import storage

KEYED = "feed string, scope string, key string, position bigint"
_KEY = ("feed", "scope", "key")
#: Position given to everything that lies before the records to be judged.
BEFORE = -(2**63)
#: Position of records whose own is null: they come last, all at once.
UNKNOWN = 2**63 - 1
#: Files of each input that a micro-batch takes.
FILES_PER_BATCH = 256
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own for the streams, so that the caller's settings stay as they are. ``partitions`` of the state, which
    a checkpoint fixes for ever, are the caller's shuffle partitions if not given."""
    own = spark.newSession()
    for name, value in _STATE_CONF.items():
        own.conf.set(name, value)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    return own


class SeenKeys:
    """Keyed seen-state under ``root``, which later calls continue; ``root`` defaults to a fresh folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or storage.workspace(spark, "seen")

    def _read(self, name: str, schema: str, spark: SparkSession | None = None) -> DataFrame:
        spark, path = spark or self.spark, f"{self.root}/{name}"
        if not storage.exists(spark, path):
            return spark.createDataFrame([], f"{schema}, batch bigint")
        return spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)

    def observe(self, keyed: DataFrame) -> None:
        """Run what is new in the streaming frame ``keyed`` (columns of ``KEYED``, of a ``state_session``) through the state, to its end.

        Each micro-batch leaves its judgements, the firsts it found and its corrections in folders of its own, overwritten
        if the batch is run again, so every record counts exactly once.
        """
        now = F.current_timestamp()
        known = keyed.where(F.col("key").isNotNull()).withColumn("now", now)
        state = known.groupBy(*_KEY).agg(F.min("position").alias("position"), F.min("now").alias("since"), F.min(F.when(F.col("position") == BEFORE, F.col("now"))).alias("before_since"))
        touched = state.select(*_KEY, "position", F.lit(True).alias("is_state"), (F.col("since") < now).alias("old"), (F.col("before_since") == now).alias("new_before"))
        records = keyed.where(F.col("position") != BEFORE).select(*_KEY, "position", F.lit(False).alias("is_state"), F.lit(None).cast("boolean").alias("old"), F.lit(None).cast("boolean").alias("new_before"))

        def judge(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            staged = f"{self.root}/staged-{number}"
            batch.write.mode("overwrite").partitionBy("is_state").parquet(staged)
            rows = spark.read.schema(f"{KEYED}, old boolean, new_before boolean, is_state boolean").parquet(staged)
            own, after = rows.where("NOT is_state").alias("r"), rows.where("is_state").alias("s")
            same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*_KEY, "position")]
            # on key and position together, of which a hot key has as many as it has rows, so no partition grows with it
            firsts = after.where(F.col("position") != BEFORE)
            judged = own.join(firsts, same[0] & same[1] & same[2] & same[3], "left").select(
                *(F.col(f"r.{c}") for c in (*_KEY, "position")), F.when(F.col("r.key").isNotNull(), F.col("s.is_state").isNull()).alias("is_repeat"), F.col("s.old").alias("old")
            )
            judged.write.mode("overwrite").parquet(f"{self.root}/judged/batch={number}")
            written = spark.read.schema(f"{KEYED}, is_repeat boolean, old boolean").parquet(f"{self.root}/judged/batch={number}")
            found = written.where("NOT is_repeat").select(*_KEY, "position", "old").distinct()
            found.write.mode("overwrite").parquet(f"{self.root}/firsts/batch={number}")
            # keys of earlier batches whose first is now another
            moved = found.where("old").select(*_KEY, "position").unionByName(after.where("old AND new_before").select(*_KEY, "position"))
            moved.write.mode("overwrite").parquet(f"{self.root}/moved/batch={number}")
            moved = spark.read.schema(KEYED).parquet(f"{self.root}/moved/batch={number}")
            if not moved.isEmpty():
                earlier = self._read("firsts", KEYED, spark).where(F.col("batch") < number)
                m, e = moved.alias("m"), earlier.alias("e")
                at = [F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}")) for c in _KEY]
                m.join(e, at[0] & at[1] & at[2] & (F.col("e.position") > F.col("m.position"))).select("e.*").drop("batch").distinct().write.mode("overwrite").parquet(f"{self.root}/corrections/batch={number}")
            storage.discard(spark, staged)

        query = (
            records.unionByName(touched).writeStream.outputMode("update").foreachBatch(judge).queryName(f"seen-{uuid.uuid4().hex[:8]}")
            .option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def judged(self) -> DataFrame:
        """Every record observed so far with ``is_repeat``: false for the first of a key, true for the others, null without a key.

        Rows that share key and position are one occurrence; rows of unknown (null) position come after all others.
        """
        rows = self._read("judged", f"{KEYED}, is_repeat boolean").drop("batch")
        corrections = self._read("corrections", KEYED)
        if storage.exists(self.spark, f"{self.root}/corrections"):
            r, c = rows.alias("r"), corrections.select(*_KEY, "position", F.lit(True).alias("corrected")).distinct().alias("c")
            at = [F.col(f"r.{x}").eqNullSafe(F.col(f"c.{x}")) for x in (*_KEY, "position")]
            rows = r.join(c, at[0] & at[1] & at[2] & at[3], "left").select(*(F.col(f"r.{x}") for x in (*_KEY, "position")), (F.col("r.is_repeat") | F.coalesce("c.corrected", F.lit(False))).alias("is_repeat"))
        return rows.withColumn("position", F.nullif("position", F.lit(UNKNOWN)))


def keyed_rows(df: DataFrame, feed: str, scope: str | None, key: str, position: str | None) -> DataFrame:
    """``df`` in the form of ``KEYED``; without ``position`` its rows lie before all records to be judged."""
    return df.select(
        F.lit(feed).alias("feed"), (F.col(scope) if scope else F.lit("")).cast("string").alias("scope"), F.col(key).cast("string").alias("key"),
        (F.coalesce(F.col(position).cast("bigint"), F.lit(UNKNOWN)) if position else F.lit(BEFORE).cast("bigint")).alias("position"),
    )


def stream_of(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A parquet table, a folder or a single file, as a stream of its files, so many in each micro-batch."""
    return spark.readStream.schema(spark.read.parquet(storage.as_pattern(path)).schema).option("maxFilesPerTrigger", files_per_batch).parquet(storage.as_pattern(path))


def judge_feeds(
    spark: SparkSession, history: list[tuple[str, str, str | None, str]], records: list[tuple[str, str, str | None, str, str]], root: str | None = None,
    files_per_batch: int = FILES_PER_BATCH, partitions: int | None = None,
) -> DataFrame:
    """Judge all records of several feeds in one pass; with a ``root`` used before, those that are new since then as well.

    ``history``: (path, feed, scope column, key column); ``records``: the same and the column of arrival order.
    Columns of the result: feed, scope, key, position, is_repeat. A null key gives null, an empty one is a key.
    """
    own = state_session(spark, partitions)
    streams = [keyed_rows(stream_of(own, p, files_per_batch), feed, scope, key, None) for p, feed, scope, key in history]
    streams += [keyed_rows(stream_of(own, p, files_per_batch), *rest) for p, *rest in records]
    together = streams[0]
    for s in streams[1:]:
        together = together.unionByName(s)
    seen = SeenKeys(spark, root)
    seen.observe(together)
    return seen.judged()


def error_rate(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of answers per feed that differ from ``truth`` (feed, position, is_repeat), counting missing ones as wrong."""
    a, t = answers.select("feed", "position", F.col("is_repeat").alias("said")), truth.select("feed", "position", "is_repeat")
    both = t.join(a, ["feed", "position"], "full_outer")
    wrong = F.sum((~F.col("said").eqNullSafe(F.col("is_repeat"))).cast("long"))
    return both.groupBy("feed").agg(F.count("*").alias("records"), wrong.alias("wrong"), (wrong / F.count("*")).alias("error_rate"))
