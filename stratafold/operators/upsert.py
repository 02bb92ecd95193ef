"""Applying a feed of puts and deletes, whatever the order and number of deliveries.

Deliveries are reduced to one row per key inside each input batch, shuffled by key into buckets, and each
bucket runs an embedded DuckDB whose conditional upsert keeps the change of the greatest sequence number.
Deletes stay in the result as tombstones, so that a late older put cannot revive a key and a later run can
start from the published state. All buckets are published together by one rename.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold import storage

STATE = "table_name string, entry_key string, sequence_number bigint, feed_pos bigint, is_delete boolean, put_value string"
_FIELDS = ["table_name", "entry_key", "sequence_number", "feed_pos", "is_delete", "put_value"]
_ARROW = pa.schema([("table_name", pa.string()), ("entry_key", pa.string()), ("sequence_number", pa.int64()), ("feed_pos", pa.int64()), ("is_delete", pa.bool_()), ("put_value", pa.string())])
#: Estimated input bytes and DuckDB's memory of a bucket.
BUCKET_BYTES = 16 << 20
BUCKET_MEMORY = "500MB"

#: One row of a batch for each key: greatest sequence number; of equal ones the earliest delivery.
_REDUCE = """
SELECT table_name IS NULL AS no_table, coalesce(table_name, '') AS table_name, entry_key, sequence_number,
       coalesce(feed_pos, 9223372036854775807) AS feed_pos, is_delete, put_value
FROM incoming
QUALIFY row_number() OVER (
    PARTITION BY table_name, entry_key
    ORDER BY sequence_number DESC, coalesce(feed_pos, 9223372036854775807), is_delete, put_value NULLS LAST) = 1
"""
_CREATE = """
CREATE TABLE kept (
    no_table BOOLEAN, table_name VARCHAR, entry_key VARCHAR, sequence_number BIGINT, feed_pos BIGINT,
    is_delete BOOLEAN, put_value VARCHAR, PRIMARY KEY (no_table, table_name, entry_key))
"""
_UPSERT = f"""
INSERT INTO kept {_REDUCE}
ON CONFLICT (no_table, table_name, entry_key) DO UPDATE SET
    sequence_number = excluded.sequence_number, feed_pos = excluded.feed_pos,
    is_delete = excluded.is_delete, put_value = excluded.put_value
WHERE excluded.sequence_number > kept.sequence_number
   OR excluded.sequence_number = kept.sequence_number AND (
        excluded.feed_pos < kept.feed_pos
     OR excluded.feed_pos = kept.feed_pos AND (
          excluded.is_delete < kept.is_delete
       OR excluded.is_delete = kept.is_delete AND excluded.put_value < kept.put_value))
"""
_EXPORT = """
SELECT CASE WHEN no_table THEN NULL ELSE table_name END AS table_name, entry_key, sequence_number,
       nullif(feed_pos, 9223372036854775807) AS feed_pos, is_delete, put_value
FROM {source}
"""


def valid_changes(deliveries: DataFrame) -> DataFrame:
    """The deliveries that count, as (table, key, sequence number, arrival, is_delete, value).

    A delivery is ignored if its key or sequence number is null, if its kind does not read put or delete
    (case and outer blanks aside), or if it is a put of a null value. Empty keys and values are ordinary.
    A value on a delete is dropped. Further columns of the feed play no part. A null table is a table of its own.
    """
    kind = F.lower(F.regexp_replace(F.col("kind"), r"^\s+|\s+$", ""))
    return (
        deliveries.select("table_name", "entry_key", "sequence_number", "feed_pos", kind.alias("op"), "put_value")
        .where(F.col("entry_key").isNotNull() & F.col("sequence_number").isNotNull())
        .where((F.col("op") == "delete") | ((F.col("op") == "put") & F.col("put_value").isNotNull()))
        .select("table_name", "entry_key", "sequence_number", "feed_pos", (F.col("op") == "delete").alias("is_delete"), F.when(F.col("op") == "put", F.col("put_value")).alias("put_value"))
    )


def _database():
    """A database in the task's memory. What does not fit spills to where the task's shuffle data spills, which goes with the executor."""
    import duckdb

    scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    spill = f"{scratch}/duckdb-{uuid.uuid4().hex}" if scratch else ""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": spill, "preserve_insertion_order": False})


def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: one row of each key for each batch, so that a hot key costs a row a batch in the shuffle."""
    with _database() as db:
        for batch in batches:
            if batch.num_rows:
                db.register("incoming", pa.Table.from_batches([batch]))
                yield from db.sql(_EXPORT.format(source=f"({_REDUCE})")).to_arrow_table().cast(_ARROW).to_batches()
                db.unregister("incoming")


def upsert_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the state of one bucket in an embedded database."""
    with _database() as db:
        db.execute(_CREATE)
        for batch in batches:
            if batch.num_rows:
                db.register("incoming", pa.Table.from_batches([batch]))
                db.execute(_UPSERT)
                db.unregister("incoming")
        for batch in db.sql(_EXPORT.format(source="kept")).to_arrow_reader(50_000):
            yield from pa.Table.from_batches([batch]).cast(_ARROW).to_batches()


def apply_changes(deliveries: DataFrame, root: str | None = None, state: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Rebuild the newest state of every key from ``deliveries`` and publish it under ``root``.

    ``state`` is an earlier result, tombstones included, that the feed continues. The result has a row for each key
    (columns of ``STATE``); live rows have ``is_delete`` false. Repeated deliveries change nothing, of two changes
    with one sequence number the earlier arrival holds. An empty feed publishes an empty state.
    """
    spark = deliveries.sparkSession
    root = root or storage.workspace(spark, "state")
    changes = valid_changes(deliveries)
    if state is not None:
        changes = changes.unionByName(state.select(*_FIELDS))
    n = buckets or storage.spread(changes, BUCKET_BYTES)
    reduced = changes.mapInArrow(reduce_batches, STATE).repartition(n, "table_name", "entry_key")
    staged = storage.workspace(spark, "state-staged")
    reduced.mapInArrow(upsert_bucket, STATE).write.parquet(staged)
    storage.publish(spark, root, {"state": staged}, {"buckets": n})
    return spark.read.schema(STATE).parquet(storage.published(spark, root, "state"))


def current_rows(state: DataFrame) -> DataFrame:
    """The live rows of a published state."""
    return state.where(~F.col("is_delete")).select("table_name", "entry_key", "sequence_number", "put_value")
