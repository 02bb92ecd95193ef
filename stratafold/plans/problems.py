"""Queries p4_ and p5_: compaction and the change feed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.operators import compaction, upsert


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _compacted(spark: SparkSession, d: str) -> tuple[str, DataFrame, DataFrame]:
    manifest, entries = _table(spark, d, "sstables"), _table(spark, d, "sstable_entries")
    return compaction.compact(manifest, entries), manifest, entries


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the published manifest of a compaction replaces."""
    root, _, _ = _compacted(spark, d)
    return spark.read.parquet(storage.published(spark, root, "inputs")).select("sstable_id")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record held after the compaction, by partition and level."""
    return compaction.records_after(*_compacted(spark, d))


def p4_outputs(spark: SparkSession, d: str) -> DataFrame:
    """What a compaction writes for each partition and level: records, and the range they cover."""
    root, _, _ = _compacted(spark, d)
    place = F.concat_ws("-", F.split_part("group_key", F.lit("-"), F.lit(1)), F.split_part("group_key", F.lit("-"), F.lit(2)))
    files = spark.read.parquet(storage.published(spark, root, "outputs")).groupBy(place.alias("place"))
    return files.agg(
        F.sum("rows").alias("records"), F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"), F.min("min_sequence").alias("min_sequence"), F.max("max_sequence").alias("max_sequence")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each live key with the sequence number of its newest change."""
    return upsert.current_rows(upsert.apply_changes(_table(spark, d, "wal_entries"))).drop("put_value")


def p5_state(spark: SparkSession, d: str) -> DataFrame:
    """The whole state, tombstones included."""
    return upsert.apply_changes(_table(spark, d, "wal_entries")).select("table_name", "entry_key", "sequence_number", "is_delete", "put_value")


QUERIES = {"p4_found": p4_found, "p4_records": p4_records, "p4_outputs": p4_outputs, "p5_found": p5_found, "p5_state": p5_state}

_FILES = "files AS (SELECT DISTINCT sstable_id, partition_id, lsm_level, size_bytes FROM sstables WHERE sstable_id IS NOT NULL)"
_VALID = r"""
valid AS (
    SELECT table_name, entry_key, sequence_number, feed_pos, lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) AS op, put_value
    FROM wal_entries WHERE entry_key IS NOT NULL AND sequence_number IS NOT NULL),
newest AS (
    SELECT * FROM valid WHERE op = 'delete' OR op = 'put' AND put_value IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY table_name, entry_key ORDER BY sequence_number DESC, feed_pos) = 1)"""

ORACLES = {
    "p4_found": f"""
WITH {_FILES}, small AS (
    SELECT sstable_id, count(*) OVER (PARTITION BY partition_id, lsm_level) AS n FROM files WHERE size_bytes < {compaction.SMALL_BYTES})
SELECT sstable_id FROM small WHERE n > 1""",
    "p4_records": f"""
WITH {_FILES}
SELECT DISTINCT partition_id, lsm_level, entry_key, sequence_number, kind, value_bytes
FROM sstable_entries JOIN files USING (sstable_id)""",
    "p4_outputs": f"""
WITH {_FILES}, small AS (
    SELECT sstable_id, count(*) OVER (PARTITION BY partition_id, lsm_level) AS n FROM files WHERE size_bytes < {compaction.SMALL_BYTES}),
held AS (
    SELECT partition_id, lsm_level, entry_key, sequence_number, bool_and(sstable_id IN (SELECT sstable_id FROM small WHERE n > 1)) AS moved
    FROM sstable_entries JOIN files USING (sstable_id) GROUP BY ALL)
SELECT 'p' || coalesce(partition_id::VARCHAR, 'null') || '-L' || coalesce(lsm_level::VARCHAR, 'null') AS place, count(*) AS records, min(entry_key) AS smallest_key, max(entry_key) AS largest_key,
       min(sequence_number) AS min_sequence, max(sequence_number) AS max_sequence FROM held WHERE moved GROUP BY 1""",
    "p5_found": f"WITH {_VALID} SELECT table_name, entry_key, sequence_number FROM newest WHERE op = 'put'",
    "p5_state": f"""
WITH {_VALID}
SELECT table_name, entry_key, sequence_number, op = 'delete' AS is_delete, CASE WHEN op = 'put' THEN put_value END AS put_value FROM newest""",
}
