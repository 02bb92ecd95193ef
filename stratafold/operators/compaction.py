"""Consolidating many tiny files into few well-sized ones.

The small files of each (partition, level) are dealt to a fixed number of output groups, longest first onto the
least-loaded group. Each group's records are shuffled together, ordered and streamed through a pyarrow writer, so a
task never holds a group. A manifest is published by one rename, after the written files were read back and verified.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratafold import storage

SMALL_BYTES = 16_384
TARGET_BYTES = 128 << 20
#: Files that one scheduling task deals out; a larger (partition, level) is cut into several such shards.
SHARD_FILES = 50_000
ROW_GROUP = 65_536

_PLAN = "partition_id int, lsm_level int, sstable_id bigint, size_bytes bigint, shard int, slot int"
_WRITTEN = "group_key string, path string, rows bigint, smallest_key string, largest_key string, min_sequence bigint, max_sequence bigint"
_READ = "entry_key string, sequence_number bigint, kind string, value_bytes int"
_RECORD = pa.schema([("entry_key", pa.string()), ("sequence_number", pa.int64()), ("kind", pa.string()), ("value_bytes", pa.int32())])


class VerificationError(RuntimeError):
    """The files written do not hold the records that were to be consolidated; nothing was published."""


def distinct_files(manifest: DataFrame) -> DataFrame:
    """One row for each file id; of rows registered repeatedly the latest holds. Rows without an id are no files."""
    newest = F.max_by(F.struct("partition_id", "lsm_level", "size_bytes"), F.struct(F.col("registered_at"), F.col("size_bytes")))
    return manifest.where(F.col("sstable_id").isNotNull()).groupBy("sstable_id").agg(newest.alias("f")).select("sstable_id", "f.*")


def deal_longest_first(sizes: list[int], slots: int) -> list[int]:
    """A slot for each size: longest first, onto the slot least loaded so far (ties: lowest slot)."""
    heap = [(0, s) for s in range(slots)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, slot = heap[0]
        out[i] = slot
        heapq.heapreplace(heap, (load + sizes[i], slot))
    return out


def plan_groups(manifest: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, shard_files: int = SHARD_FILES) -> DataFrame:
    """Every small file that has a small neighbour in its (partition, level), with its output group.

    A file is small if its size is known and below ``small_bytes``. Null partitions or levels form groups of their own.
    """
    small = distinct_files(manifest).where(F.col("size_bytes") < small_bytes)
    key = [F.col("partition_id"), F.col("lsm_level")]
    totals = small.groupBy(*key).agg(F.count("*").alias("files")).where("files > 1")
    a, b = small.alias("a"), totals.alias("b")
    joined = a.join(b, F.col("a.partition_id").eqNullSafe(F.col("b.partition_id")) & F.col("a.lsm_level").eqNullSafe(F.col("b.lsm_level")))
    shards = F.ceil(F.col("files") / shard_files).cast("long")
    sharded = joined.select("a.*", F.pmod(F.xxhash64("sstable_id"), shards).cast("int").alias("shard"))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sstable_id", kind="stable")
        slots = max(1, -(-int(rows["size_bytes"].sum()) // target_bytes))
        return rows.assign(slot=deal_longest_first(rows["size_bytes"].tolist(), slots))[["partition_id", "lsm_level", "sstable_id", "size_bytes", "shard", "slot"]]

    return sharded.groupBy("partition_id", "lsm_level", "shard").applyInPandas(deal, _PLAN)


def _group_key() -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat_ws("-", F.concat(F.lit("p"), part("partition_id")), F.concat(F.lit("L"), part("lsm_level")), F.col("shard").cast("string"), F.col("slot").cast("string"))


def planned_files(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file with its place and, if it is to be replaced, its group."""
    grouped = plan.select("sstable_id", _group_key().alias("group_key"))
    return distinct_files(manifest).join(grouped, "sstable_id", "left").select("sstable_id", "partition_id", "lsm_level", "group_key")


def owned_records(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Each record of a (partition, level) once, with the group that is to hold it; ``files`` as ``planned_files`` gives them.

    Where copies of a record lie in several files, a file that stays as it is keeps it, else the first group does.
    The key of a record is (entry_key, sequence_number); null keys or numbers are values like any other.
    """
    held = entries.select("sstable_id", "entry_key", "sequence_number", "kind", "value_bytes").join(files, "sstable_id")
    first = F.min(F.struct(F.coalesce("group_key", F.lit("")).alias("g"), "sstable_id", "kind", "value_bytes"))
    one = held.groupBy("partition_id", "lsm_level", "entry_key", "sequence_number").agg(first.alias("r"))
    return one.where(F.col("r.g") != "").select(F.col("r.g").alias("group_key"), "entry_key", "sequence_number", F.col("r.kind").alias("kind"), F.col("r.value_bytes").alias("value_bytes"))


def pyarrow_uri(folder: str) -> str:
    """The folder's URI under the names that pyarrow has for file systems."""
    scheme, mark, rest = folder.partition("://")
    if not mark:
        return folder
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}"


def _stream_groups(folder: str):
    """Writes the runs of equal group keys that arrive in order, one file each, a row group at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(pyarrow_uri(folder))
        store.create_dir(base, recursive=True)
        group, sink, writer, facts, held = None, None, None, None, []

        def flush() -> None:
            nonlocal held
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=ROW_GROUP)
                held = []

        def close() -> pa.RecordBatch | None:
            nonlocal writer
            if writer is None:
                return None
            flush()
            writer.close()
            sink.close()
            writer = None
            return pa.RecordBatch.from_pydict({k: [v] for k, v in facts.items()})

        for batch in batches:
            keys = batch.column("group_key")
            start = 0
            while start < batch.num_rows:
                key = keys[start].as_py()
                stop = start + 1
                if keys[batch.num_rows - 1].as_py() == key:
                    stop = batch.num_rows
                else:
                    while keys[stop].as_py() == key:
                        stop += 1
                if key != group:
                    if (done := close()) is not None:
                        yield done
                    group = key
                    # every attempt of a task writes a name of its own; the manifest names those of the attempt that counted
                    path = f"{base}/{key}-{uuid.uuid4().hex}.parquet"
                    sink = store.open_output_stream(path)
                    writer = pq.ParquetWriter(sink, _RECORD, compression="zstd")
                    facts = {"group_key": key, "path": path, "rows": 0, "smallest_key": None, "largest_key": None, "min_sequence": None, "max_sequence": None}
                part = batch.slice(start, stop - start).select(_RECORD.names).cast(_RECORD)
                held.append(part)
                ks, seqs = part.column("entry_key"), part.column("sequence_number").drop_null()
                known = ks.drop_null()
                if len(known):
                    facts["smallest_key"] = known[0].as_py() if facts["smallest_key"] is None else facts["smallest_key"]
                    facts["largest_key"] = known[len(known) - 1].as_py()
                if len(seqs):
                    low, high = (x.as_py() for x in pa.compute.min_max(seqs).values())
                    facts["min_sequence"] = low if facts["min_sequence"] is None else min(low, facts["min_sequence"])
                    facts["max_sequence"] = high if facts["max_sequence"] is None else max(high, facts["max_sequence"])
                facts["rows"] += part.num_rows
                if sum(x.num_rows for x in held) >= ROW_GROUP:
                    flush()
                start = stop
        if (done := close()) is not None:
            yield done

    import pyarrow.compute  # noqa: F401

    return write


def _marks() -> list[Column]:
    """Count and order-free checksum of records."""
    mark = F.xxhash64("entry_key", "sequence_number", "kind", "value_bytes").cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(mark), F.lit(0)).alias("s")]


def _fingerprint(records: DataFrame) -> tuple[int, int]:
    row = records.agg(*_marks()).first()
    return int(row["n"]), int(row["s"])


def _of_files(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """Records of the files that the manifest names; what a lost attempt of a task left behind is passed over."""
    found = spark.read.schema(_READ).parquet(folder).withColumn("file_name", F.col("_metadata.file_name"))
    return found.join(written.select("file_name", "group_key"), "file_name").drop("file_name")


def compact(manifest: DataFrame, entries: DataFrame, root: str | None = None, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES) -> str:
    """Consolidate the small files and publish the outcome under ``root``; returns ``root``.

    Published folders: ``inputs`` (the files replaced, with their groups), ``outputs`` (the files written) and
    ``data`` (those files). Files not in ``inputs`` stay as they are, copies of a record in two of those included. Files
    without records are replaced by nothing.
    Raises VerificationError, publishing nothing, if the records read back differ from those to be consolidated.
    """
    spark = manifest.sparkSession
    root = root or storage.workspace(spark, "compaction")
    scratch = storage.Scratch(spark, "compaction")
    plan = scratch.keep(plan_groups(manifest, small_bytes, target_bytes), "plan")
    # observed by the tasks that write, each of which counts once however often it is tried
    seen = Observation()
    files = scratch.keep(planned_files(plan, manifest), "files")
    records = scratch.keep(owned_records(files, entries).observe(seen, *_marks()), "records")
    wanted = int(seen.get["n"]), int(seen.get["s"])
    staged = storage.workspace(spark, "compaction-data")
    n = storage.spread(records, 16 << 20)
    ordered = records.repartition(n, "group_key").sortWithinPartitions("group_key", "entry_key", F.col("sequence_number").desc())
    written = scratch.keep(ordered.mapInArrow(_stream_groups(staged), _WRITTEN), "written")
    written = written.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).drop("path")
    anything = storage.exists(spark, staged)
    back = _of_files(spark, staged, written) if anything else records.limit(0)
    if wanted != (found := _fingerprint(back)):
        raise VerificationError(f"records and checksum {wanted} were to be written, {found} were")
    inputs = storage.workspace(spark, "compaction-inputs")
    plan.withColumn("group_key", _group_key()).write.parquet(inputs)
    outputs = storage.workspace(spark, "compaction-outputs")
    written.write.parquet(outputs)
    storage.publish(spark, root, {"inputs": inputs, "outputs": outputs} | ({"data": staged} if anything else {}), {"records": wanted[0]})
    scratch.clear()
    return root


def records_after(root: str, manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """What the store holds after a compaction: the records of the files kept and of the files written."""
    spark = manifest.sparkSession
    replaced = spark.read.parquet(storage.published(spark, root, "inputs"))
    files = distinct_files(manifest).join(replaced.select("sstable_id"), "sstable_id", "left_anti")
    columns = ["partition_id", "lsm_level", "entry_key", "sequence_number", "kind", "value_bytes"]
    kept = entries.select("sstable_id", *columns[2:]).join(files, "sstable_id").select(*columns)
    data = storage.published(spark, root, "data")
    if not storage.exists(spark, data):
        return kept
    group_of = replaced.select("group_key", "partition_id", "lsm_level").distinct()
    new = _of_files(spark, data, spark.read.parquet(storage.published(spark, root, "outputs")))
    return kept.unionByName(new.join(group_of, "group_key").select(*columns))
