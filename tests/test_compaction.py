import datetime as dt
import heapq
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.operators import compaction as C

MANIFEST = "sstable_id bigint, partition_id int, lsm_level int, size_bytes bigint, entry_count bigint, registered_at timestamp"
ENTRIES = "sstable_id bigint, entry_key string, sequence_number bigint, kind string, value_bytes int"
NOW = dt.datetime(2031, 3, 1)


def tables(spark, files, entries):
    return spark.createDataFrame([(*f, 0, NOW) for f in files], MANIFEST), spark.createDataFrame(entries, ENTRIES)


def after(spark, manifest, entries, **how):
    root = C.compact(manifest, entries, **how)
    inputs = spark.read.parquet(storage.published(spark, root, "inputs"))
    outputs = spark.read.parquet(storage.published(spark, root, "outputs"))
    held = sorted(map(tuple, C.records_after(root, manifest, entries).collect()), key=repr)
    return {r.sstable_id for r in inputs.collect()}, outputs.collect(), held


def test_small_files_become_few(spark):
    r = random.Random(5)
    files = [(i, i % 2, 0, r.randrange(50, 900)) for i in range(200)] + [(900, 0, 0, 50_000), (901, 3, 1, 10), (902, 0, 0, None)]
    entries = [(i, f"k{r.randrange(40)}", 1000 * i + n, "Put", 5) for i, *_ in files for n in range(r.randrange(0, 6))]
    manifest, held = tables(spark, files, entries)
    inputs, outputs, got = after(spark, manifest, held, target_bytes=20_000)
    assert inputs == set(range(200))
    assert len(outputs) < 15
    place = {i: (p, lv) for i, p, lv, _ in files}
    assert got == sorted([(*place[i], *rest) for i, *rest in entries], key=repr)


def test_copies_of_records_are_held_once(spark):
    files = [(1, 0, 0, 100), (2, 0, 0, 100), (3, 0, 0, 99_999), (4, 0, 1, 100)]
    entries = [(1, "a", 1, "Put", 3), (2, "a", 1, "Put", 3), (2, "b", 2, "Delete", None), (3, "b", 2, "Delete", None), (4, "a", 1, "Put", 3), (1, None, 7, "Put", 1), (2, None, None, "Put", 1), (1, None, None, "Put", 1)]
    _, _, got = after(spark, *tables(spark, files, entries), target_bytes=100)
    assert got == sorted([(0, 0, "a", 1, "Put", 3), (0, 0, "b", 2, "Delete", None), (0, 1, "a", 1, "Put", 3), (0, 0, None, 7, "Put", 1), (0, 0, None, None, "Put", 1)], key=repr)


def test_rows_registered_twice_unknown_sizes_and_null_places(spark):
    manifest, entries = tables(spark, [(1, None, 0, 10), (2, None, 0, 10), (3, 5, None, 10), (None, 5, None, 10), (4, 6, 0, C.SMALL_BYTES), (5, 6, 0, 1)], [(1, "x", 1, "Put", 1), (3, "y", 1, "Put", 1)])
    inputs, _, got = after(spark, manifest.unionByName(manifest), entries)
    assert inputs == {1, 2} and len(got) == 2


def test_empty_tables_and_files(spark):
    assert after(spark, *tables(spark, [], [])) == (set(), [], [])
    inputs, outputs, got = after(spark, *tables(spark, [(1, 0, 0, 5), (2, 0, 0, 5)], []))
    assert (inputs, outputs, got) == ({1, 2}, [], [])


def test_extra_columns_with_clashing_names(spark):
    manifest, entries = tables(spark, [(1, 0, 0, 5), (2, 0, 0, 5)], [(1, "a", 1, "Put", 1)])
    for name in ("files", "shard", "slot", "group_key", "f"):
        manifest, entries = manifest.withColumn(name, F.lit(1)), entries.withColumn(name, F.lit("?")).withColumn("size_bytes", F.lit(1))
    assert after(spark, manifest, entries)[2] == [(0, 0, "a", 1, "Put", 1)]


def test_many_row_groups_in_order(spark, monkeypatch):
    monkeypatch.setattr(C, "ROW_GROUP", 100)
    files = [(i, 0, 0, 100) for i in range(10)]
    entries = [(i, f"k{n % 7}", n * 10 + i, "Put", 1) for i in range(10) for n in range(200)]
    manifest, held = tables(spark, files, entries)
    root = C.compact(manifest, held)
    data = spark.read.parquet(storage.published(spark, root, "data")).toPandas()
    assert len(data) == 2000
    assert data.equals(data.sort_values(["entry_key", "sequence_number"], ascending=[True, False]).reset_index(drop=True))


def test_loss_is_noticed(spark, monkeypatch):
    manifest, entries = tables(spark, [(1, 0, 0, 5), (2, 0, 0, 5)], [(1, "a", 1, "Put", 1), (2, "b", 2, "Put", 1)])
    true = C._of_files
    monkeypatch.setattr(C, "_of_files", lambda *a: true(*a).limit(1))
    root = storage.workspace(spark, "test-compaction")
    with pytest.raises(C.VerificationError):
        C.compact(manifest, entries, root)
    assert not storage.exists(spark, f"{root}/CURRENT")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 9))
def test_dealing_balances(sizes, slots):
    at = C.deal_longest_first(sizes, slots)
    loads = [sum(s for s, a in zip(sizes, at, strict=True) if a == n) for n in range(slots)]
    assert max(loads) <= sum(sizes) / slots + max(sizes, default=0)
    assert heapq.nsmallest(1, at + [0])[0] >= 0


def test_crowded_partition_is_dealt_in_shards(spark):
    files = [(i, 0, 0, 100) for i in range(300)]
    plan = C.plan_groups(tables(spark, files, [])[0], target_bytes=1000, shard_files=50).collect()
    assert len(plan) == 300 and len({r.shard for r in plan}) == 6
