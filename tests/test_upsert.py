import datetime as dt
import random

import pytest

from stratafold import storage
from stratafold.operators import upsert
from stratafold.streaming import feed

SCHEMA = "feed_pos bigint, table_name string, entry_key string, kind string, put_value string, sequence_number bigint, arrived_at timestamp"
NOW = dt.datetime(2031, 3, 1)


def feed_of(spark, rows):
    return spark.createDataFrame([(*r, NOW) for r in rows], SCHEMA)


def state_of(df):
    return {(r.table_name, r.entry_key): (r.sequence_number, r.is_delete, r.put_value) for r in df.collect()}


def test_order_repeats_and_dirt(spark):
    rows = [
        (1, "t", "a", "Put", "1", 10), (2, "t", "a", " DELETE ", "left over", 12), (3, "t", "a", "put", "2", 11), (4, "t", "a", "put", "1", 10),
        (5, "t", "b", "pUt\t", "", 5), (6, "t", "B", "put", "x", 5), (7, "u", "a", "put", "other table", 1), (8, "t", None, "put", "x", 1), (9, "t", "c", "put", None, 3),
        (10, "t", "d", "put", "x", None), (11, "t", "e", "patch", "x", 1), (12, "t", "f", None, "x", 1), (13, None, "a", "put", "no table", 1), (14, "", "a", "put", "blank table", 1),
        (15, "t", "", "put", "empty key", 2), (16, "t", "g", "delete", None, 1),
    ]
    want = {
        ("t", "a"): (12, True, None), ("t", "b"): (5, False, ""), ("t", "B"): (5, False, "x"), ("u", "a"): (1, False, "other table"),
        (None, "a"): (1, False, "no table"), ("", "a"): (1, False, "blank table"), ("t", ""): (2, False, "empty key"), ("t", "g"): (1, True, None),
    }
    random.Random(1).shuffle(rows)
    assert state_of(upsert.apply_changes(feed_of(spark, rows), buckets=3)) == want


def test_ties_go_to_the_earlier_arrival(spark):
    rows = [(5, "t", "a", "put", "later", 1), (2, "t", "a", "put", "earlier", 1), (2, "t", "a", "put", "earlier", 1), (None, "t", "a", "put", "unknown", 1)]
    for shift in range(4):
        assert state_of(upsert.apply_changes(feed_of(spark, rows[shift:] + rows[:shift]).repartition(4))) == {("t", "a"): (1, False, "earlier")}


def test_hot_key_and_long_values(spark):
    rows = [(i, "t", "hot" if i % 3 else f"k{i}", "put", "x" * (200_000 if i == 7 else 3), i) for i in range(3000)]
    got = state_of(upsert.apply_changes(feed_of(spark, rows).repartition(7)))
    assert len(got) == 1001 and got["t", "hot"][0] == 2999


def test_empty(spark):
    assert state_of(upsert.apply_changes(feed_of(spark, []))) == {}


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    df = feed_of(spark, [(1, "t", "a", "put", "v", 1)])
    for name in ("is_delete", "op", "incoming", "kept", "no_table"):
        df = df.withColumn(name, F.lit("?"))
    assert state_of(upsert.apply_changes(df)) == {("t", "a"): (1, False, "v")}


def test_later_run_continues_the_state(spark):
    root = storage.workspace(spark, "test-state")
    first = upsert.apply_changes(feed_of(spark, [(1, "t", "a", "delete", None, 5), (2, "t", "b", "put", "x", 1)]), root)
    second = upsert.apply_changes(feed_of(spark, [(3, "t", "a", "put", "late", 4), (4, "t", "b", "put", "y", 2)]), root, first)
    assert state_of(second) == {("t", "a"): (5, True, None), ("t", "b"): (2, False, "y")}
    assert storage.published(spark, root, "state").endswith("/v2/state")


def test_failed_run_publishes_nothing(spark, monkeypatch):
    root = storage.workspace(spark, "test-state")
    upsert.apply_changes(feed_of(spark, [(1, "t", "a", "put", "x", 1)]), root)

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(storage, "write_text", fail)
    with pytest.raises(OSError):
        upsert.apply_changes(feed_of(spark, [(2, "t", "a", "put", "y", 2)]), root)
    monkeypatch.undo()
    assert state_of(spark.read.parquet(storage.published(spark, root, "state"))) == {("t", "a"): (1, False, "x")}
    upsert.apply_changes(feed_of(spark, [(2, "t", "a", "put", "y", 2)]), root)
    assert state_of(spark.read.parquet(storage.published(spark, root, "state"))) == {("t", "a"): (2, False, "y")}


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, r.choice("tu"), r.choice("abcdef"), r.choice(["put", "delete", "Put "]), str(i), r.randrange(60)) for i in range(300)]
    seq = {}
    rows = [seq.setdefault((t, k, s), (p, t, k, kind, v, s)) for p, t, k, kind, v, s in rows]
    want = state_of(upsert.apply_changes(feed_of(spark, rows)))
    r.shuffle(rows)
    for n in range(5):
        feed_of(spark, rows[n::5]).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    root = storage.workspace(spark, "test-stream")
    assert state_of(feed.apply_stream(feed.file_stream(spark, str(tmp_path / "feed"), 1), root)) == want
    assert state_of(feed.apply_stream(feed.file_stream(spark, str(tmp_path / "feed"), 1), root)) == want


def test_stream_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    root = storage.workspace(spark, "test-stream")
    path = str(tmp_path / "feed")
    feed_of(spark, [(i, "t", f"k{i}", "put", "x", 1) for i in range(200)]).write.parquet(path)
    feed.apply_stream(feed.file_stream(spark, path), root, buckets=8)
    first = feed.BucketedState(spark, root)._facts()["folders"]
    feed_of(spark, [(500, "t", "k7", "delete", None, 2)]).write.mode("append").parquet(path)
    state = feed.apply_stream(feed.file_stream(spark, path), root, buckets=8)
    second = feed.BucketedState(spark, root)._facts()
    assert len(first) == 8 and sum(first[b] != second["folders"][b] for b in first) == 1 and len(second["left"]) == 1
    assert state_of(state) == {("t", f"k{i}"): (2, True, None) if i == 7 else (1, False, "x") for i in range(200)}
    feed_of(spark, [(501, "t", "k7", "put", "y", 3)]).write.mode("append").parquet(path)
    assert state_of(feed.apply_stream(feed.file_stream(spark, path), root))["t", "k7"] == (3, False, "y")
    assert not storage.exists(spark, f"{root}/{second['left'][0]}")
