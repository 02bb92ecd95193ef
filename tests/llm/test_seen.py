import random

import pytest

from stratafold.llm import seen

SCHEMA = "record_no bigint, table_name string, entry_key string, extra string, feed string, position bigint, key string"


def write(spark, path, rows, files=1):
    df = spark.createDataFrame([(n, t, k, "?", "?", -5, "?") for n, t, k in rows], SCHEMA)
    df.repartition(files).write.mode("append").parquet(path)
    return path


def judged(spark, old, new, root=None):
    df = seen.judge_feeds(spark, [(old, "entry", "table_name", "entry_key")], [(new, "entry", "table_name", "entry_key", "record_no")], root)
    return {(r.scope, r.key, r.position): r.is_repeat for r in df.collect()}


def brute(old, new):
    before = {(t, k) for _, t, k in old}
    return {(t, k, n): None if k is None else ((t, k) in before or any(m < n and (u, j) == (t, k) for m, u, j in new)) for n, t, k in new}


def test_against_brute_force(spark, tmp_path):
    old = [(i, "t", f"k{i}") for i in range(40)] + [(99, "u", "only u"), (98, "t", None), (97, None, "no table")]
    new = [(i, "t", "hot" if i % 3 == 0 else f"k{i}") for i in range(90)]
    new += [(200, "t", ""), (201, "t", ""), (202, "t", "K1"), (203, "t", "k1 "), (204, "t", None), (205, "t", None), (206, "t", "only u"), (207, None, "no table"), (208, "u", "no table"), (209, "t", "y" * 100_000), (210, "t", "y" * 100_000)]
    got = judged(spark, write(spark, str(tmp_path / "a"), old, 3), write(spark, str(tmp_path / "b"), new, 4))
    assert got == brute(old, new)


def test_repeated_rows_are_one_occurrence(spark, tmp_path):
    new = [(1, "t", "a"), (1, "t", "a"), (2, "t", "a")]
    assert judged(spark, write(spark, str(tmp_path / "a"), []), write(spark, str(tmp_path / "b"), new)) == {("t", "a", 1): False, ("t", "a", 2): True}


def test_unknown_positions_come_last(spark, tmp_path):
    new = [(None, "t", "a"), (7, "t", "a"), (None, "t", "b"), (None, "t", None)]
    got = judged(spark, write(spark, str(tmp_path / "a"), []), write(spark, str(tmp_path / "b"), new))
    assert got == {("t", "a", None): True, ("t", "a", 7): False, ("t", "b", None): False, ("t", None, None): None}


def test_empty(spark, tmp_path):
    assert judged(spark, write(spark, str(tmp_path / "a"), []), write(spark, str(tmp_path / "b"), [])) == {}


def test_state_outlives_runs_and_order_of_files(spark, tmp_path):
    """Later files may hold earlier records; the answer is as if all had come in order."""
    old, new, root = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "state")
    write(spark, old, [(1, "t", "x")])
    late = [(5, "t", "a"), (6, "t", "b"), (7, "t", "x")]
    write(spark, new, late)
    assert judged(spark, old, new, root) == brute([(1, "t", "x")], late)
    early = [(1, "t", "a"), (2, "t", "c"), (3, "t", "c")]
    write(spark, new, early)
    assert judged(spark, old, new, root) == brute([(1, "t", "x")], late + early)


def test_many_batches_and_restarts(spark, tmp_path):
    """A file of each input in a micro-batch, in any order, and a restart between: as if all had come at once."""
    r = random.Random(5)
    old, new, root = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "state")
    history, records = [], []
    for part in range(2):
        late = [(i, r.choice("tu"), f"k{r.randrange(30)}") for i in range(12)]
        some = [(r.randrange(10**6), r.choice(["t", "u", None]), r.choice([f"k{r.randrange(60)}", "hot", "hot", None])) for _ in range(150)]
        write(spark, old, late, 3)
        write(spark, new, some, 5)
        history, records = history + late, records + some
        df = seen.judge_feeds(spark, [(old, "entry", "table_name", "entry_key")], [(new, "entry", "table_name", "entry_key", "record_no")], root, files_per_batch=1)
        assert {(x.scope, x.key, x.position): x.is_repeat for x in df.collect()} == brute(history, records)
        assert df.count() == len(records)
    batches = [p for p in (tmp_path / "state" / "judged").iterdir() if p.name.startswith("batch=")]
    assert len(batches) >= 10 and not list((tmp_path / "state").glob("staged-*"))


def test_paths_with_letters_of_patterns(spark, tmp_path):
    folder = tmp_path / "a{1},[x]*"
    folder.mkdir()
    new = [(1, "t", "a"), (2, "t", "a")]
    got = judged(spark, write(spark, str(folder / "old"), []), write(spark, str(folder / "new"), new) + "/")
    assert got == {("t", "a", 1): False, ("t", "a", 2): True}


def test_settings_are_restored(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    judged(spark, write(spark, str(tmp_path / "a"), []), write(spark, str(tmp_path / "b"), [(1, "t", "a")]))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_error_rate(spark):
    said = spark.createDataFrame([("f", 1, True), ("f", 2, False), ("f", 3, None)], "feed string, position bigint, is_repeat boolean")
    truth = spark.createDataFrame([("f", 1, True), ("f", 2, True), ("f", 3, None), ("f", 4, False)], "feed string, position bigint, is_repeat boolean")
    r = seen.error_rate(said, truth).first()
    assert (r.records, r.wrong) == (4, 2) and r.error_rate == pytest.approx(0.5)
