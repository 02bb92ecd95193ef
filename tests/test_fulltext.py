import pytest
from pyspark.sql import functions as F

from stratafold.functions import text
from stratafold.operators import fulltext, partitioning
from stratafold.operators.fulltext import TextIndex
from stratafold.sources import jsondocs

BIO = [("u1", "hello world", "a"), ("u2", "foo bar", None), ("u3", "hello there", "hello"), ("u4", None, None), ("u5", "The running men", "")]


def keys(df):
    return sorted(r[0] for r in df.collect())


def T(term, field="bio"):
    return fulltext.Term(field, term)


def test_boolean_search(spark, tmp_path):
    df = spark.createDataFrame(BIO, "k string, bio string, note string")
    for index in (TextIndex.build(df, "k", "bio", "note"), TextIndex.build(df, "k", "bio", "note").write(str(tmp_path / "index"))):
        assert keys(index.search(T("hello"))) == ["u1", "u3"]
        assert keys(index.search(T("hello") & T("there"))) == ["u3"] and keys(index.search(T("world") | T("bar"))) == ["u1", "u2"]
        assert keys(index.search(T("hello") - T("world"))) == ["u3"] and keys(index.search(T("hello", "note"))) == ["u3"]
        assert keys(index.search(T("Hello"))) == [] and keys(index.search(T("hello") - T("hello"))) == []
    later = TextIndex.build(df, "k", "bio").updated(df.where("k IN ('u1', 'u3')"), spark.createDataFrame([("u1", "totally different", "")], "k string, bio string, note string"), "bio")
    assert keys(later.search(T("hello"))) == [] and keys(later.search(T("different"))) == ["u1"]


def test_stop_words_and_stems(spark):
    df = spark.createDataFrame(BIO, "k string, bio string, note string")
    index = TextIndex.build(df, "k", "bio", stop=text.STOP_WORDS, stemmed=True)
    assert keys(index.search(T("runs"))) == ["u5"] and keys(index.search(T("the"))) == [] and keys(index.search(T("hello") | T("the"))) == ["u1", "u3"]
    deep = T("x")
    for _ in range(70):
        deep = deep & T("y")
    with pytest.raises(ValueError):
        index.search(deep)


def test_term_indexes_and_positions(spark):
    df = spark.createDataFrame([(1, 7, bytearray(b"x"), ["a", "a", None]), (2, 7, None, None), (3, None, bytearray(b"y"), [])], "k int, n bigint, b binary, l array<string>")
    assert sorted(map(tuple, fulltext.term_index(df, "k", "n").collect())) == [(7, 1), (7, 2)]
    assert fulltext.term_index(df, "k", "b").count() == 2 and [tuple(r) for r in fulltext.term_index(df, "k", "l").collect()] == [("a", 1)]
    words = spark.createDataFrame([(1, "a b a"), (2, None)], "k int, t string")
    assert {(r.term, r.k): r.positions for r in fulltext.positions(words, "k", "t").collect()} == {("a", 1): [1, 3], ("b", 1): [2]}


def test_merge_by_score(spark):
    a = spark.createDataFrame([("x", 1.0), ("n", float("nan"))], "k string, s double")
    b = spark.createDataFrame([("y", 2.0), ("w", 1.0)], "k string, s double")
    assert [r.k for r in partitioning.gathered_by_score([a, b], "k", "s", 4).collect()] == ["y", "w", "x", "n"]
    space = partitioning.RangePartitions(["a", "m", "z"])
    owners = partitioning.owners_of_range(space, "t/", "a", "z", ["n1", "n2", "n3"])
    ids = spark.createDataFrame([("t/0",), ("t/1",)], "id string").select("id", partitioning.owners(F.col("id"), ["n1", "n2", "n3"])[0].alias("o")).collect()
    assert owners == {int(r.id[2:]): r.o for r in ids}


def test_json_equality(spark):
    pairs = [('{"a":1,"b":[1.0]}', '{"b":[1],"a":1.00}', True), ("1", "true", False), ("[1,2]", "[2,1]", False), ('"x"', '"x"', True), ("null", "null", True), ("{", "{", None), (None, "1", None), ("1e2", "100", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", jsondocs.json_equal("a", "b")).collect())
