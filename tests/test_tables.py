import pytest
from pyspark.sql import functions as F

from stratafold import predicate as P
from stratafold import storage
from stratafold.crypto import CryptoError, Keys
from stratafold.engine import Engine, TableExistsError, TableNotFoundError
from stratafold.functions import text, vector
from stratafold.operators import fulltext, partitioning, versions
from stratafold.schema import BOOLEAN, FLOAT16, FLOAT32, INT16, INT32, INT64, STRING, ArrayOf, BoundedString, Field, ObjectOf, SchemaError, TableSchema, VectorOf
from stratafold.table import DuplicateKeyError, KeyNotFoundError, Table, UniqueViolationError

KEYS = Keys({1: b"k" * 32, 2: b"l" * 32})
USERS = TableSchema("users", 1, (Field("name", STRING), Field("age", INT32), Field("email", STRING)))
ROWS = "_key string, name string, age int, email string"


@pytest.fixture
def table(spark):
    return Table(spark, storage.workspace(spark, "test-table"), USERS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_life_of_a_row(spark, table):
    assert table.current().count() == 0
    table.create(frame(spark, ("a", "Alice", 30, "a@x"), ("b", "Bob", 25, None), ("c", "Carol", 40, "c@x")))
    table.update(frame(spark, ("a", None, 31, None)), "PATCH")
    table.update(frame(spark, ("b", "Bobby", None, None)))
    table.delete(frame(spark, ("c", None, None, None), ("never there", None, None, None)))
    want = [("a", "Alice", 31, "a@x"), ("b", "Bobby", None, None)]
    assert rows(table.current()) == want
    assert rows(table.get("a")) == want[:1] and rows(table.get("c")) == []
    assert [r._key for r in table.scan("a", "b").collect()] == ["a"] and [r._key for r in table.scan("b").collect()] == ["b"]
    assert rows(table.query().where("age").gte(31).execute()) == want[:1]
    assert rows(table.sql("SELECT name AS n FROM users WHERE age > ?", [1])) == [("Alice",)]
    top = table.compact()
    assert rows(table.current()) == want and table.compact() == top
    table.create(frame(spark, ("c", "Again", 1, None)))
    assert rows(table.current()) == [*want, ("c", "Again", 1, None)]
    assert [r._key for r in table.changes_since(top).collect()] == ["c"]
    table.compact()
    assert rows(table.current()) == [*want, ("c", "Again", 1, None)]


def test_refused_mutations(spark, table):
    table.create(frame(spark, ("a", "Alice", 30, "a@x")))
    before = rows(table.current())
    with pytest.raises(DuplicateKeyError):
        table.create(frame(spark, ("a", "x", 1, None)))
    with pytest.raises(DuplicateKeyError):
        table.create(frame(spark, ("b", "x", 1, None), ("b", "y", 1, None)))
    with pytest.raises(KeyNotFoundError):
        table.update(frame(spark, ("z", "x", 1, None)))
    with pytest.raises(SchemaError):
        table.create(frame(spark, (None, "x", 1, None)))
    with pytest.raises(ValueError):
        table.update(frame(spark, ("a", "x", 1, None)), "MERGE")
    assert rows(table.current()) == before


def test_two_writers_cannot_take_one_number(spark, table):
    table.create(frame(spark, ("a", "x", 1, None)))
    other = Table(spark, table.path, USERS)
    other._batches = lambda: []
    with pytest.raises(FileExistsError):
        other.delete(frame(spark, ("a", None, None, None)))
    assert table.current().count() == 1


def test_unique_index(spark, table):
    table.create_index("email", "UNIQUE")
    table.create(frame(spark, ("a", "x", 1, "e"), ("b", "y", 1, None), ("c", "z", 1, None)))
    with pytest.raises(UniqueViolationError):
        table.create(frame(spark, ("d", "x", 1, "e")))
    with pytest.raises(UniqueViolationError):
        table.update(frame(spark, ("b", None, None, "e")), "PATCH")
    table.update(frame(spark, ("a", "x", 1, "f"), ("b", "y", 1, "e")))
    table.delete(frame(spark, ("b", None, None, None)))
    table.create(frame(spark, ("d", "x", 1, "e")))


def test_index_declarations(spark):
    schema = TableSchema("t", 1, (Field("s", STRING), Field("flag", BOOLEAN), Field("v", VectorOf(3)), Field("n", INT32), Field("secret", STRING, "OPAQUE"), Field("det", STRING, "DETERMINISTIC")))
    t = Table(spark, storage.workspace(spark, "test-table"), schema, keys=KEYS)
    for field, kind, metric in (("s", "EQUALITY", None), ("n", "RANGE", None), ("s", "FULL_TEXT", None), ("v", "VECTOR", "dot"), ("det", "EQUALITY", None), ("det", "FULL_TEXT", None)):
        t.create_index(field, kind, metric)
    for field, kind, metric in (("flag", "EQUALITY", None), ("v", "RANGE", None), ("n", "FULL_TEXT", None), ("v", "VECTOR", None), ("s", "VECTOR", "dot"), ("secret", "EQUALITY", None), ("det", "RANGE", None), ("nope", "RANGE", None), ("s", "HASH", None)):
        with pytest.raises(SchemaError):
            t.create_index(field, kind, metric)


def test_insert_takes_the_first_field_as_key(spark, table):
    table.insert(spark.createDataFrame([("n1", 1, None)], "name string, age int, email string"))
    assert rows(table.current()) == [("n1", "n1", 1, None)]
    with pytest.raises(SchemaError):
        Table(spark, storage.workspace(spark, "test-table"), TableSchema("t", 1, (Field("n", INT32),))).insert(spark.createDataFrame([(1,)], "n int"))


def test_limits_are_checked_on_write(spark):
    schema = TableSchema("t", 1, (Field("code", BoundedString(4)), Field("v", VectorOf(2, FLOAT16)), Field("tags", ArrayOf(BoundedString(2)))))
    t = Table(spark, storage.workspace(spark, "test-table"), schema)
    ddl = "_key string, code string, v array<float>, tags array<string>"
    t.create(spark.createDataFrame([("a", "日", [1.0, 2.0], ["ab", None]), ("b", None, None, None)], ddl))
    for bad in (("c", "日日", None, None), ("c", None, [1.0], None), ("c", None, [1.0, float("nan")], None), ("c", None, [1.0, 1e6], None), ("c", None, [1.0, None], None), ("c", None, None, ["abc"])):
        df = spark.createDataFrame([bad], ddl)
        assert schema.violations(df).count() == 1
        with pytest.raises(Exception, match="breaks the limits"):
            t.create(df)
    assert t.current().count() == 2


def test_schemas():
    for bad in (lambda: TableSchema("", 1), lambda: TableSchema("t", -1), lambda: TableSchema("t", 1, (Field("a", STRING), Field("a", INT32))), lambda: TableSchema("t", 1, (Field(" ", STRING),)), lambda: VectorOf(0), lambda: BoundedString(0), lambda: VectorOf(3, INT32), lambda: TableSchema("t", 1, max_depth=26)):
        with pytest.raises(SchemaError):
            bad()
    deep = STRING
    for _ in range(10):
        deep = ObjectOf((Field("x", deep),))
    with pytest.raises(SchemaError):
        TableSchema("t", 1, (Field("d", deep),))
    nested = STRING
    with pytest.raises(SchemaError):
        for _ in range(33):
            nested = ArrayOf(nested)
    s = TableSchema("t", 3, (Field("a", STRING, "OPAQUE"), Field("v", VectorOf(3, FLOAT16)), Field("o", ObjectOf((Field("l", ArrayOf(FLOAT32)), Field("b", BoundedString(9)))))))
    assert TableSchema.from_json(s.to_json()) == s


def test_engine(spark):
    engine = Engine(spark, storage.workspace(spark, "test-engine"), KEYS)
    assert engine.list_tables() == []
    t = engine.create_table("users", USERS)
    t.create(frame(spark, ("a", "Alice", 30, None)))
    engine.create_encrypted_table("secrets", USERS, {"email": "OPAQUE"}, "bigint")
    assert engine.list_tables() == ["secrets", "users"]
    with pytest.raises(TableExistsError):
        engine.create_table("users", USERS)
    for bad in ("", "a/b", ".x"):
        with pytest.raises(SchemaError):
            engine.create_table(bad, USERS)
    m = engine.table_metadata("secrets")
    assert (m.encrypted, m.key_type, m.schema.field("email").encryption, m.state) == (True, "bigint", "OPAQUE", "READY")
    grown = engine.evolve_table("users", (Field("rank", INT64),))
    assert rows(grown.current()) == [("a", "Alice", 30, None, None)]
    engine.enable_encryption("users", {"email": "OPAQUE"})
    with pytest.raises(CryptoError):
        engine.enable_encryption("users", {"email": "DETERMINISTIC"})
    assert engine.table_metadata("users").encrypted
    engine.register("users")
    assert spark.sql("SELECT name FROM users").first().name == "Alice"
    assert engine.metrics()["tables"] == 2
    engine.drop_table("users")
    assert engine.list_tables() == ["secrets"]
    for missing in ("users", "never"):
        with pytest.raises(TableNotFoundError):
            engine.get_table(missing)


def everything(spark, path):
    """All bytes of the files below a folder."""
    place, fs = storage._hadoop(spark, path)
    files, out = fs.listFiles(place, True), b""
    while files.hasNext():
        name = files.next().getPath().toString()
        out += open(name.split(":", 1)[1], "rb").read()
        if name.endswith(".parquet"):
            for row in spark.read.parquet(name).collect():
                out += repr(row.asDict()).encode()
    return out


SECRETS = TableSchema("secrets", 1, (Field("mail", STRING), Field("size", INT16), Field("note", STRING), Field("bio", STRING), Field("v", VectorOf(4)), Field("tags", ArrayOf(STRING)), Field("code", BoundedString(2))))
SCHEMES = {"mail": "DETERMINISTIC", "size": "ORDER_PRESERVING", "note": "OPAQUE", "bio": "DETERMINISTIC", "v": "DISTANCE_PRESERVING", "tags": "OPAQUE", "code": "ORDER_PRESERVING"}
SECRET_ROWS = "_key string, mail string, size smallint, note string, bio string, v array<float>, tags array<string>, code string"


def secret_frame(spark, n=40):
    made = [(f"k{i:02d}", f"secret{i}@x", i - 20, f"hidden{i}", f"word{i % 7} common", [float(i), 1.0, -2.0, float(i * i % 11)], [f"tagged{i}", "y"], "abcdefgh"[i % 8] + ("" if i % 3 else "z")) for i in range(n)]
    return spark.createDataFrame([*made, ("none", *[None] * 7)], SECRET_ROWS)


NEAR = P.VectorNearest("v", (3.0, 1.0, -2.0, 9.0), 4, "euclidean")
ASKED = [
    P.Eq("mail", "secret7@x"), P.Ne("mail", "secret7@x"), P.Eq("mail", "nobody"), P.Eq("size", -3), P.Gt("size", -3), P.Gte("size", 5), P.Lt("size", -15), P.Lte("size", -15), P.Between("size", -4, 4), P.Gt("size", 5.5), P.Lt("size", -18.5),
    P.Eq("note", "hidden5"), P.FullTextMatch("bio", "word3"), P.FullTextMatch("bio", "common") & P.Lt("size", -10), P.Eq("mail", "secret2@x") | P.Between("size", 17, 30), P.Gt("note", "hidden8"), P.Gte("code", "c"), P.Lt("code", "bz"), P.Eq("code", "a"), P.Between("code", "b", "d"),
]


def test_encrypted_tables_answer_as_plain_ones_and_hold_no_plain_bytes(spark):
    root = storage.workspace(spark, "test-engine")
    engine = Engine(spark, root, KEYS)
    plain, secret = engine.create_table("plain", SECRETS), engine.create_encrypted_table("secret", SECRETS, SCHEMES)
    for t in (plain, secret):
        t.create(secret_frame(spark))
        t.create_index("bio", "FULL_TEXT")
        t.create_index("size", "RANGE")
        t.create_index("mail", "UNIQUE")
    later = secret_frame(spark).where("_key IN ('k03', 'k05')").withColumn("size", F.lit(-15).cast("smallint")).withColumn("bio", F.lit("word3 late"))
    for t in (plain, secret):
        t.update(later)
        t.delete(later.limit(0).select("_key").unionByName(spark.createDataFrame([("k10",)], "_key string")))
    again = engine.get_table("secret")
    for step in range(2):
        for p in ASKED:
            assert sorted(r._key for r in again.select(p).collect()) == sorted(r._key for r in plain.select(p).collect()), p
        assert {r._key for r in again.select(NEAR).collect()} == {r._key for r in plain.select(NEAR).collect()}
        assert rows(again.current().drop("v")) == rows(plain.current().drop("v"))
        bytes_ = everything(spark, f"{root}/secret/data")
        assert not any(w in bytes_ for w in (b"secret7", b"hidden7", b"word3", b"common", b"tagged"))
        with pytest.raises(UniqueViolationError):
            again.create(secret_frame(spark).where("_key = 'k01'").withColumn("_key", F.lit("other")))
        again.compact()
        plain.compact()
    wrong = Table(spark, again.path, again.schema, keys=Keys({2: b"w" * 32}))
    assert wrong.current().where("mail IS NOT NULL OR size IS NOT NULL OR v IS NOT NULL OR tags IS NOT NULL").count() == 0


def test_encryption_of_a_table_with_rows(spark):
    root = storage.workspace(spark, "test-engine")
    engine = Engine(spark, root, Keys({1: b"k" * 32}))
    t = engine.create_table("t", SECRETS)
    t.create(secret_frame(spark))
    t.create_index("bio", "FULL_TEXT")
    before = rows(t.current().drop("v"))
    t = engine.enable_encryption("t", {"bio": "DETERMINISTIC", "note": "OPAQUE", "size": "ORDER_PRESERVING"})
    assert rows(t.current().drop("v")) == before and engine.table_metadata("t").encrypted
    found = everything(spark, f"{root}/t")
    assert b"hidden7" not in found and b"word3" not in found and b"secret7" in found
    rotated = Engine(spark, root, Keys({1: b"k" * 32}).rotated(b"n" * 32))
    t = rotated.get_table("t")
    t.create(secret_frame(spark).where("_key = 'k01'").withColumn("_key", F.lit("new")))
    assert {r._key for r in t.select(P.Between("size", -20, -18)).collect()} == {"k00", "k01", "k02", "new"}
    assert {r._key for r in t.select(P.FullTextMatch("bio", "word1")).collect()} >= {"k01", "new"}
    t.compact(rekey=True)
    kept = Engine(spark, root, rotated.keys.pruned({2})).get_table("t")
    assert kept.current().where("note IS NOT NULL").count() == 41 and {r._key for r in kept.select(P.FullTextMatch("bio", "word1")).collect()} >= {"k01", "new"}
    with pytest.raises(CryptoError):
        Engine(spark, root).get_table("t")


def test_indexes_outlive_handles_and_follow_changes(spark):
    engine = Engine(spark, storage.workspace(spark, "test-engine"))
    t = engine.create_table("t", SECRETS)
    t.create(secret_frame(spark))
    for field, kind, metric in (("bio", "FULL_TEXT", None), ("size", "RANGE", None), ("mail", "EQUALITY", None), ("v", "VECTOR", "euclidean"), ("note", "UNIQUE", None)):
        t.create_index(field, kind, metric)
    t = engine.get_table("t")
    near = [P.VectorNearest("v", (float(i), 1.0, -2.0, 5.0), 6, "euclidean") for i in range(0, 40, 9)]
    every = [*ASKED, *near, near[0] & P.Gt("size", -18), near[1] | P.Eq("mail", "secret30@x")]

    def scanned(p):
        return sorted(r._key for r in P.select(t.current(), p, SECRETS).collect())

    for step in range(3):
        for p in every:
            assert sorted(r._key for r in t.select(p).collect()) == scanned(p), p
        if step == 0:
            moved = secret_frame(spark).where("_key < 'k12'").withColumn("bio", F.lit("word5")).withColumn("v", F.array(*[F.lit(x).cast("float") for x in (9.0, 1.0, -2.0, 5.0)])).withColumn("size", F.lit(3).cast("smallint"))
            t.update(moved)
            t.delete(spark.createDataFrame([("k20",), ("k21",)], "_key string"))
        else:
            t.compact()
    assert t.index_for(P.Eq("mail", "x")).kind == "EQUALITY" and t.index_for(P.Lt("mail", "x")) is None and t.index_for(P.FullTextMatch("bio", "x")).kind == "FULL_TEXT"
    plan = t._lookup(P.FullTextMatch("bio", "word3"))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "regexp_replace" not in plan
    with pytest.raises(UniqueViolationError):
        engine.get_table("t").create(secret_frame(spark).where("_key = 'k30'").withColumn("_key", F.lit("other")))
    t.drop_index("note", "UNIQUE")
    engine.get_table("t").create(secret_frame(spark).where("_key = 'k30'").withColumn("_key", F.lit("other")))


def test_analysers_of_indexes(spark):
    """Tokenizers and stemmers of one's own decide what MATCH finds, before and after the index was built."""
    text.register_analyser("letters", lambda t: F.filter(F.split(F.lower(t), ""), lambda c: c != ""))
    for name, term, want in (("plain", "runs", {"a", "d"}), ("stemmed", "running", {"a", "b", "d"}), ("letters", "z", {"c"}), ("no stop words", "the", set())):
        t = Table(spark, storage.workspace(spark, "test-table"), USERS)
        t.create(frame(spark, ("a", "the runs", 1, None), ("b", "Run!", 1, None), ("c", "zebra", 1, None)))
        t.create_index("name", "FULL_TEXT", analyser=name)
        t.create(frame(spark, ("d", "runs late", 1, None)))
        assert {r._key for r in t.select(P.FullTextMatch("name", term)).collect()} == want
        t.compact()
        assert {r._key for r in t.select(P.FullTextMatch("name", term)).collect()} == want
    with pytest.raises(ValueError):
        t.create_index("name", "FULL_TEXT", analyser="nope")


def test_hot_keys_are_written_by_several_tasks(spark, tmp_path):
    """Nine tenths of the rows lie in one range, have one term, or are nearest to one centroid: no file holds more than twice the median."""
    n = 20_000
    df = spark.range(n).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 500).otherwise(F.col("id") + 1000).alias("k"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("w"), F.col("id"))).otherwise(F.lit("the")).alias("t"))
    partitioning.RangePartitions([0, 500, 1000, 10**9]).write(df, "k", str(tmp_path / "r"))
    fulltext.TextIndex.build(df, "id", "t").write(str(tmp_path / "t"))
    v = df.select("id", F.when(F.col("id") < 4, F.array(F.lit(1.0), F.col("id").cast("double"))).otherwise(F.array(F.lit(9.0), 0.1 * F.rand(1))).cast("array<float>").alias("v"))
    vector.InvertedFile(v, "id", "v", "euclidean", 4).write(str(tmp_path / "v"))
    for place in ("r", "t", "v/lists"):
        sizes = sorted(r.n for r in spark.read.parquet(str(tmp_path / place)).groupBy(F.spark_partition_id(), F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect() if r.n > n // 50)
        assert len(sizes) >= 3 and sizes[-1] <= 2 * sizes[len(sizes) // 2], (place, sizes)


def test_newest_wins(spark):
    log = spark.createDataFrame([("a", 1, "P", "x"), ("a", 3, "P", "z"), ("a", 2, "D", None), ("b", 1, "P", "q"), ("b", 2, "D", None), ("c", 5, "P", None)], "_key string, _seq bigint, _op string, v string")
    assert sorted((r._key, r.v) for r in versions.newest(log).collect()) == [("a", "z"), ("c", None)]
    assert versions.newest(log, keep_deletes=True).count() == 3


def test_range_partitions(spark):
    p = partitioning.RangePartitions.from_ranges([(2, "m", "{"), (1, "a", "m")])
    df = spark.createDataFrame([("alice",), ("m",), ("mallory",), ("zed",), ("{",), ("Alice",), (None,)], "k string")
    assert {r.k: r.p for r in df.select("k", p.route(F.col("k")).alias("p")).collect()} == {"alice": 1, "m": 2, "mallory": 2, "zed": 2, "{": None, "Alice": None, None: None}
    assert p.overlapping("b", "m") == [1] and p.overlapping("l", "n") == [1, 2] and p.route_key("m") == 2
    for bad in (lambda: p.route_key("A"), lambda: p.overlapping("b", "b"), lambda: partitioning.RangePartitions([1]), lambda: partitioning.RangePartitions([1, 1]), lambda: partitioning.RangePartitions.from_ranges([(1, 0, 5), (2, 6, 9)]), lambda: partitioning.RangePartitions([0, 1, 2], [1, 1])):
        with pytest.raises(partitioning.PartitionError):
            bad()


def test_scan_reads_only_the_ranges_it_touches(spark, tmp_path):
    p = partitioning.RangePartitions([0, 10, 20, 30])
    p.write(spark.range(30).withColumnRenamed("id", "k"), "k", str(tmp_path / "r"))
    found = p.scan(spark.read.parquet(str(tmp_path / "r")), "k", 12, 18)
    assert [r.k for r in found.collect()] == list(range(12, 18))
    assert "PartitionFilters" in found._jdf.queryExecution().executedPlan().toString()
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) <= 3


def test_owners(spark):
    nodes = [f"n{i}" for i in range(5)]
    df = spark.createDataFrame([(str(i),) for i in range(2000)] + [(None,)], "id string")
    owner = {r.id: r.o for r in df.select("id", partitioning.owners(F.col("id"), nodes, 3).alias("o")).collect()}
    assert owner.pop(None) is None
    counts = {n: sum(o[0] == n for o in owner.values()) for n in nodes}
    assert min(counts.values()) > 250 and all(len(set(o)) == 3 for o in owner.values())

    def weight(i, n):  # the formula, one number at a time
        h = 0xCBF29CE484222325
        for b in i.encode() + b"\xff" + n.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        h ^= h >> 31
        return h - 2**64 if h >= 2**63 else h

    for i in list(owner)[:50]:
        assert owner[i] == sorted(nodes, key=lambda n: (-weight(i, n), n))[:3]
    moved = {r.id for r in partitioning.reassigned(df.where("id IS NOT NULL"), "id", nodes, nodes[:-1]).collect()}
    assert moved == {i for i, o in owner.items() if o[0] == "n4"}
    with pytest.raises(partitioning.PartitionError):
        partitioning.owners(F.col("id"), [])
