import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratafold import predicate as P
from stratafold import sql
from stratafold.query import Query
from stratafold.schema import BOOLEAN, FLOAT32, FLOAT64, INT8, INT32, INT64, STRING, TIMESTAMP, ArrayOf, BoundedString, Field, TableSchema, VectorOf

F4 = TableSchema("test", 1, (Field("name", STRING), Field("age", INT32)))
F2 = TableSchema("test", 1, (Field("name", STRING), Field("age", INT32), Field("salary", FLOAT64), Field("active", BOOLEAN), Field("created", TIMESTAMP), Field("tiny", INT8), Field("big", INT64), Field("code", BoundedString(4)), Field("tags", ArrayOf(STRING)), Field("embedding", ArrayOf(FLOAT32))))


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("pk1", "Alice", 30), ("pk2", "Bob", 25), ("pk3", "Alice", 35), ("pk4", None, None), ("pk5", "Carol", 20)], "_key string, name string, age int")


def keys(df):
    return sorted(r[0] for r in df.select("_key").collect())


def test_leaves_and_connectives(people):
    run = lambda p: keys(P.select(people, p, F4))
    assert run(P.Eq("name", "Alice")) == ["pk1", "pk3"]
    assert run(P.Eq("name", "Alice") & P.Gte("age", 31)) == ["pk3"]
    assert run(P.Eq("name", "Alice") | P.Eq("name", "Bob")) == ["pk1", "pk2", "pk3"]
    assert run(P.Ne("name", "Alice")) == ["pk2", "pk5"]  # null is not unequal
    assert run(P.Between("age", 20, 25)) == ["pk2", "pk5"]
    assert run(P.Lt("age", 25)) == ["pk5"] and run(P.Lte("age", 25.0)) == ["pk2", "pk5"] and run(P.Gt("age", 30)) == ["pk3"]


def test_builder_is_left_associative(people):
    q = Query(people, F4).where("name").eq("Bob").or_("name").eq("Alice").and_("age").gte(30)
    assert keys(q.execute()) == ["pk1", "pk3"]
    assert isinstance(q.predicate(), P.And) and isinstance(q.predicate().parts[0], P.Or)
    assert Query(people, F4).execute().count() == 0
    with pytest.raises(P.PredicateError):
        q.where("age")


def test_text_match(spark):
    df = spark.createDataFrame([("u1", "hello world"), ("u2", "foo bar"), ("u3", "Hello, there"), ("u4", None), ("u5", "")], "_key string, bio string")
    schema = TableSchema("users", 1, (Field("bio", STRING),))
    run = lambda *a: keys(P.select(df, P.FullTextMatch("bio", *a), schema))
    assert run("hello") == ["u1", "u3"]
    assert run("Hello") == [] and run("hello there") == []
    assert run("Hello there", True) == ["u3"]


def test_nearest_is_a_set_of_the_whole_table(spark):
    df = spark.createDataFrame([("d1", [0.0, 0.0, 0.0], 1), ("d2", [1.0, 1.0, 1.0], 2), ("d3", [10.0, 10.0, 10.0], 1), ("d4", None, 1), ("d5", [float("nan"), 0.0, 0.0], 1), ("d6", [1.0], 1)], "_key string, embedding array<float>, n int")
    schema = TableSchema("docs", 1, (Field("embedding", VectorOf(3)), Field("n", INT32)))
    near = P.VectorNearest("embedding", (0.0, 0.0, 0.0), 2, "euclidean")
    run = lambda p: keys(P.select(df, p, schema))
    assert run(near) == ["d1", "d2"]
    assert run(near & P.Eq("n", 1)) == ["d1"]
    assert run(near | P.Eq("n", 1)) == ["d1", "d2", "d3", "d4", "d5", "d6"]
    assert run(P.And((near, P.VectorNearest("embedding", (9.0, 9.0, 9.0), 2, "euclidean")))) == ["d2"]
    for bad in (P.VectorNearest("embedding", (0.0,), 2), P.VectorNearest("n", (0.0,), 2)):
        with pytest.raises(P.PredicateError):
            run(bad)
    with pytest.raises(P.PredicateError):
        P.VectorNearest("embedding", (0.0,), 0)


@pytest.mark.parametrize("p", [P.Eq("age", "x"), P.Eq("active", 1), P.Eq("name", True), P.Eq("tiny", 128), P.Eq("tags", "x"), P.Eq("missing", 1), P.Between("age", 5, 1), P.FullTextMatch("age", "x"), P.Eq("code", 4)])
def test_refused_predicates(p):
    with pytest.raises(P.PredicateError):
        P.check(p, F2)


def test_timestamps_compare_as_text_and_milliseconds(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2))], "_key string, created timestamp_ntz")
    schema = TableSchema("t", 1, (Field("created", TIMESTAMP),))
    assert keys(P.select(df, P.Gt("created", "2024-01-01 12:00:00"), schema)) == ["b"]
    assert keys(P.select(df, P.Lte("created", 1704067200000), schema)) == ["a"]


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    from stratafold.schema import of_dataframe

    out = sql.execute("SELECT c_name FROM customer WHERE c_acctbal > 100 AND c_mktsegment = 'BUILDING'", df, of_dataframe("customer", df))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,100.0)" in plan and "PushedFilters: [IsNotNull(c_acctbal)" in plan and "c_custkey" not in plan


ACCEPTED = {
    "select name from t": (["name"], None), "SELECT * FROM t WHERE age > 30": ([], P.Gt("age", 30)), "SELECT name FROM t WHERE 30 < age": (["name"], P.Gt("age", 30)),
    "SELECT name FROM t WHERE 30 >= age": (["name"], P.Lte("age", 30)), "SELECT name FROM t WHERE salary >= -1.5": (["name"], P.Gte("salary", -1.5)),
    "SELECT name FROM t WHERE name = 'it''s' OR active = true AND age <> 4": (["name"], P.Or((P.Eq("name", "it's"), P.And((P.Eq("active", True), P.Ne("age", 4)))))),
    "SELECT name FROM t WHERE (name = 'a' OR name = 'b') AND age BETWEEN 1 AND 2.5": (["name"], P.And((P.Or((P.Eq("name", "a"), P.Eq("name", "b"))), P.Between("age", 1, 2.5)))),
    "SELECT name FROM t WHERE MATCH(name, 'x')": (["name"], P.FullTextMatch("name", "x")), "SELECT name FROM t WHERE big = 9223372036854775807": (["name"], P.Eq("big", 2**63 - 1)),
}


@pytest.mark.parametrize("text", ACCEPTED)
def test_translation(text):
    q = sql.translate(text, F2)
    assert (list(q.projections), q.predicate) == ACCEPTED[text]


def test_clauses():
    q = sql.translate("SELECT name AS n, age FROM t WHERE age = ? ORDER BY age DESC, name LIMIT 5 OFFSET 2", F2)
    assert q.aliases == {"name": "n"} and (q.limit, q.offset, q.parameters) == (5, 2, 1)
    assert [(k.of, k.descending) for k in q.order] == [("age", True), ("name", False)]
    d = sql.translate("SELECT name FROM t ORDER BY VECTOR_DISTANCE(embedding, ?, 'cosine') LIMIT 3", F2).vector_distance
    assert (d.field, d.parameter, d.metric) == ("embedding", 0, "cosine")


REFUSED = [
    "", "  ", "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t", "SELECT", "SELECT name", "SELECT name FROM", "SELECT name FROM t extra", "SELECT name, FROM t",
    "SELECT name FROM t WHERE name = 'open", "SELECT name FROM t WHERE name = #", "SELECT name FROM t WHERE nope = 1", "SELECT nope FROM t", "SELECT name FROM t ORDER BY nope",
    "SELECT name FROM t WHERE age = 'x'", "SELECT name FROM t WHERE active = 1", "SELECT name FROM t WHERE name = true", "SELECT name FROM t WHERE tiny = 300", "SELECT name FROM t WHERE tags = 'x'",
    "SELECT name FROM t WHERE MATCH(age, 'x')", "SELECT name FROM t WHERE MATCH(name, age)", "SELECT name FROM t WHERE MATCH(name)", "SELECT name FROM t ORDER BY MATCH(name, 'x')",
    "SELECT name FROM t WHERE VECTOR_DISTANCE(embedding, ?, 'cosine')", "SELECT name FROM t ORDER BY VECTOR_DISTANCE(name, ?, 'cosine')", "SELECT name FROM t ORDER BY VECTOR_DISTANCE(embedding, ?, 'Cosine')",
    "SELECT name FROM t ORDER BY VECTOR_DISTANCE(embedding, 1, 'cosine')", "SELECT name FROM t WHERE age BETWEEN 5 AND 1", "SELECT name FROM t WHERE NOT age = 1", "SELECT name FROM t WHERE age IS NULL",
    "SELECT name FROM t WHERE name LIKE 'a%'", "SELECT name FROM t WHERE age IN (1, 2)", "SELECT name FROM t WHERE age = salary", "SELECT name FROM t WHERE 1 = 1", "SELECT name FROM t WHERE age", "SELECT name FROM t WHERE age = 5.",
    "SELECT name FROM t, u", "SELECT name FROM t JOIN u", "SELECT count(name) FROM t", "SELECT name FROM t GROUP BY name", "SELECT name FROM t LIMIT -1", "SELECT name FROM t LIMIT ?", "SELECT name FROM t LIMIT 1.5",
    "SELECT name FROM t OFFSET 1 LIMIT 2", "SELECT name n FROM t", "SELECT DISTINCT name FROM t", "SELECT match FROM t", "SELECT name FROM t WHERE big = 9223372036854775808", "SELECT name FROM t;", "SELECT 'x' FROM t",
    "SELECT name FROM t WHERE " + "(" * 200 + "age = 1" + ")" * 200, "SELECT " + ", ".join(["name"] * 1001) + " FROM t", "SELECT name FROM t WHERE " + " OR ".join(["age = ?"] * 10_001),
]


@pytest.mark.parametrize("text", REFUSED, ids=range(len(REFUSED)))
def test_refused_statements(text):
    with pytest.raises(sql.SqlError):
        sql.translate(text, F2)


def test_error_positions():
    with pytest.raises(sql.SqlError) as e:
        sql.parse("SELECT name FROM t WHERE name = 'open")
    assert e.value.position == 32


def test_lenient_dialect(people):
    assert keys(sql.execute("SELECT * FROM t WHERE NOT name = 'Alice'", people, F4, strict=False)) == ["pk2", "pk5"]
    assert keys(sql.execute("SELECT * FROM t WHERE age IS NULL OR name IS NOT NULL AND age > 34", people, F4, strict=False)) == ["pk3", "pk4"]


def test_order_puts_nulls_last(people):
    for direction in ("ASC", "DESC"):
        rows = [r.age for r in sql.execute(f"SELECT age FROM t ORDER BY age {direction}", people, F4).collect()]
        assert rows[-1] is None and rows[:4] == sorted(rows[:4], reverse=direction == "DESC")


def test_parameters(people):
    assert keys(sql.execute("SELECT * FROM t WHERE name = ? AND age BETWEEN ? AND ?", people, F4, ["Alice", 31, 40])) == ["pk3"]
    with pytest.raises(sql.SqlError):
        sql.execute("SELECT * FROM t WHERE name = ?", people, F4, [])
    with pytest.raises(P.PredicateError):
        sql.execute("SELECT * FROM t WHERE age = ?", people, F4, ["x"])
    assert people.where(F.lit(True)).count() == 5
