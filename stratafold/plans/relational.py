"""Queries of predicates, the builder and the SELECT dialect (q01 to q28), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold import predicate as P
from stratafold import sql
from stratafold.query import Query
from stratafold.schema import of_dataframe

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _filter(name: str, source: str, columns: str, p: P.Predicate, where: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, from_sql: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = prepare(table(spark, d, source))
        return P.select(df, p, of_dataframe(source, df)).select(*columns.split(", "))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {columns} FROM {from_sql or source} WHERE {where}"


def _sql(name: str, source: str, statement: str, parameters: tuple = (), oracle: str | None = None) -> None:
    """``oracle`` where the dialect's text is not what DuckDB reads."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        return sql.execute(statement, df, of_dataframe(source, df), parameters)

    QUERIES[name] = run
    ORACLES[name] = oracle or statement


_filter("q01_eq", "customer", "c_custkey, c_name", P.Eq("c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'")
_filter("q02_ne", "orders", "o_orderkey, o_orderpriority", P.Ne("o_orderpriority", "1-URGENT"), "o_orderpriority <> '1-URGENT'")
_filter("q03_gt", "customer", "c_custkey, c_acctbal", P.Gt("c_acctbal", 5000), "c_acctbal > 5000")
_filter("q04_gte", "part", "p_partkey, p_size", P.Gte("p_size", 40), "p_size >= 40")
_filter("q05_lt", "lineitem", "l_orderkey, l_linenumber, l_quantity", P.Lt("l_quantity", 5.0), "l_quantity < 5")
_filter("q06_lte", "supplier", "s_suppkey, s_acctbal", P.Lte("s_acctbal", 1000.5), "s_acctbal <= 1000.5")
_filter("q07_between", "lineitem", "l_orderkey, l_linenumber, l_discount", P.Between("l_discount", 0.05, 0.07), "l_discount BETWEEN 0.05 AND 0.07")
_filter("q08_and", "orders", "o_orderkey, o_totalprice", P.Eq("o_orderstatus", "F") & P.Gt("o_totalprice", 100000), "o_orderstatus = 'F' AND o_totalprice > 100000")
_filter("q09_or", "part", "p_partkey", P.Eq("p_brand", "Brand#12") | P.Lt("p_size", 3), "p_brand = 'Brand#12' OR p_size < 3")


def q10_left_associative(spark: SparkSession, d: str) -> DataFrame:
    """The builder joins conditions from left to right."""
    df = table(spark, d, "part")
    q = Query(df, of_dataframe("part", df)).where("p_size").lt(5).or_("p_size").gt(45).and_("p_brand").eq("Brand#12")
    return q.execute().select("p_partkey", "p_size")


QUERIES["q10_left_associative"] = q10_left_associative
ORACLES["q10_left_associative"] = "SELECT p_partkey, p_size FROM part WHERE (p_size < 5 OR p_size > 45) AND p_brand = 'Brand#12'"

_filter(
    "q11_ne_excludes_null", "orders", "o_orderkey, status", P.Ne("status", "F"), "status <> 'F'",
    lambda df: df.withColumn("status", F.nullif("o_orderstatus", F.lit("P"))), "(SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)",
)
_filter("q12_boolean", "users", "_key, name", P.Eq("active", True), "active = true")
_filter("q13_timestamp_range", "events", "event_id", P.Gte("ts", "2024-01-02 00:00:00") & P.Lt("ts", "2024-01-05 12:00:00"), "ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-05 12:00:00'")
_filter("q14_quoted", "part", "p_partkey, label", P.Eq("label", "it's Brand#12"), "label = 'it''s Brand#12'", lambda df: df.withColumn("label", F.concat(F.lit("it's "), "p_brand")), "(SELECT *, 'it''s ' || p_brand AS label FROM part)")
_filter("q15_long_key", "lineitem", "l_orderkey, l_linenumber", P.Eq("l_orderkey", 7), "l_orderkey = 7")
_filter("q16_mixed_numbers", "lineitem", "l_orderkey, l_linenumber, l_quantity", P.Gte("l_quantity", 49) & P.Eq("l_linenumber", 2.0), "l_quantity >= 49 AND l_linenumber = 2.0")

_sql("q17_select_all", "nation", "SELECT * FROM nation WHERE n_regionkey = 1")
_sql("q18_projection", "nation", "SELECT n_name, n_nationkey FROM nation")
_sql("q19_alias", "customer", "SELECT c_name AS name, c_acctbal AS balance, c_custkey FROM customer WHERE c_acctbal > 9000")
_sql("q20_parameters", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN ? AND ? AND o_orderstatus = ?", (50000, 60000.5, "O"), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000.5 AND o_orderstatus = 'O'")
_sql("q21_reversed", "part", "SELECT p_partkey, p_size FROM part WHERE 45 <= p_size")
_sql("q22_precedence", "orders", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 150000 OR o_orderpriority = '2-HIGH' AND o_totalprice < 2000")
_sql("q23_order", "supplier", "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier ORDER BY s_nationkey ASC, s_acctbal DESC, s_suppkey")
_sql("q24_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_sql("q25_offset", "nation", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 20")
_sql("q26_limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
_sql("q27_order_by_unprojected", "customer", "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7")
_sql(
    "q28_complex", "customer",
    "SELECT c_name, c_acctbal AS bal FROM customer WHERE c_acctbal > ? AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 2", (0,),
    "SELECT c_name, c_acctbal AS bal FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 2",
)
