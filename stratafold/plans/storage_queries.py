"""Queries of change logs, tables, partitions, JSON, encryption and streams (q48 to q76), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold import crypto, storage
from stratafold.engine import Engine
from stratafold.operators import fulltext, partitioning, upsert, versions
from stratafold.plans import problems
from stratafold.plans.relational import table
from stratafold.schema import FLOAT64, INT32, INT64, STRING, TIMESTAMP, ArrayOf, Field, ObjectOf, TableSchema, of_dataframe
from stratafold.sources import jsondocs
from stratafold.streaming import feed


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a change log: user by user, an ``error`` deletes."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("_key"), F.col("event_id").alias("_seq"), F.when(F.col("event_type") == "error", versions.DELETE).otherwise(versions.PUT).alias("_op"), "event_type", "value")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("_key"), "c_name", "c_acctbal", "c_mktsegment")


def q48_latest(spark: SparkSession, d: str) -> DataFrame:
    return versions.newest(_log(spark, d), keep_deletes=True).select("_key", "_seq", "_op", "event_type", "value")


def q49_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return versions.newest(_log(spark, d)).select("_key", "_seq", "event_type", "value")


def q50_point_get(spark: SparkSession, d: str) -> DataFrame:
    return versions.point(_customers(spark, d), 42)


def q51_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).where(versions.in_range(F.col("_key"), 100, 200)).orderBy("_key")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """New rows for the customers of even keys; every fourth leaves its segment open."""
    c = _customers(spark, d).where("_key % 2 = 0")
    return c.select("_key", F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("_key") % 4 == 0, F.lit(None)).otherwise(F.lit("NEW")).alias("c_mktsegment"))


def q52_patch(spark: SparkSession, d: str) -> DataFrame:
    return versions.patch(_customers(spark, d), _changes(spark, d)).withColumn("c_acctbal", F.round("c_acctbal", 2))


def q53_replace(spark: SparkSession, d: str) -> DataFrame:
    return versions.replace(_customers(spark, d), _changes(spark, d)).withColumn("c_acctbal", F.round("c_acctbal", 2))


def q54_delete(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    return c.join(c.where("c_mktsegment = 'BUILDING'").select("_key"), "_key", "left_anti")


def _filled(spark: SparkSession, d: str):
    """A table with a create, a patch, a replace and a delete in its log."""
    engine = Engine(spark, storage.workspace(spark, "engine"))
    rows = _customers(spark, d)
    t = engine.create_table("customers", of_dataframe("customers", rows), "bigint")
    t.create(rows)
    t.update(_changes(spark, d), "PATCH")
    t.update(rows.where("_key % 10 = 0"), "REPLACE")
    t.delete(rows.where("c_mktsegment = 'BUILDING'"))
    return t


def q55_table(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).current().withColumn("c_acctbal", F.round("c_acctbal", 2))


def q55_compacted(spark: SparkSession, d: str) -> DataFrame:
    """A compacted log reads as before."""
    t = _filled(spark, d)
    t.compact()
    return t.current().withColumn("c_acctbal", F.round("c_acctbal", 2))


def q55_table_range(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).scan(50, 150).select("_key", "c_name")


def q55_table_sql(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).sql("SELECT c_name, c_mktsegment FROM customers WHERE c_acctbal > ? AND c_mktsegment = 'NEW'", [5000])


def q56_unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return versions.unique_violations(table(spark, d, "users"), "email")


_ORDER_BOUNDS = (0, 1000, 4000, 9000, 1 << 40)


def _ranges() -> partitioning.RangePartitions:
    return partitioning.RangePartitions(_ORDER_BOUNDS, [10, 20, 30, 40])


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def q57_route(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", _ranges().route(F.col("o_orderkey")).alias("partition_id"))


def q58_prune(spark: SparkSession, d: str) -> DataFrame:
    """Rows by range as written in folders, of which a scan reads those it touches."""
    r, path = _ranges(), storage.workspace(spark, "ranges")
    r.write(_orders(spark, d), "o_orderkey", path)
    found = spark.read.parquet(path).where(F.col("partition_id").isin(r.overlapping(1500, 9500)))
    return found.groupBy("partition_id").agg(F.count("*").alias("n_rows"))


def q59_clipped_scan(spark: SparkSession, d: str) -> DataFrame:
    r, path = _ranges(), storage.workspace(spark, "ranges")
    r.write(_orders(spark, d), "o_orderkey", path)
    return r.scan(spark.read.parquet(path), "o_orderkey", 900, 4100).select("o_orderkey", "o_totalprice")


def q60_scatter_gather(spark: SparkSession, d: str) -> DataFrame:
    assigned = _ranges().assigned(_orders(spark, d).where("o_orderstatus = 'P'"), "o_orderkey")
    return partitioning.gathered(assigned, "partition_id", "o_orderkey", 25).select("o_orderkey", "partition_id")


def q61_merge_whole(spark: SparkSession, d: str) -> DataFrame:
    """All ranges of the orders, what lies outside them, and the pending orders a second time."""
    o = _ranges().assigned(_orders(spark, d), "o_orderkey")
    parts = [o.where(F.col("partition_id") == i) for i in _ranges().ids] + [o.where("partition_id IS NULL"), o.where("o_orderstatus = 'P'")]
    return partitioning.ordered_merge([p.select("o_orderkey") for p in parts], "o_orderkey")


_NODES = ("node-a", "node-b", "node-c", "node-d", "node-e")


def q62_owners(spark: SparkSession, d: str) -> DataFrame:
    """The two owners of every order."""
    return _orders(spark, d).select("o_orderkey", partitioning.owners(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")), _NODES, 2).alias("owners"))


def q62_reassigned(spark: SparkSession, d: str) -> DataFrame:
    """What moves when a node leaves: only what it owned."""
    ids = _orders(spark, d).select(F.col("o_orderkey").cast("string").alias("id"))
    return partitioning.reassigned(ids, "id", _NODES, _NODES[:-1])


def q63_typed_json(spark: SparkSession, d: str) -> DataFrame:
    return jsondocs.documents_from_json(table(spark, d, "events"), "props", TableSchema("props", 1, (Field("k", INT32), Field("absent", STRING))), keep=("event_id",))


def q64_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    schema = TableSchema("events", 1, (Field("event_id", INT64), Field("ts", TIMESTAMP), Field("event_type", STRING), Field("value", FLOAT64)))
    back = jsondocs.documents_from_json(rows.select(jsondocs.documents_to_json(rows, schema).alias("j")), "j", schema, strict=True)
    return back


def q65_skipped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON written as text, a third of them broken, read back without those."""
    path = storage.workspace(spark, "lines")
    e = table(spark, d, "events")
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"event_id":0}')))
    e.select(F.coalesce(broken, F.to_json(F.struct("event_id", "event_type"))).alias("value")).write.text(path)
    return jsondocs.read_lines(spark, path, TableSchema("line", 1, (Field("event_id", INT64), Field("event_type", STRING))), "SKIP_ON_ERROR")


_PUTS = "kind IS NOT NULL AND put_value IS NOT NULL"


def q66_nested_object(spark: SparkSession, d: str) -> DataFrame:
    """Objects inside the values of the log."""
    schema = TableSchema("put", 1, (Field("addr", ObjectOf((Field("city", STRING), Field("zip", INT32)))),))
    rows = jsondocs.documents_from_json(table(spark, d, "wal_entries").where(_PUTS), "put_value", schema, keep=("feed_pos",))
    return rows.where("addr IS NOT NULL").select("feed_pos", F.col("addr.city").alias("city"), F.col("addr.zip").alias("zip"))


def q67_array_field(spark: SparkSession, d: str) -> DataFrame:
    """Arrays inside the values of the log."""
    schema = TableSchema("put", 1, (Field("embedding", ArrayOf(FLOAT64)),))
    rows = jsondocs.documents_from_json(table(spark, d, "wal_entries").where(_PUTS), "put_value", schema, keep=("feed_pos",))
    return rows.where("embedding IS NOT NULL").select("feed_pos", F.size("embedding").cast("bigint").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def q67_members(spark: SparkSession, d: str) -> DataFrame:
    """Members and keys of JSON values without a schema."""
    w = table(spark, d, "wal_entries").where(_PUTS)
    return w.select("feed_pos", jsondocs.member(F.col("put_value"), "name").alias("name"), F.size(jsondocs.keys(F.col("put_value"))).cast("bigint").alias("n_keys")).where("n_keys > 0")


_KEYS = crypto.Keys({1: b"a key for tests, version one....", 2: b"a key for tests, version two...."})


def q68_deterministic(spark: SparkSession, d: str) -> DataFrame:
    """Equality on ciphertexts."""
    c = crypto.encrypt_fields(table(spark, d, "customer"), {"c_mktsegment": "DETERMINISTIC"}, _KEYS)
    wanted = crypto.deterministic(F.lit("BUILDING"), "c_mktsegment", _KEYS)
    return c.where(F.col("c_mktsegment") == wanted).select("c_custkey")


def q69_opaque_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = crypto.encrypt_fields(table(spark, d, "customer"), {"c_name": "OPAQUE"}, _KEYS)
    return c.select("c_custkey", crypto.decrypt(F.col("c_name"), "c_name", _KEYS, "OPAQUE").alias("c_name"))


def _encrypted_sizes(spark: SparkSession, d: str) -> tuple[DataFrame, crypto.OrderPreserving]:
    scheme = crypto.OrderPreserving(_KEYS, "p_size", "INT16")
    return table(spark, d, "part").select("p_partkey", scheme.encrypt(F.col("p_size") - 25).alias("size")), scheme


def q70_order_range(spark: SparkSession, d: str) -> DataFrame:
    """A range on ciphertexts, negative values included."""
    p, scheme = _encrypted_sizes(spark, d)
    return p.where(F.col("size").between(scheme.encrypt_value(-5), scheme.encrypt_value(5))).select("p_partkey")


def q71_order_by(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _encrypted_sizes(spark, d)
    return p.orderBy("size", "p_partkey").limit(20).select("p_partkey")


def q72_keyword_lookup(spark: SparkSession, d: str) -> DataFrame:
    return crypto.keyword_search(crypto.keyword_index(table(spark, d, "documents"), "doc_id", "text", _KEYS), "payload", "text", _KEYS)


def q73_rekey(spark: SparkSession, d: str) -> DataFrame:
    """Encrypted under one version, encrypted anew under the next, read back."""
    old = crypto.Keys(_KEYS.versions, 1)
    c = crypto.encrypt_fields(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "OPAQUE", "c_mktsegment": "DETERMINISTIC"}, old)
    c = crypto.rekey(c, {"c_name": "OPAQUE", "c_mktsegment": "DETERMINISTIC"}, _KEYS)
    return c.select("c_custkey", crypto.version_of(F.col("c_name")).alias("key_version"), *[crypto.decrypt(F.col(n), n, _KEYS, s).alias(n) for n, s in (("c_name", "OPAQUE"), ("c_mktsegment", "DETERMINISTIC"))])


def q74_streamed_feed(spark: SparkSession, d: str) -> DataFrame:
    """The change feed applied as a stream."""
    state = feed.apply_stream(feed.file_stream(spark, f"{d}/wal_entries.parquet", 4), storage.workspace(spark, "stream"))
    return upsert.current_rows(state).drop("put_value")


def q75_byte_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length in bytes of UTF-8, the measure of byte-limited strings."""
    return table(spark, d, "users").select("_key", F.octet_length("name").cast("bigint").alias("n_bytes")).where("n_bytes > 12")


def q76_evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    """Rows written before a field was added read with a null there."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("_key"), "c_name")
    schema = of_dataframe("customers", rows).evolved((Field("c_rank", INT32),))
    return schema.read(rows)


def q77_term_index(spark: SparkSession, d: str) -> DataFrame:
    """Inverted index of whole numbers: how many orders each customer has."""
    index = fulltext.term_index(table(spark, d, "orders"), "o_orderkey", "o_custkey")
    return index.groupBy("term").agg(F.count("*").alias("n_rows"))


def q78_boolean_search(spark: SparkSession, d: str) -> DataFrame:
    """(batch or segment) and not cluster, over indexed text."""
    index = fulltext.TextIndex.build(table(spark, d, "documents"), "doc_id", "text")
    t = lambda w: fulltext.Term("text", w)
    return index.search((t("batch") | t("segment")) - t("cluster"))


def q79_positions(spark: SparkSession, d: str) -> DataFrame:
    """First and last position of each word of each document."""
    p = fulltext.positions(table(spark, d, "documents"), "doc_id", "text")
    return p.select("doc_id", "term", F.size("positions").cast("bigint").alias("n"), F.element_at("positions", 1).cast("bigint").alias("first_at"), F.element_at("positions", -1).cast("bigint").alias("last_at"))


def q80_gathered_by_score(spark: SparkSession, d: str) -> DataFrame:
    """The best of what the ranges of a key space give."""
    o = _ranges().assigned(_orders(spark, d), "o_orderkey")
    parts = [o.where(F.col("partition_id") == i).orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice") for i in _ranges().ids]
    return partitioning.gathered_by_score(parts, "o_orderkey", "o_totalprice", 15)


def q81_json_equality(spark: SparkSession, d: str) -> DataFrame:
    """Numbers are equal by value, whatever their form; every third one is another."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    other = F.concat(F.lit('{ "k": '), k.cast("string"), F.lit(".0 }"))
    return e.select("event_id", jsondocs.json_equal(F.col("props"), other).alias("same"))


QUERIES = {name: query for name, query in globals().items() if name.startswith("q") and name[1:3].isdigit()}

_LOG = "log AS (SELECT user_id AS _key, event_id AS _seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS _op, event_type, value FROM events)"
_NEWEST = f"{_LOG}, newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY _key ORDER BY _seq DESC) = 1)"
_NEW = "new AS (SELECT c_custkey AS _key, c_acctbal + 1 AS bal, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'NEW' END AS seg FROM customer WHERE c_custkey % 2 = 0)"
_AFTER = f"""{_NEW}, after AS (
    SELECT c_custkey AS _key, c_name, round(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal ELSE coalesce(bal, c_acctbal) END, 2) AS c_acctbal,
           CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE coalesce(seg, c_mktsegment) END AS c_mktsegment
    FROM customer LEFT JOIN new ON c_custkey = _key WHERE c_mktsegment <> 'BUILDING')"""
_ROUTE = "CASE WHEN o_orderkey < 0 THEN NULL WHEN o_orderkey < 1000 THEN 10 WHEN o_orderkey < 4000 THEN 20 WHEN o_orderkey < 9000 THEN 30 ELSE 40 END"
_WORDS = r"""
WITH words AS (
    SELECT doc_id, nth, lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) AS term
    FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS nth FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS l FROM documents)))"""
_TEXT = r"""
WITH words AS (SELECT doc_id, lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents))
SELECT DISTINCT doc_id FROM words WHERE term = 'payload'"""
# the 64-bit hash of id, a byte 255 and node, mixed and read as signed, in numbers of 128 bits
_WIDE = "18446744073709551616::UHUGEINT"
_CODES = "list_transform(range(1, length({0}) + 1), lambda p: unicode(substr({0}, p, 1)))"
_OWNED = f"""
hashed AS (
    SELECT id, node, list_reduce(list_prepend({0xCBF29CE484222325}::UHUGEINT, list_transform(list_concat({_CODES.format("id")}, [255], {_CODES.format("node")}), lambda b: b::UHUGEINT)),
        lambda h, b: (xor(h, b) * {0x100000001B3}::UHUGEINT) % {_WIDE}) AS h FROM ids, (SELECT unnest({list(_NODES)}) AS node)),
once AS (SELECT id, node, (xor(h, h // {2**30}::UHUGEINT) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {_WIDE} AS h FROM hashed),
twice AS (SELECT id, node, (xor(h, h // {2**27}::UHUGEINT) * {0x94D049BB133111EB}::UHUGEINT) % {_WIDE} AS h FROM once),
mixed AS (SELECT id, node, xor(h, h // {2**31}::UHUGEINT)::HUGEINT AS h FROM twice),
weights AS (SELECT id, node, CASE WHEN h >= {2**63}::HUGEINT THEN h - {2**64}::HUGEINT ELSE h END AS w FROM mixed)"""
ORACLES = {
    "q48_latest": f"WITH {_NEWEST} SELECT _key, _seq, _op, event_type, value FROM newest",
    "q49_tombstones": f"WITH {_NEWEST} SELECT _key, _seq, event_type, value FROM newest WHERE _op <> 'D'",
    "q50_point_get": "SELECT c_custkey AS _key, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42",
    "q51_range_scan": "SELECT c_custkey AS _key, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey >= 100 AND c_custkey < 200",
    "q52_patch": f"WITH {_NEW} SELECT _key, c_name, round(bal, 2) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment FROM new JOIN customer ON c_custkey = _key",
    "q53_replace": f"""WITH {_NEW} SELECT c_custkey AS _key, CASE WHEN _key IS NULL THEN c_name END AS c_name, round(CASE WHEN _key IS NULL THEN c_acctbal ELSE bal END, 2) AS c_acctbal,
CASE WHEN _key IS NULL THEN c_mktsegment ELSE seg END AS c_mktsegment FROM customer LEFT JOIN new ON c_custkey = _key""",
    "q54_delete": "SELECT c_custkey AS _key, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "q55_table": f"WITH {_AFTER} SELECT * FROM after",
    "q55_compacted": f"WITH {_AFTER} SELECT * FROM after",
    "q55_table_range": f"WITH {_AFTER} SELECT _key, c_name FROM after WHERE _key >= 50 AND _key < 150",
    "q55_table_sql": f"WITH {_AFTER} SELECT c_name, c_mktsegment FROM after WHERE c_acctbal > 5000 AND c_mktsegment = 'NEW'",
    "q56_unique_violations": "SELECT email, count(*) AS rows FROM users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1",
    "q57_route": f"SELECT o_orderkey, {_ROUTE} AS partition_id FROM orders",
    "q58_prune": f"SELECT {_ROUTE} AS partition_id, count(*) AS n_rows FROM orders WHERE o_orderkey >= 1000 GROUP BY 1",
    "q59_clipped_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 900 AND o_orderkey < 4100",
    "q60_scatter_gather": f"SELECT o_orderkey, {_ROUTE} AS partition_id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 25",
    "q61_merge_whole": "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
    "q62_owners": f"WITH ids AS (SELECT 'orders/' || o_orderkey AS id FROM orders), {_OWNED} SELECT split_part(id, '/', 2)::BIGINT AS o_orderkey, list(node ORDER BY w DESC, node)[1:2] AS owners FROM weights GROUP BY id",
    "q62_reassigned": f"""WITH ids AS (SELECT DISTINCT o_orderkey::VARCHAR AS id FROM orders), {_OWNED}
SELECT id, owner_before, owner_after FROM (SELECT id, first(node ORDER BY w DESC, node) AS owner_before, first(node ORDER BY w DESC, node) FILTER (WHERE node <> '{_NODES[-1]}') AS owner_after FROM weights GROUP BY id)
WHERE owner_before <> owner_after""",
    "q63_typed_json": "SELECT event_id, (props->>'$.k')::INT AS k, NULL::VARCHAR AS absent FROM events",
    "q64_json_round_trip": "SELECT event_id, date_trunc('millisecond', ts)::TIMESTAMP AS ts, event_type, value FROM events",
    "q65_skipped_lines": "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0",
    "q66_nested_object": f"SELECT feed_pos, put_value->>'$.addr.city' AS city, TRY_CAST(put_value->>'$.addr.zip' AS INT) AS zip FROM wal_entries WHERE {_PUTS} AND json_valid(put_value) AND json_type(put_value, '$.addr') = 'OBJECT'",
    "q67_array_field": f"""SELECT feed_pos, len(e) AS n, round(list_sum(e), 6) AS total FROM (SELECT feed_pos, (put_value->'$.embedding')::DOUBLE[] AS e FROM wal_entries
WHERE {_PUTS} AND json_valid(put_value) AND json_type(put_value, '$.embedding') = 'ARRAY')""",
    "q67_members": f"SELECT feed_pos, put_value->>'$.name' AS name, len(json_keys(put_value)) AS n_keys FROM wal_entries WHERE {_PUTS} AND json_valid(put_value) AND json_type(put_value) = 'OBJECT' AND len(json_keys(put_value)) > 0",
    "q68_deterministic": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "q69_opaque_round_trip": "SELECT c_custkey, c_name FROM customer",
    "q70_order_range": "SELECT p_partkey FROM part WHERE p_size - 25 BETWEEN -5 AND 5",
    "q71_order_by": "SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 20",
    "q72_keyword_lookup": _TEXT,
    "q73_rekey": "SELECT c_custkey, 2 AS key_version, c_name, c_mktsegment FROM customer",
    "q74_streamed_feed": problems.ORACLES["p5_found"],
    "q75_byte_lengths": "SELECT _key, octet_length(encode(name)) AS n_bytes FROM users WHERE octet_length(encode(name)) > 12",
    "q77_term_index": "SELECT o_custkey AS term, count(*) AS n_rows FROM orders GROUP BY 1",
    "q78_boolean_search": f"{_WORDS} SELECT doc_id FROM words GROUP BY doc_id HAVING bool_or(term IN ('batch', 'segment')) AND NOT bool_or(term = 'cluster')",
    "q79_positions": f"{_WORDS}, kept AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS place FROM words WHERE term <> '') SELECT doc_id, term, count(*) AS n, min(place) AS first_at, max(place) AS last_at FROM kept GROUP BY ALL",
    "q80_gathered_by_score": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "q81_json_equality": "SELECT event_id, (props->>'$.k')::DOUBLE = (props->>'$.k')::BIGINT + (event_id % 3 = 0)::INT AS same FROM events",
    "q76_evolved_schema": "SELECT c_custkey AS _key, c_name, NULL::INT AS c_rank FROM customer",
}
