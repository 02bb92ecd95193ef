"""Queries p1_, p2_, p3_, p6_, p7_, p8_ and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.llm import clusters, nearest, packing, seen, spans, tokens


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return seen.judge_feeds(
        spark,
        [(f"{d}/wal_entries.parquet", "entry", "table_name", "entry_key")],
        [(f"{d}/incoming_entries.parquet", "entry", "table_name", "entry_key", "record_no"), (f"{d}/cache_reads.parquet", "cache", None, "sstable_id", "read_no")],
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose key occurred before."""
    return _judged(spark, d).where("is_repeat").select("feed", F.col("position").alias("record_no"))


def p1_judged(spark: SparkSession, d: str) -> DataFrame:
    """Every record, as first or repeat; null where it has no key."""
    return _judged(spark, d).select("feed", F.col("position").alias("record_no"), "is_repeat")


def p1_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """The rate of wrong answers, against a batch computation over all rows."""
    entry, cache, wal = _table(spark, d, "incoming_entries"), _table(spark, d, "cache_reads"), _table(spark, d, "wal_entries")
    rows = seen.keyed_rows(wal, "entry", "table_name", "entry_key", None).distinct()
    rows = rows.unionByName(seen.keyed_rows(entry, "entry", "table_name", "entry_key", "record_no")).unionByName(seen.keyed_rows(cache, "cache", None, "sstable_id", "read_no"))
    least = rows.where("key IS NOT NULL").groupBy("feed", "scope", "key").agg(F.min("position").alias("least"))
    truth = rows.where(F.col("position") != seen.BEFORE).join(least, ["feed", "scope", "key"], "left").select("feed", "position", (F.col("position") > F.col("least")).alias("is_repeat"))
    return seen.error_rate(_judged(spark, d), truth)


def _nodes(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    return nearest.load_nodes(_table(spark, d, "vector_nodes"), _table(spark, d, "vector_fields"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The most similar nodes of every usable query."""
    nodes, dims = _nodes(spark, d)
    queries = nearest.load_queries(_table(spark, d, "vector_queries"), dims)
    found = nearest.nearest(nodes, queries, dims)
    storage.drop(nodes, queries)
    return found.select("query_id", "node_id")


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact answer that the cells alone find, over the queries whose id is divisible by 50."""
    nodes, dims = _nodes(spark, d)
    queries = nearest.load_queries(_table(spark, d, "vector_queries"), dims).where("id % 50 = 0")
    return nearest.recall(nearest.by_cells(nodes, queries, dims), nearest.by_scan(nodes, queries))


def p2_loose(spark: SparkSession, d: str) -> DataFrame:
    """Queries half-way between two vectors, whose neighbours are far: how many each step settles, and its recall.

    They lie between the node of every id divisible by 50 and that of the next such id, and ask for ten nodes.
    """
    nodes, dims = _nodes(spark, d)
    own = nodes.where((F.col("id") % 50 == 0) & F.exists("vec", lambda x: x != 0))
    unit = F.transform("vec", lambda x: x / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, y: s + y.cast("double") * y)))
    one, other = own.select("id", "field_no", unit.alias("v")), own.select((F.col("id") - 50).alias("id"), "field_no", unit.alias("w"))
    between = F.zip_with("v", "w", lambda x, y: (x + y).cast("float"))
    queries = storage.materialise(one.join(other, ["id", "field_no"]).select("id", "field_no", F.lit(10).alias("extra"), between.alias("vec")), "nearest-between")
    found = nearest.nearest(nodes, queries, dims)
    exact = nearest.by_scan(nodes, queries).select("query_id", "node_id", F.col("cosine").alias("true"))
    steps = found.select("query_id", "step").distinct()
    hit = exact.join(steps, "query_id").join(found.select("query_id", "node_id", F.lit(1).alias("hit")), ["query_id", "node_id"], "left")
    return hit.groupBy("step").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.avg("true"), 3).alias("mean_cosine")).withColumn("recall", F.try_divide("found", "wanted"))


def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    """How many of the usable queries each step settles; step 4 is the exact scan."""
    nodes, dims = _nodes(spark, d)
    found = nearest.nearest(nodes, nearest.load_queries(_table(spark, d, "vector_queries"), dims), dims)
    return found.groupBy("step").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("rows"), F.round(F.min("cosine"), 6).alias("least_cosine"))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other nodes of every node whose id is divisible by 50."""
    nodes, dims = _nodes(spark, d)
    own = storage.materialise(nodes.where((F.col("id") % 50 == 0) & F.exists("vec", lambda x: x != 0)).withColumn("extra", F.lit(11)), "nearest-own")
    found = nearest.nearest(nodes, own, dims).where("query_id <> node_id")
    storage.drop(nodes, own)
    best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "node_id")
    return found.withColumn("nth", F.row_number().over(best)).where("nth <= 10").select("query_id", "node_id", F.round("cosine", 6).alias("cosine"), F.col("nth").cast("bigint").alias("nth"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every node of a cluster of two or more."""
    nodes, dims = _nodes(spark, d)
    found = clusters.components(nodes, dims)
    storage.drop(nodes)
    return found


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size, medoid and most typical members."""
    nodes, dims = _nodes(spark, d)
    names = F.array(*[F.lit(name) for name in dims]).cast("array<string>")
    members = clusters.components(nodes, dims)
    found = clusters.describe(nodes, members)
    storage.drop(nodes, members)
    return found.select("cluster_id", names[F.col("field_no")].alias("field_name"), "size", "medoid", "typical", "mean_cosine")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text."""
    return tokens.encode(_table(spark, d, "documents"))


def p6_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The number of ids of every text."""
    return tokens.count_tokens(_table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kinds = _table(spark, d, "container_sizes")
    sizes = storage.materialise(tokens.count_tokens(_table(spark, d, "documents")), "packing-sizes")
    packed = packing.pack(sizes, kinds)
    storage.drop(sizes)
    return packed, kinds


def p7_assignments(spark: SparkSession, d: str) -> DataFrame:
    """The containers of every document, for every kind of container."""
    return _packed(spark, d)[0]


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers of each kind are filled."""
    return packing.fill_report(*_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every maximal shared stretch of every text."""
    return spans.shared_spans(_table(spark, d, "documents"))


def p8_parts(spark: SparkSession, d: str) -> DataFrame:
    """How much of every text is shared."""
    documents = _table(spark, d, "documents")
    return spans.shared_parts(documents, spans.shared_spans(documents))


def p8_lines(spark: SparkSession, d: str) -> DataFrame:
    """Long lines that repeat an earlier one."""
    return spans.duplicate_lines(_table(spark, d, "documents"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every text without the long lines that repeat an earlier one: its length and how many lines it lost."""
    documents = _table(spark, d, "documents")
    cleaned = spans.without_lines(documents, spans.duplicate_lines(documents))
    return cleaned.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5(F.encode("text", "utf-8")).alias("digest"), "removed")


def p3_pivots(spark: SparkSession, d: str) -> DataFrame:
    """The clusters around pivots, each with its size, recomputed medoid and most typical members."""
    nodes, dims = _nodes(spark, d)
    names = F.array(*[F.lit(name) for name in dims]).cast("array<string>")
    members = clusters.pivot_clusters(nodes, dims)
    found = clusters.describe(nodes, members)
    storage.drop(nodes, members)
    return found.select("cluster_id", names[F.col("field_no")].alias("field_name"), "size", "medoid", "typical", "mean_cosine")


QUERIES = {
    "p1_found": p1_found, "p1_judged": p1_judged, "p1_error_rate": p1_error_rate,
    "p2_found": p2_found, "p2_recall": p2_recall, "p2_loose": p2_loose, "p2_steps": p2_steps, "p2_nodes": p2_nodes,
    "p3_found": p3_found, "p3_clusters": p3_clusters, "p3_pivots": p3_pivots,
    "p6_ids": p6_ids, "p6_lengths": p6_lengths,
    "p7_assignments": p7_assignments, "p7_fill": p7_fill,
    "p8_found": p8_found, "p8_parts": p8_parts, "p8_lines": p8_lines, "p8_cleaned": p8_cleaned,
}

_P1 = """
rows AS (
    SELECT 'entry' AS feed, table_name AS scope, entry_key AS key, -1 AS position FROM wal_entries GROUP BY ALL
    UNION ALL SELECT 'entry', table_name, entry_key, record_no FROM incoming_entries
    UNION ALL SELECT 'cache', '', sstable_id::VARCHAR, read_no FROM cache_reads),
judged AS (
    SELECT feed, position AS record_no, CASE WHEN key IS NOT NULL THEN position > min(position) OVER (PARTITION BY feed, scope, key) END AS is_repeat
    FROM rows QUALIFY position >= 0)"""

_USABLE = """
nodes AS (
    SELECT DISTINCT ON (n.node_id) n.node_id AS id, n.field_name, n.node_vector::DOUBLE[] AS v, f.dimensions
    FROM vector_nodes n JOIN vector_fields f USING (field_name)
    WHERE NOT coalesce(n.removed, false) AND len(n.node_vector) = f.dimensions
      AND len(list_filter(n.node_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_COSINE = "coalesce(CASE WHEN list_dot_product({0}, {0}) > 0 AND list_dot_product({1}, {1}) > 0 THEN list_cosine_similarity({0}, {1}) END, 0)"

_SPANS = """
windows AS (
    SELECT doc_id, s, substr(text, s + 1, 100) AS w
    FROM (SELECT doc_id, text, unnest(range(0, length(text) - 99)) AS s FROM documents WHERE length(text) >= 100)),
shared AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, s FROM windows SEMI JOIN shared USING (w)),
marked AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 100, true)::INT AS fresh FROM hits),
runs AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
spans AS (SELECT doc_id, min(s) AS span_start, max(s) + 100 AS span_end FROM runs GROUP BY doc_id, run)"""

_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = f"""
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 100),
placed AS (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nth) - length(line) - 1 AS line_start FROM split),
plain AS (SELECT doc_id, line_start::BIGINT AS line_start, (line_start + length(line))::BIGINT AS line_end,
    lower(regexp_replace(regexp_replace(line, '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g')) AS line FROM placed),
copies AS (SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(line_start) OVER w AS first_start FROM plain WHERE length(line) >= 100
    WINDOW w AS (PARTITION BY line ORDER BY doc_id, line_start)),
again AS (SELECT doc_id, line_start, line_end, first_doc_id, first_start FROM copies WHERE (doc_id, line_start) <> (first_doc_id, first_start))"""

ORACLES = {
    "p8_lines": f"WITH {_LINES} SELECT * FROM again",
    "p8_cleaned": f"""
WITH {_LINES}, kept AS (
    SELECT doc_id, string_agg(line || CASE WHEN nth < parts THEN chr(10) ELSE '' END, '' ORDER BY nth) AS text FROM (
        SELECT s.doc_id, s.line, s.nth, max(s.nth) OVER (PARTITION BY s.doc_id) AS parts, sum(length(s.line) + 1) OVER (PARTITION BY s.doc_id ORDER BY s.nth) - length(s.line) - 1 AS line_start FROM split s)
    ANTI JOIN again USING (doc_id, line_start) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS removed FROM again GROUP BY doc_id)
SELECT d.doc_id, length(t) AS chars, md5(t) AS digest, removed FROM (
    SELECT d.doc_id, CASE WHEN removed IS NULL THEN d.text ELSE coalesce(k.text, '') END AS t, coalesce(removed, 0) AS removed FROM documents d LEFT JOIN lost USING (doc_id) LEFT JOIN kept k USING (doc_id)) d""",
    "p1_found": f"WITH {_P1} SELECT feed, record_no FROM judged WHERE is_repeat",
    "p1_judged": f"WITH {_P1} SELECT feed, record_no, is_repeat FROM judged",
    "p1_error_rate": f"""
WITH {_P1},
truth AS (SELECT feed, record_no, key IS NOT NULL AS judged,
    key IS NOT NULL AND (EXISTS (SELECT 1 FROM rows b WHERE b.feed = a.feed AND b.scope IS NOT DISTINCT FROM a.scope AND b.key = a.key AND b.position < a.record_no)) AS is_repeat
    FROM (SELECT feed, scope, key, position AS record_no FROM rows WHERE position >= 0) a)
SELECT t.feed, count(*) AS records, count_if((j.is_repeat IS NOT DISTINCT FROM CASE WHEN t.judged THEN t.is_repeat END) IS NOT TRUE) AS wrong,
       count_if((j.is_repeat IS NOT DISTINCT FROM CASE WHEN t.judged THEN t.is_repeat END) IS NOT TRUE) / count(*) AS error_rate
FROM truth t LEFT JOIN judged j USING (feed, record_no) GROUP BY t.feed""",
    "p2_found": f"""
WITH {_USABLE},
asked AS (
    SELECT DISTINCT ON (q.query_id) q.query_id, q.field_name, q.query_vector::DOUBLE[] AS v, q.top_k
    FROM vector_queries q JOIN vector_fields f USING (field_name)
    WHERE q.top_k >= 1 AND len(q.query_vector) = f.dimensions
      AND len(list_filter(q.query_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(q.query_vector, lambda x: x <> 0)) > 0)
SELECT query_id, id AS node_id FROM asked JOIN nodes USING (field_name)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({_COSINE.format("asked.v", "nodes.v")}, 12) DESC, id) <= top_k""",
    "p2_recall": f"""
WITH {_USABLE},
asked AS (
    SELECT DISTINCT ON (q.query_id) q.query_id, q.field_name, q.query_vector::DOUBLE[] AS v, q.top_k
    FROM vector_queries q JOIN vector_fields f USING (field_name)
    WHERE q.top_k >= 1 AND q.query_id % 50 = 0 AND len(q.query_vector) = f.dimensions
      AND len(list_filter(q.query_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(q.query_vector, lambda x: x <> 0)) > 0),
sizes AS (SELECT query_id, least(top_k, (SELECT count(*) FROM nodes WHERE nodes.field_name = asked.field_name)) AS n FROM asked)
SELECT count(*) AS queries, coalesce(sum(n), 0)::BIGINT AS wanted, coalesce(sum(n), 0)::BIGINT AS found, CASE WHEN sum(n) > 0 THEN 1.0::DOUBLE END AS recall FROM sizes WHERE n > 0""",
    "p2_nodes": f"""
WITH {_USABLE}
SELECT a.id AS query_id, b.id AS node_id, round({_COSINE.format("a.v", "b.v")}, 6) AS cosine,
       row_number() OVER (PARTITION BY a.id ORDER BY {_COSINE.format("a.v", "b.v")} DESC, b.id) AS nth
FROM nodes a JOIN nodes b ON a.field_name = b.field_name AND a.id <> b.id
WHERE a.id % 50 = 0 AND len(list_filter(a.v, lambda x: x <> 0)) > 0 QUALIFY nth <= 10""",
    "p3_found": f"""
WITH RECURSIVE {_USABLE.replace("nodes AS", "nodes AS MATERIALIZED")},
links AS MATERIALIZED (
    SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.field_name = b.field_name AND a.id <> b.id
    WHERE {_COSINE.format("a.v", "b.v")} >= 0.87),
reached AS (SELECT a AS node, b AS other FROM links UNION SELECT node, b FROM reached JOIN links ON other = a)
SELECT least(node, min(other)) AS cluster_id, node AS node_id FROM reached GROUP BY node""",
    "p8_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM spans",
    "p8_parts": f"""
WITH {_SPANS}, parts AS (SELECT doc_id, sum(span_end - span_start) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0) AS chars, coalesce(n, 0)::BIGINT AS shared_chars,
       CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) ELSE 0 END AS share
FROM documents LEFT JOIN parts USING (doc_id)""",
}
