"""Queries of full-text and vector search (q29 to q47), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold import predicate as P
from stratafold import sql
from stratafold.functions import text, vector
from stratafold.plans.relational import table
from stratafold.schema import VectorOf, of_dataframe

WORDS = r"""
words AS (
    SELECT doc_id, lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) AS term
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)),
terms AS (SELECT DISTINCT doc_id, term FROM words WHERE term <> '')"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source").withColumn("_key", F.col("doc_id"))


def _match(spark: SparkSession, d: str, p: P.Predicate) -> DataFrame:
    df = _documents(spark, d)
    return P.select(df, p, of_dataframe("documents", df)).select("doc_id")


def _has(term: str) -> P.Predicate:
    return P.FullTextMatch("text", term)


def q29_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Number of words and of distinct words of each document."""
    words = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


def q30_match(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, _has("payload"))


def q31_match_and_scalar(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, _has("payload") & P.Eq("lang", "en"))


def q32_terms_and(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, P.And((_has("batch"), _has("segment"), _has("the"))))


def q33_terms_or(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, _has("cluster") | _has("bloom"))


def q34_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Full-text NOT: rows of one set without those of another."""
    return _match(spark, d, _has("batch")).join(_match(spark, d, _has("the")), "doc_id", "left_anti")


def q35_stop_words(spark: SparkSession, d: str) -> DataFrame:
    """Number of words of each document that are no stop words."""
    kept = text.without_stop_words(text.tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.size(kept).cast("bigint").alias("n_words")).where("n_words > 0")


def q36_postings(spark: SparkSession, d: str) -> DataFrame:
    return text.postings(table(spark, d, "documents"), "doc_id", "text", "source").select("field", "term", "doc_id")


def q37_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each term occurs."""
    return text.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("n_docs"))


def q38_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the corpus with their document frequency; each distinct word is stemmed once."""
    posted = text.postings(table(spark, d, "documents"), "doc_id", "text", analyser=lambda c: text.without_stop_words(text.tokens(c)))
    stems = posted.select("term").distinct().withColumn("stem", text.stem_column("term"))
    return posted.join(stems, "term").groupBy("stem").agg(F.countDistinct("doc_id").alias("n_docs"))


def q38_stemmed_query(spark: SparkSession, d: str) -> DataFrame:
    """Documents with any form of a word, over the analysed text."""
    analysed = text.analyse(F.col("text"))
    return table(spark, d, "documents").where(F.array_contains(analysed, text.stem("segments"))).select("doc_id")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of different lengths, so that the metrics differ."""
    scaled = F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 3)).cast("float"))
    return table(spark, d, "embeddings").select("vec_id", "label", scaled.alias("embedding")).withColumn("_key", F.col("vec_id"))


def _query(n: int = 64) -> list[float]:
    """A fixed query vector."""
    return [((7 * i) % 11 - 5) / 10 for i in range(n)]


def _scores(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _embeddings(spark, d).select("vec_id", F.round(vector.score_fixed(F.col("embedding"), _query(), metric), 6).alias("score"))

    return run


def q42_top_k(spark: SparkSession, d: str) -> DataFrame:
    return vector.top_k(_embeddings(spark, d), "vec_id", "embedding", _query(), 10).select("vec_id", F.round("score", 6).alias("score"))


def _by_distance(direction: str, metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _embeddings(spark, d)
        schema = of_dataframe("embeddings", df, embedding=VectorOf(64))
        return sql.execute(f"SELECT vec_id, label FROM embeddings ORDER BY VECTOR_DISTANCE(embedding, ?, '{metric}') {direction}, vec_id LIMIT 10", df, schema, [_query()])

    return run


def q45_nearest_and_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter applies to the nearest of the whole table."""
    df = _embeddings(spark, d)
    p = P.VectorNearest("embedding", tuple(_query()), 40, "euclidean") & P.Lt("label", 3)
    return P.select(df, p, of_dataframe("embeddings", df, embedding=VectorOf(64))).select("vec_id", "label")


def q45_nearest_or_filter(spark: SparkSession, d: str) -> DataFrame:
    df = _embeddings(spark, d)
    p = P.VectorNearest("embedding", tuple(_query()), 20, "dot") | P.Eq("label", 1)
    return P.select(df, p, of_dataframe("embeddings", df, embedding=VectorOf(64))).select("vec_id", "label")


def _inverted(spark: SparkSession, d: str) -> vector.InvertedFile:
    return vector.InvertedFile(_embeddings(spark, d), "vec_id", "embedding", "dot", 16)


def q46_ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    return _inverted(spark, d).lists.select("vec_id", F.col("centroid").cast("bigint").alias("centroid"))


def q47_ivf_search(spark: SparkSession, d: str) -> DataFrame:
    return _inverted(spark, d).search(_query(), 10, 4).select("vec_id", F.round("score", 6).alias("score"))


def q47_ivf_removed(spark: SparkSession, d: str) -> DataFrame:
    """Removed rows are left out before the best are taken; all lists probed is exact."""
    removed = _embeddings(spark, d).where("label = 0").select("vec_id")
    return _inverted(spark, d).search(_query(), 10, 16, removed).select("vec_id", F.round("score", 6).alias("score"))


def q47_ivf_exact(spark: SparkSession, d: str) -> DataFrame:
    """Without a number of probes no list is left out that may hold one of the best."""
    return _inverted(spark, d).search(_query(), 10).select("vec_id", F.round("score", 6).alias("score"))


def q47_ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact answer that the lists read hold, over the vectors whose id is divisible by 50: for 4 probes and without a number."""
    index, queries = _inverted(spark, d), _embeddings(spark, d).where("vec_id % 50 = 0")
    of = lambda probes: index.recall(queries, 10, probes).withColumn("probes", F.lit(probes).cast("int"))
    return of(4).unionByName(of(None))


def q47_half_precision(spark: SparkSession, d: str) -> DataFrame:
    half = table(spark, d, "embeddings").select("vec_id", vector.half_precision("embedding").alias("v"))
    return half.select("vec_id", F.round(vector.dot(F.col("v"), F.col("v")), 6).alias("norm"))


QUERIES = {
    "q29_tokens": q29_tokens, "q30_match": q30_match, "q31_match_and_scalar": q31_match_and_scalar, "q32_terms_and": q32_terms_and, "q33_terms_or": q33_terms_or,
    "q34_include_exclude": q34_include_exclude, "q35_stop_words": q35_stop_words, "q36_postings": q36_postings, "q37_document_frequency": q37_document_frequency,
    "q38_stems": q38_stems, "q38_stemmed_query": q38_stemmed_query, "q39_dot": _scores("dot"), "q40_cosine": _scores("cosine"), "q41_euclidean": _scores("euclidean"),
    "q42_top_k": q42_top_k, "q43_distance_asc": _by_distance("ASC", "cosine"), "q43_distance_euclidean": _by_distance("ASC", "euclidean"), "q44_distance_desc": _by_distance("DESC", "dot"),
    "q45_nearest_and_filter": q45_nearest_and_filter, "q45_nearest_or_filter": q45_nearest_or_filter, "q46_ivf_assign": q46_ivf_assign, "q47_ivf_search": q47_ivf_search,
    "q47_ivf_removed": q47_ivf_removed, "q47_ivf_exact": q47_ivf_exact, "q47_ivf_recall": q47_ivf_recall, "q47_half_precision": q47_half_precision,
}

_LIST = "[" + ", ".join(map(str, _query())) + "]::DOUBLE[]"
_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x * (1 + vec_id % 3))::FLOAT)::DOUBLE[] AS v FROM embeddings)"
_DOT, _COS, _L2 = f"list_dot_product(v, {_LIST})", f"list_cosine_similarity(v, {_LIST})", f"list_distance(v, {_LIST})"
_has_sql = lambda *terms: " AND ".join(f"doc_id IN (SELECT doc_id FROM terms WHERE term = '{t}')" for t in terms)
_IVF = f"""{_E},
c AS (SELECT vec_id AS key, row_number() OVER (ORDER BY vec_id) - 1 AS centroid, v AS cv FROM e ORDER BY vec_id LIMIT 16),
lists AS (SELECT e.vec_id, e.label, e.v, arg_max(c.centroid, (round(list_dot_product(e.v, c.cv), 12), -c.centroid)) AS centroid FROM e CROSS JOIN c GROUP BY e.vec_id, e.label, e.v)"""
_HALF = "list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0 ELSE sign(x) * round_even(abs(x) / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END)"
ORACLES = {
    "q29_tokens": f"WITH {WORDS} SELECT doc_id, count(*) AS n_words, count(DISTINCT term) AS n_distinct FROM words WHERE term <> '' GROUP BY doc_id",
    "q30_match": f"WITH {WORDS} SELECT doc_id FROM documents WHERE {_has_sql('payload')}",
    "q31_match_and_scalar": f"WITH {WORDS} SELECT doc_id FROM documents WHERE {_has_sql('payload')} AND lang = 'en'",
    "q32_terms_and": f"WITH {WORDS} SELECT doc_id FROM documents WHERE {_has_sql('batch', 'segment', 'the')}",
    "q33_terms_or": f"WITH {WORDS} SELECT doc_id FROM documents WHERE {_has_sql('cluster')} OR {_has_sql('bloom')}",
    "q34_include_exclude": f"WITH {WORDS} SELECT doc_id FROM documents WHERE {_has_sql('batch')} AND NOT {_has_sql('the')}",
    "q35_stop_words": f"WITH {WORDS} SELECT doc_id, count(*) AS n_words FROM words WHERE term <> '' AND term NOT IN ({', '.join(repr(w) for w in sorted(text.STOP_WORDS))}) GROUP BY doc_id",
    "q36_postings": rf"""WITH {WORDS} SELECT 'text' AS field, term, doc_id FROM terms UNION ALL
SELECT DISTINCT 'source', lower(regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')) AS t, doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(source, '\s+')) AS w FROM documents) WHERE t <> ''""",
    "q37_document_frequency": f"WITH {WORDS} SELECT term, count(*) AS n_docs FROM terms GROUP BY term",
    "q39_dot": f"WITH {_E} SELECT vec_id, round({_DOT}, 6) AS score FROM e",
    "q40_cosine": f"WITH {_E} SELECT vec_id, round({_COS}, 6) AS score FROM e",
    "q41_euclidean": f"WITH {_E} SELECT vec_id, round(-{_L2}, 6) AS score FROM e",
    "q42_top_k": f"WITH {_E} SELECT vec_id, round({_COS}, 6) AS score FROM e ORDER BY {_COS} DESC, vec_id LIMIT 10",
    "q43_distance_asc": f"WITH {_E} SELECT vec_id, label FROM e ORDER BY 1 - {_COS} ASC, vec_id LIMIT 10",
    "q43_distance_euclidean": f"WITH {_E} SELECT vec_id, label FROM e ORDER BY {_L2} ASC, vec_id LIMIT 10",
    "q44_distance_desc": f"WITH {_E} SELECT vec_id, label FROM e ORDER BY -{_DOT} DESC, vec_id LIMIT 10",
    "q45_nearest_and_filter": f"WITH {_E}, near AS (SELECT * FROM e ORDER BY {_L2}, vec_id LIMIT 40) SELECT vec_id, label FROM near WHERE label < 3",
    "q45_nearest_or_filter": f"WITH {_E}, near AS (SELECT * FROM e ORDER BY {_DOT} DESC, vec_id LIMIT 20) SELECT vec_id, label FROM e WHERE label = 1 OR vec_id IN (SELECT vec_id FROM near)",
    "q46_ivf_assign": f"WITH {_IVF} SELECT vec_id, centroid FROM lists",
    "q47_ivf_search": f"WITH {_IVF}, probed AS (SELECT centroid FROM c ORDER BY list_dot_product(cv, {_LIST}) DESC, centroid LIMIT 4) SELECT vec_id, round({_DOT}, 6) AS score FROM lists WHERE centroid IN (SELECT centroid FROM probed) ORDER BY {_DOT} DESC, vec_id LIMIT 10",
    "q47_ivf_exact": f"WITH {_E} SELECT vec_id, round({_DOT}, 6) AS score FROM e ORDER BY {_DOT} DESC, vec_id LIMIT 10",
    "q47_ivf_removed": f"WITH {_E} SELECT vec_id, round({_DOT}, 6) AS score FROM e WHERE label <> 0 ORDER BY {_DOT} DESC, vec_id LIMIT 10",
    "q38_stemmed_query": r"""SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_full_match(lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), 'segment(s|ed|ing|al|ation|ations)?'))) > 0""",
    "q47_half_precision": f"SELECT vec_id, round(list_dot_product(v, v), 6) AS norm FROM (SELECT vec_id, {_HALF} AS v FROM embeddings)",
}
