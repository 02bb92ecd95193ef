"""Queries of tables with indexes and encryption, the catalogue, refusals and further operators (q82 to q118), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold import crypto, sql, storage
from stratafold import predicate as P
from stratafold.engine import Engine, TableExistsError, TableNotFoundError
from stratafold.functions import vector
from stratafold.operators import fulltext, partitioning, versions
from stratafold.plans.relational import table
from stratafold.query import Query
from stratafold.schema import BOOLEAN, FLOAT16, FLOAT32, INT16, INT32, INT64, STRING, ArrayOf, BoundedString, Field, ObjectOf, SchemaError, TableSchema, VectorOf, of_dataframe
from stratafold.sources import jsondocs
from stratafold.table import DuplicateKeyError, KeyNotFoundError, Table, UniqueViolationError, check_index

_KEYS = crypto.Keys({1: b"a key for tests, version one....", 2: b"a key for tests, version two...."})


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, storage.workspace(spark, "engine"), _KEYS)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("_key"), "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("_key"), "p_name", "p_brand", (F.col("p_size") - 25).cast("smallint").alias("size"))


# -- reads of tables
def q82_string_keys(spark: SparkSession, d: str) -> DataFrame:
    """A range of a table whose keys are strings."""
    rows = _customers(spark, d).select(F.col("c_name").alias("_key"), "c_acctbal")
    t = _engine(spark).create_table("customers", of_dataframe("customers", rows))
    t.create(rows)
    return t.scan("Customer#000000010", "Customer#000000050")


def q83_point_read_of_a_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A point read of a compacted table, whose row groups carry Bloom filters and bounds of the key."""
    t = _engine(spark).create_table("customers", of_dataframe("customers", _customers(spark, d)), "bigint")
    t.create(_customers(spark, d))
    t.compact()
    return t.get(77)


def q84_recovered(spark: SparkSession, d: str) -> DataFrame:
    """What can be read when the files of the last batch are damaged."""
    rows = _customers(spark, d)
    t = _engine(spark).create_table("customers", of_dataframe("customers", rows), "bigint")
    t.create(rows)
    t.update(rows.withColumn("c_name", F.lit("lost")))
    place, fs = storage._hadoop(spark, f"{t.path}/log/batch-{2:012d}")
    for status in fs.listStatus(place):
        if status.getPath().getName().endswith(".parquet"):
            out = fs.create(status.getPath(), True)
            out.write(bytearray(b"no parquet"))
            out.close()
    return t.recovered()


def q85_replay(spark: SparkSession, d: str) -> DataFrame:
    """The log after its first batch, in order."""
    rows = _customers(spark, d)
    t = _engine(spark).create_table("customers", of_dataframe("customers", rows), "bigint")
    t.create(rows)
    t.update(rows.where("_key % 3 = 0").withColumn("c_acctbal", F.lit(0.0)))
    t.delete(rows.where("_key % 5 = 0"))
    return t.changes_since(1).select("_key", "_seq", "_op", "c_name", "c_acctbal")


def q86_insert(spark: SparkSession, d: str) -> DataFrame:
    """Rows without keys take their first field as the key."""
    rows = _customers(spark, d).select("c_name", "c_acctbal")
    t = _engine(spark).create_table("customers", of_dataframe("customers", rows))
    t.insert(rows)
    return t.current()


def q87_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as lines of JSON and read back."""
    rows, path = _customers(spark, d), storage.workspace(spark, "lines")
    schema = of_dataframe("customers", rows)
    jsondocs.write_lines(rows.select(*schema.names), schema, path)
    return jsondocs.read_lines(spark, path, schema)


def q88_lenient_not(spark: SparkSession, d: str) -> DataFrame:
    """NOT, which the lenient dialect has; rows whose value is null do not match."""
    users = table(spark, d, "users")
    return sql.execute("SELECT _key, age FROM users WHERE NOT age >= 30", users, of_dataframe("users", users.drop("_key")).with_field("_key", STRING), (), False)


def q89_lenient_null(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users")
    return sql.execute("SELECT _key, name FROM users WHERE email IS NULL AND name IS NOT NULL", users, of_dataframe("users", users.drop("_key")).with_field("_key", STRING), (), False)


# -- indexes
def _indexed(spark: SparkSession, d: str) -> Table:
    """Documents with indexes, some rows changed and some deleted after these were built; a handle of its own."""
    engine = _engine(spark)
    rows = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_key"), "text", "lang", "n_chars")
    t = engine.create_table("documents", of_dataframe("documents", rows), "bigint")
    t.create(rows)
    t.compact()
    t.create_index("text", "FULL_TEXT")
    t.create_index("n_chars", "RANGE")
    t.create_index("lang", "EQUALITY")
    t.update(rows.where("_key % 10 = 3").withColumn("text", F.lit("a payload of later days")).withColumn("n_chars", F.lit(23).cast("bigint")))
    t.delete(rows.where("_key % 10 = 7"))
    return engine.get_table("documents")


def q90_index_match(spark: SparkSession, d: str) -> DataFrame:
    """MATCH by the table's postings, and what changed since they were written."""
    return _indexed(spark, d).sql("SELECT lang, n_chars FROM documents WHERE MATCH(text, 'payload')")


def q90_index_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """MATCH by postings of stems, whatever the form of the term asked for."""
    rows = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_key"), "text")
    t = _engine(spark).create_table("documents", of_dataframe("documents", rows), "bigint")
    t.create(rows)
    t.create_index("text", "FULL_TEXT", analyser="stemmed")
    t.create(rows.where("_key % 7 = 0").select((-F.col("_key") - 1).alias("_key"), "text"))
    return t.query().where("text").full_text_match("segmenting").execute().select("_key")


def q91_index_range(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).query().where("n_chars").between(20, 60).execute().select("_key", "n_chars")


def q92_index_equality(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).query().where("lang").eq("de").and_("n_chars").gt(400).execute().select("_key", "lang")


def q93_index_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The index that each kind of leaf is given to, if any."""
    t = _indexed(spark, d)
    leaves = [P.FullTextMatch("text", "x"), P.Eq("lang", "de"), P.Gt("lang", "de"), P.Eq("n_chars", 1), P.Lt("n_chars", 1), P.Ne("n_chars", 1), P.Between("n_chars", 1, 2)]
    made = [(f"{type(p).__name__} {p.field}", index.kind if (index := t.index_for(p)) else None) for p in leaves]
    return spark.createDataFrame(made, "leaf string, kind string")


def q94_index_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors by the table's inverted file, with rows added later."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("_key"), "embedding", "label")
    width = len(rows.first().embedding)
    engine = _engine(spark)
    t = engine.create_table("vectors", of_dataframe("vectors", rows, embedding=VectorOf(width)), "bigint")
    t.create(rows.where("_key % 4 <> 1"))
    t.create_index("embedding", "VECTOR", "euclidean")
    t.create(rows.where("_key % 4 = 1"))
    query = [((i * 7) % 11 - 5) / 10 for i in range(width)]
    return engine.get_table("vectors").query().where("embedding").vector_nearest(query, 12, "euclidean").execute().select("_key", "label")


def q95_unique_by_another_handle(spark: SparkSession, d: str) -> DataFrame:
    """A unique index holds for every handle of a table: what a second one may not add, and what it may."""
    engine = _engine(spark)
    rows = _customers(spark, d).select("_key", "c_name")
    engine.create_table("customers", of_dataframe("customers", rows), "bigint").create(rows)
    engine.get_table("customers").create_index("c_name", "UNIQUE")
    second = engine.get_table("customers")
    late = rows.where("_key = 1").withColumn("_key", F.lit(-1).cast("bigint"))
    return _refused(spark, {
        "a value that is there": (lambda: second.create(late), UniqueViolationError), "twice in a batch": (lambda: second.create(late.unionByName(late.withColumn("_key", F.lit(-2).cast("bigint"))).withColumn("c_name", F.lit("new"))), UniqueViolationError),
        "a new value": (lambda: second.create(late.withColumn("c_name", F.lit("new"))), UniqueViolationError), "a value added since": (lambda: engine.get_table("customers").create(late.withColumn("_key", F.lit(-3).cast("bigint")).withColumn("c_name", F.lit("new"))), UniqueViolationError),
    })


def q96_removed_from_index(spark: SparkSession, d: str) -> DataFrame:
    """A search after documents were taken out of the postings and others put in."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    index = fulltext.TextIndex.build(documents, "doc_id", "text")
    added = documents.where("doc_id % 20 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("payload again").alias("text"))
    return index.updated(documents.where("doc_id % 3 = 0"), added, "text").search(fulltext.Term("text", "payload"))


def q97_byte_terms(spark: SparkSession, d: str) -> DataFrame:
    """Inverted index of bytes: how many users share each name."""
    users = table(spark, d, "users").where("_key IS NOT NULL").select("_key", F.encode("name", "utf-8").alias("raw")).distinct()
    return fulltext.term_index(users, "_key", "raw").groupBy(F.hex("term").alias("term")).agg(F.count("*").alias("n_keys"))


# -- encryption
_SCHEMES = {"p_name": "OPAQUE", "p_brand": "DETERMINISTIC", "size": "ORDER_PRESERVING"}


def _secret(spark: SparkSession, d: str) -> Table:
    rows = _parts(spark, d)
    engine = _engine(spark)
    t = engine.create_encrypted_table("parts", of_dataframe("parts", rows), _SCHEMES, "bigint")
    t.create(rows)
    t.create_index("p_brand", "FULL_TEXT")
    return engine.get_table("parts")


def q98_secret_equality(spark: SparkSession, d: str) -> DataFrame:
    """Equality told from the ciphertexts of a table."""
    return _secret(spark, d).query().where("p_brand").eq("Brand#12").execute().select("_key", "p_name", "p_brand")


def q99_secret_range(spark: SparkSession, d: str) -> DataFrame:
    return _secret(spark, d).query().where("size").between(-5, 5).or_("size").gt(20).execute().select("_key", F.col("size").cast("int").alias("size"))


def q100_secret_match(spark: SparkSession, d: str) -> DataFrame:
    """MATCH on postings whose terms are keyed hashes."""
    return _secret(spark, d).query().where("p_brand").full_text_match("brand12").execute().select("_key")


def q101_secret_opaque(spark: SparkSession, d: str) -> DataFrame:
    """A comparison that the scheme does not allow on ciphertexts is made on decrypted values."""
    return _secret(spark, d).query().where("p_name").lt("c").and_("size").lt(0).execute().select("_key", "p_name")


def q102_no_plain_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The values of encrypted fields that a scan of all of a table's files, indexes included, meets: none."""
    t = _secret(spark, d)
    stored = t._read().select(*[F.explode(F.array(*[F.col(c).cast("binary") for c in _SCHEMES])).alias("raw")])
    for index in t.indexes:
        stored = stored.unionByName(t._terms(index).select(F.col("term").cast("binary").alias("raw")))
    rows = _parts(spark, d)
    plain = rows.select(F.explode(F.array("p_name", "p_brand", F.col("size").cast("string"))).alias("v")).distinct().select(F.encode("v", "utf-8").alias("raw"))
    return stored.agg(F.count("raw").alias("stored")).crossJoin(stored.join(plain, "raw", "left_semi").agg(F.count("*").alias("plain")))


def q103_encryption_enabled(spark: SparkSession, d: str) -> DataFrame:
    """A table that is encrypted after it has rows reads as before."""
    engine, rows = _engine(spark), _parts(spark, d)
    engine.create_table("parts", of_dataframe("parts", rows), "bigint").create(rows)
    t = engine.enable_encryption("parts", {"p_name": "DETERMINISTIC", "size": "ORDER_PRESERVING"})
    return t.current().withColumn("size", F.col("size").cast("int"))


def _all_schemes() -> dict[str, Field]:
    return {"p_brand": Field("p_brand", STRING, "DETERMINISTIC"), "p_name": Field("p_name", STRING, "OPAQUE"), "size": Field("size", INT16, "ORDER_PRESERVING"), "v": Field("v", VectorOf(3), "DISTANCE_PRESERVING")}


def _rekeyed(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, Field]]:
    """Parts under all four schemes, encrypted under the first key version and then under the second."""
    fields, old = _all_schemes(), crypto.Keys(_KEYS.versions, 1)
    rows = _parts(spark, d).withColumn("v", F.array(F.col("size").cast("float"), F.lit(1.0).cast("float"), (F.col("_key") % 7).cast("float")))
    for name, f in fields.items():
        rows = rows.withColumn(name, crypto.FieldCipher(f, old).encrypt(F.col(name)))
    rows = storage.materialise(rows, "ciphertexts")
    return storage.materialise(crypto.rekey(rows, {n: crypto.FieldCipher(f, _KEYS) for n, f in fields.items()}, _KEYS), "ciphertexts"), fields


def q104_rekey_all(spark: SparkSession, d: str) -> DataFrame:
    rows, fields = _rekeyed(spark, d)
    back = {n: crypto.FieldCipher(f, _KEYS).decrypt(F.col(n)) for n, f in fields.items()}
    versions_ = F.array_distinct(F.array(*[crypto.version_of(F.col(n)) for n in fields]))
    return rows.select("_key", versions_[0].alias("key_version"), F.size(versions_).alias("versions"), back["p_brand"].alias("p_brand"), back["p_name"].alias("p_name"), back["size"].cast("int").alias("size"), F.round(back["v"][2], 3).cast("double").alias("v"))


def q105_valid_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Ciphertexts by scheme, and how many have a length that the scheme can give."""
    rows, fields = _rekeyed(spark, d)
    parts = [rows.select(F.lit(f.encryption).alias("scheme"), F.col(n).alias("e"), crypto.valid_length(F.col(n), f.encryption, 3).alias("fits"), crypto.valid_length(F.substring(F.col(n), 1, 19), f.encryption, 3).alias("cut")) for n, f in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("scheme").agg(F.count("e").alias("n"), F.count_if("fits").alias("n_valid"), F.count_if("cut").alias("n_cut_valid"))


def q106_damaged(spark: SparkSession, d: str) -> DataFrame:
    """Ciphertexts with one byte changed, or taken for another field's: none is decrypted."""
    rows, fields = _rekeyed(spark, d)
    changed = lambda c: F.concat(F.substring(c, F.lit(1), F.octet_length(c) - 1), F.unhex(F.lpad(F.hex((F.conv(F.hex(F.substring(c, F.octet_length(c), F.lit(1))), 16, 10).cast("int") + 1) % 256), 2, "0")))
    sums = []
    for n, f in fields.items():
        own, other = crypto.FieldCipher(f, _KEYS), crypto.FieldCipher(Field("other", f.type, f.encryption), _KEYS)
        sums.append(F.count_if(own.decrypt(changed(F.col(n))).isNotNull()) + F.count_if(other.decrypt(F.col(n)).isNotNull()))
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    return rows.agg(F.count("*").alias("n"), total.cast("bigint").alias("decrypted"))


def q107_nearest_on_ciphertexts(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors by distance-preserving ciphertexts: whether nine of the ten best plain ones or more are found."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("_key"), "embedding")
    width = len(rows.first().embedding)
    t = _engine(spark).create_encrypted_table("vectors", of_dataframe("vectors", rows, embedding=VectorOf(width)), {"embedding": "DISTANCE_PRESERVING"}, "bigint")
    t.create_index("embedding", "VECTOR", "cosine")
    t.create(rows)
    query = [((i * 5) % 13 - 6) / 10 for i in range(width)]
    near = t.query().where("embedding").vector_nearest(query, 10).execute().select("_key")
    plain = vector.top_k(rows, "_key", "embedding", query, 10).select("_key")
    return plain.join(near.withColumn("hit", F.lit(1)), "_key", "left").agg(F.count("*").alias("wanted"), (F.count("hit") >= 9).alias("nine_found"))


def q108_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """What each scheme allows."""
    operations = ("equality", "range", "keyword", "nearest")
    return spark.createDataFrame([(s, o, crypto.supports(s, o)) for s in sorted(crypto.CAPABILITIES) for o in operations], "scheme string, operation string, allowed boolean")


def q109_index_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Which indexes a field can have under each scheme."""
    schema = TableSchema("t", 1, tuple(Field(f"f_{s.lower()}", STRING, s) for s in sorted(crypto.CAPABILITIES)))
    made = []
    for f in schema.fields:
        for kind in ("EQUALITY", "RANGE", "UNIQUE", "FULL_TEXT"):
            try:
                check_index(schema, f.name, kind)
                made.append((f.encryption, kind, True))
            except SchemaError:
                made.append((f.encryption, kind, False))
    return spark.createDataFrame(made, "scheme string, kind string, allowed boolean")


# -- refusals: each row names what was tried
def _refused(spark: SparkSession, tried: dict[str, tuple[Callable[[], object], type[Exception]]]) -> DataFrame:
    made = []
    for what, (run, error) in tried.items():
        try:
            run()
            made.append((what, False))
        except error:
            made.append((what, True))
    return spark.createDataFrame(made, "what string, refused boolean")


def q110_refused_statements(spark: SparkSession, d: str) -> DataFrame:
    nested = ObjectOf((Field("city", STRING),))
    schema = TableSchema("t", 1, (Field("name", STRING), Field("age", INT32), Field("small", INT16), Field("ok", BOOLEAN), Field("v", VectorOf(2)), Field("addr", nested)))
    text = {
        "LIKE": "name LIKE 'a%'", "IN": "age IN (1, 2)", "NOT": "NOT age = 1", "IS NULL": "age IS NULL", "column with column": "age > small", "unknown field": "nope = 1", "text with number": "age = 'x'", "number with text": "name = 1",
        "out of range": "small = 70000", "boolean with number": "ok = 1", "nested field": "addr.city = 'x'", "object": "addr = 'x'", "match of a number": "MATCH(age, 'x')", "reversed between": "age BETWEEN 9 AND 1",
    }
    tried = {what: (lambda w=w: sql.translate(f"SELECT name FROM t WHERE {w}", schema), sql.SqlError) for what, w in text.items()}
    tried["MATCH in ORDER BY"] = (lambda: sql.translate("SELECT name FROM t ORDER BY MATCH(name, 'x')", schema), sql.SqlError)
    tried["unknown projection"] = (lambda: sql.translate("SELECT nope FROM t", schema), sql.SqlError)
    tried["distance of a text"] = (lambda: sql.translate("SELECT name FROM t ORDER BY VECTOR_DISTANCE(name, ?, 'cosine')", schema), sql.SqlError)
    tried["query of another length"] = (lambda: P.check(P.VectorNearest("v", (1.0, 2.0, 3.0), 1), schema), P.PredicateError)
    tried["no neighbours asked for"] = (lambda: P.VectorNearest("v", (1.0, 2.0), 0), P.PredicateError)
    tried["where twice"] = (lambda: Query(spark.range(1), schema).where("age").eq(1).where("age"), P.PredicateError)
    tried["a statement that is right"] = (lambda: sql.translate("SELECT name AS n FROM t WHERE age > ? AND name = 'x' ORDER BY age LIMIT 3", schema), sql.SqlError)
    return _refused(spark, tried)


def q111_refused_rows(spark: SparkSession, d: str) -> DataFrame:
    schema = TableSchema("t", 1, (Field("code", BoundedString(4)), Field("v", VectorOf(2, FLOAT16)), Field("tags", ArrayOf(BoundedString(2)))))
    t = _engine(spark).create_table("t", schema)
    ddl = "_key string, code string, v array<float>, tags array<string>"
    t.create(spark.createDataFrame([("a", "abcd", [1.0, 2.0], ["xy"])], ddl))
    bad = {
        "long text": ("c", "日日", None, None), "short vector": ("c", None, [1.0], None), "NaN": ("c", None, [1.0, float("nan")], None), "beyond half precision": ("c", None, [1.0, 1e6], None),
        "null element": ("c", None, [1.0, None], None), "long tag": ("c", None, None, ["abc"]), "key that is there": ("a", None, None, None), "null key": (None, None, None, None), "good row": ("b", None, None, None),
    }

    def limits(row: tuple) -> None:
        if not schema.violations(spark.createDataFrame([row], ddl)).isEmpty():
            raise SchemaError("breaks the limits")
        t.create(spark.createDataFrame([row], ddl))

    tried = {what: (lambda r=r: limits(r), (SchemaError, DuplicateKeyError)) for what, r in bad.items()}
    tried["missing key"] = (lambda: t.update(spark.createDataFrame([("z", None, None, None)], ddl)), KeyNotFoundError)
    tried["key twice"] = (lambda: t.create(spark.createDataFrame([("y", None, None, None)] * 2, ddl)), DuplicateKeyError)
    tried["unknown mode"] = (lambda: t.update(spark.createDataFrame([bad["good row"]], ddl), "MERGE"), ValueError)
    return _refused(spark, tried)


def q112_refused_declarations(spark: SparkSession, d: str) -> DataFrame:
    schema = TableSchema("t", 1, (Field("s", STRING), Field("flag", BOOLEAN), Field("v", VectorOf(3)), Field("n", INT64)))
    index = vector.InvertedFile(table(spark, d, "embeddings"), "vec_id", "embedding", "cosine", 4)
    query = [0.1] * len(index.centroids[0])
    order = crypto.Keys({1: b"k" * 32})
    return _refused(spark, {
        "index of a boolean": (lambda: check_index(schema, "flag", "EQUALITY"), SchemaError), "range of vectors": (lambda: check_index(schema, "v", "RANGE"), SchemaError), "text index of numbers": (lambda: check_index(schema, "n", "FULL_TEXT"), SchemaError),
        "vectors without a metric": (lambda: check_index(schema, "v", "VECTOR"), SchemaError), "unknown index": (lambda: check_index(schema, "s", "HASH"), SchemaError), "good index": (lambda: check_index(schema, "v", "VECTOR", "dot"), SchemaError),
        "field twice": (lambda: TableSchema("t", 1, (Field("a", STRING), Field("a", INT32))), SchemaError), "vector of whole numbers": (lambda: VectorOf(3, INT32), SchemaError), "no dimensions": (lambda: VectorOf(0), SchemaError), "empty text": (lambda: BoundedString(0), SchemaError),
        "more probes than lists": (lambda: index.search(query, 3, 5), ValueError), "no probes": (lambda: index.search(query, 3, 0), ValueError), "all probes": (lambda: index.search(query, 3, 4), ValueError), "unknown metric": (lambda: vector.InvertedFile(table(spark, d, "embeddings"), "vec_id", "embedding", "manhattan"), ValueError),
        "order of long numbers": (lambda: crypto.FieldCipher(Field("n", INT64, "ORDER_PRESERVING"), order), crypto.CryptoError), "distances of texts": (lambda: crypto.FieldCipher(Field("s", STRING, "DISTANCE_PRESERVING"), order), crypto.CryptoError),
        "gap between ranges": (lambda: partitioning.RangePartitions.from_ranges([(1, 0, 5), (2, 6, 9)]), partitioning.PartitionError), "ranges that meet": (lambda: partitioning.RangePartitions.from_ranges([(1, 0, 5), (2, 5, 9)]), partitioning.PartitionError),
    })


# -- the catalogue
def q113_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Tables listed after some were made and one was dropped, with what is known of them."""
    engine, rows = _engine(spark), _parts(spark, d)
    schema = of_dataframe("t", rows)
    for name in ("plain", "dropped", "grown"):
        engine.create_table(name, schema, "bigint")
    engine.create_encrypted_table("secret", schema, {"p_name": "OPAQUE"}, "bigint")
    engine.evolve_table("grown", (Field("rank", INT64),))
    engine.drop_table("dropped")
    found = [engine.table_metadata(n) for n in engine.list_tables()]
    return spark.createDataFrame([(m.name, m.key_type, m.state, m.encrypted, len(m.schema.fields)) for m in found], "name string, key_type string, state string, encrypted boolean, fields int")


def q114_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The number of tables and of handles given out."""
    engine, schema = _engine(spark), of_dataframe("t", _parts(spark, d))
    engine.create_table("a", schema, "bigint")
    engine.create_table("b", schema, "bigint")
    engine.get_table("a")
    m = engine.metrics()
    return spark.createDataFrame([("tables", m["tables"]), *((f"handles {n}", k) for n, k in m["handles"].items())], "metric string, value int")


def q115_refused_names(spark: SparkSession, d: str) -> DataFrame:
    engine, schema = _engine(spark), of_dataframe("t", _parts(spark, d))
    engine.create_table("there", schema, "bigint")
    return _refused(spark, {
        "name that is there": (lambda: engine.create_table("there", schema, "bigint"), TableExistsError), "empty name": (lambda: engine.create_table("", schema), SchemaError), "name with a slash": (lambda: engine.create_table("a/b", schema), SchemaError),
        "unknown table": (lambda: engine.get_table("never"), TableNotFoundError), "drop of an unknown table": (lambda: engine.drop_table("never"), TableNotFoundError), "table that is there": (lambda: engine.get_table("there"), TableNotFoundError),
    })


def q116_schema_kept(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a nested schema after it was written and read."""
    schema = TableSchema("t", 3, (Field("a", STRING, "OPAQUE"), Field("v", VectorOf(3, FLOAT16)), Field("o", ObjectOf((Field("l", ArrayOf(FLOAT32)), Field("b", BoundedString(9)))))))
    back = TableSchema.from_json(schema.to_json())
    same = back == schema
    return spark.createDataFrame([(f.name, f.encryption, f.spark().dataType.simpleString(), same) for f in back.fields], "name string, encryption string, type string, same boolean")


# -- further operators
def q117_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A configured key space, and which of its partitions a range of keys touches."""
    space = partitioning.RangePartitions.from_ranges([(30, 4000, 9000), (10, 0, 1000), (20, 1000, 4000)])
    owner = partitioning.owners_of_range(space, "orders/", 500, 3000, ["node-a"])
    rows = [(i, a, b, i in owner, owner.get(i)) for i, a, b in zip(space.ids, space.bounds, space.bounds[1:], strict=False)]
    return spark.createDataFrame(rows, "partition_id int, low int, high int, touched boolean, owner string")


def q118_json_values(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, texts and arrays inside the JSON values of the log, without a schema."""
    w = table(spark, d, "wal_entries").where("kind IS NOT NULL AND put_value IS NOT NULL")
    j = F.col("put_value")
    found = w.select("feed_pos", jsondocs.number_at(j, "int", "$.addr.zip").alias("zip"), jsondocs.text_at(j, "$.name").alias("name"), jsondocs.array_size(j, "$.embedding").cast("bigint").alias("n"), jsondocs.array_get(j, 1, "$.embedding").cast("double").alias("second"))
    return found.where("zip IS NOT NULL OR name IS NOT NULL OR n IS NOT NULL").withColumn("second", F.round("second", 6))


def q118_json_elements(spark: SparkSession, d: str) -> DataFrame:
    """Every element of the arrays inside the JSON values of the log."""
    w = table(spark, d, "wal_entries").where("kind IS NOT NULL AND put_value IS NOT NULL")
    return jsondocs.array_stream(w, "put_value", "feed_pos", path="$.embedding").select("feed_pos", F.col("at").cast("bigint").alias("at"), F.round(F.col("element").cast("double"), 6).alias("x"))


def q119_usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors that have their field's length and only finite elements."""
    nodes, fields = table(spark, d, "vector_nodes"), table(spark, d, "vector_fields").select("field_name", "dimensions")
    both = nodes.join(fields, "field_name")
    return both.groupBy("field_name").agg(F.count("*").alias("n"), F.count_if(vector.usable(F.col("node_vector"), F.col("dimensions"))).alias("usable"))


def q120_newest_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The newest value of every key of the log, merged on read."""
    log = table(spark, d, "wal_entries").where("entry_key IS NOT NULL AND sequence_number IS NOT NULL").select(F.col("entry_key").alias("_key"), F.col("sequence_number").alias("_seq"), F.lit(versions.PUT).alias("_op"))
    return versions.newest(log).select("_key", "_seq")


QUERIES = {name: query for name, query in globals().items() if name.startswith("q") and name[1:3].isdigit()}


def _refusals(*refused: str, allowed: tuple[str, ...] = ()) -> str:
    rows = [f"('{what}', TRUE)" for what in refused] + [f"('{what}', FALSE)" for what in allowed]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(what, refused)"


_SMALL = "part AS (SELECT p_partkey AS _key, p_name, p_brand, p_size - 25 AS size FROM part)"
_DOCS = """docs AS (
    SELECT doc_id AS _key, CASE WHEN doc_id % 10 = 3 THEN 'a payload of later days' ELSE text END AS text, lang, CASE WHEN doc_id % 10 = 3 THEN 23 ELSE n_chars END AS n_chars
    FROM documents WHERE doc_id IS NOT NULL AND doc_id % 10 <> 7)"""
_HAS = r"list_contains(list_transform(regexp_split_to_array(text, '\s+'), lambda w: lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'))), 'payload')"
_WAL = "kind IS NOT NULL AND put_value IS NOT NULL AND json_valid(put_value)"
ORACLES = {
    "q82_string_keys": "SELECT c_name AS _key, c_acctbal FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000050'",
    "q83_point_read_of_a_snapshot": "SELECT c_custkey AS _key, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer WHERE c_custkey = 77",
    "q84_recovered": "SELECT c_custkey AS _key, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer",
    "q85_replay": """SELECT c_custkey AS _key, 2 AS _seq, 'P' AS _op, c_name, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 3, 'D', NULL, NULL FROM customer WHERE c_custkey % 5 = 0""",
    "q86_insert": "SELECT c_name AS _key, c_name, c_acctbal FROM customer",
    "q87_lines_round_trip": "SELECT c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer",
    "q88_lenient_not": "SELECT _key, age FROM users WHERE NOT age >= 30",
    "q89_lenient_null": "SELECT _key, name FROM users WHERE email IS NULL AND name IS NOT NULL",
    "q90_index_match": f"WITH {_DOCS} SELECT lang, n_chars FROM docs WHERE {_HAS}",
    "q90_index_stemmed": r"""WITH hit AS (SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_full_match(lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), 'segment(s|ed|ing|al|ation|ations)?'))) > 0)
SELECT doc_id AS _key FROM hit UNION ALL SELECT -doc_id - 1 FROM hit WHERE doc_id % 7 = 0""",
    "q91_index_range": f"WITH {_DOCS} SELECT _key, n_chars FROM docs WHERE n_chars BETWEEN 20 AND 60",
    "q92_index_equality": f"WITH {_DOCS} SELECT _key, lang FROM docs WHERE lang = 'de' AND n_chars > 400",
    "q93_index_chosen": "SELECT * FROM (VALUES ('FullTextMatch text', 'FULL_TEXT'), ('Eq lang', 'EQUALITY'), ('Gt lang', NULL), ('Eq n_chars', 'RANGE'), ('Lt n_chars', 'RANGE'), ('Ne n_chars', NULL), ('Between n_chars', 'RANGE')) AS t(leaf, kind)",
    "q94_index_nearest": "SELECT vec_id AS _key, label FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], list_transform(range(len(embedding)), lambda i: ((i * 7) % 11 - 5) / 10)), vec_id LIMIT 12",
    "q95_unique_by_another_handle": _refusals("a value that is there", "twice in a batch", "a value added since", allowed=("a new value",)),
    "q96_removed_from_index": f"SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND {_HAS} UNION ALL SELECT -doc_id - 1 FROM documents WHERE doc_id % 20 = 0",
    "q97_byte_terms": "SELECT hex(encode(name)) AS term, count(*) AS n_keys FROM (SELECT DISTINCT _key, name FROM users WHERE _key IS NOT NULL AND name IS NOT NULL) GROUP BY 1",
    "q98_secret_equality": "SELECT p_partkey AS _key, p_name, p_brand FROM part WHERE p_brand = 'Brand#12'",
    "q99_secret_range": f"WITH {_SMALL} SELECT _key, size FROM part WHERE size BETWEEN -5 AND 5 OR size > 20",
    "q100_secret_match": "SELECT p_partkey AS _key FROM part WHERE p_brand = 'Brand#12'",
    "q101_secret_opaque": f"WITH {_SMALL} SELECT _key, p_name FROM part WHERE p_name < 'c' AND size < 0",
    "q102_no_plain_bytes": "SELECT 4 * count(*) AS stored, 0::BIGINT AS plain FROM part",
    "q103_encryption_enabled": f"WITH {_SMALL} SELECT _key, p_name, p_brand, size FROM part",
    "q104_rekey_all": f"WITH {_SMALL} SELECT _key, 2 AS key_version, 1 AS versions, p_brand, p_name, size, (_key % 7)::DOUBLE AS v FROM part",
    "q105_valid_lengths": "SELECT scheme, count(*) AS n, count(*) AS n_valid, 0::BIGINT AS n_cut_valid FROM part, (SELECT unnest(['DETERMINISTIC', 'OPAQUE', 'ORDER_PRESERVING', 'DISTANCE_PRESERVING']) AS scheme) GROUP BY scheme",
    "q106_damaged": "SELECT count(*) AS n, 0::BIGINT AS decrypted FROM part",
    "q107_nearest_on_ciphertexts": "SELECT least(10, count(*)) AS wanted, TRUE AS nine_found FROM embeddings",
    "q108_capabilities": """SELECT scheme, operation, scheme = 'NONE' OR (scheme = 'DETERMINISTIC' AND operation IN ('equality', 'keyword')) OR (scheme = 'ORDER_PRESERVING' AND operation IN ('equality', 'range'))
    OR (scheme = 'DISTANCE_PRESERVING' AND operation = 'nearest') AS allowed
FROM (SELECT unnest(['NONE', 'DETERMINISTIC', 'ORDER_PRESERVING', 'DISTANCE_PRESERVING', 'OPAQUE']) AS scheme), (SELECT unnest(['equality', 'range', 'keyword', 'nearest']) AS operation)""",
    "q109_index_compatibility": """SELECT scheme, kind, scheme = 'NONE' OR (scheme = 'DETERMINISTIC' AND kind <> 'RANGE') OR (scheme = 'ORDER_PRESERVING' AND kind <> 'FULL_TEXT') AS allowed
FROM (SELECT unnest(['NONE', 'DETERMINISTIC', 'ORDER_PRESERVING', 'DISTANCE_PRESERVING', 'OPAQUE']) AS scheme), (SELECT unnest(['EQUALITY', 'RANGE', 'UNIQUE', 'FULL_TEXT']) AS kind)""",
    "q110_refused_statements": _refusals(
        "LIKE", "IN", "NOT", "IS NULL", "column with column", "unknown field", "text with number", "number with text", "out of range", "boolean with number", "nested field", "object", "match of a number", "reversed between",
        "MATCH in ORDER BY", "unknown projection", "distance of a text", "query of another length", "no neighbours asked for", "where twice", allowed=("a statement that is right",),
    ),
    "q111_refused_rows": _refusals("long text", "short vector", "NaN", "beyond half precision", "null element", "long tag", "key that is there", "null key", "missing key", "key twice", "unknown mode", allowed=("good row",)),
    "q112_refused_declarations": _refusals(
        "index of a boolean", "range of vectors", "text index of numbers", "vectors without a metric", "unknown index", "field twice", "vector of whole numbers", "no dimensions", "empty text", "more probes than lists", "no probes", "unknown metric",
        "order of long numbers", "distances of texts", "gap between ranges", allowed=("good index", "all probes", "ranges that meet"),
    ),
    "q113_catalogue": "SELECT * FROM (VALUES ('grown', 'bigint', 'READY', FALSE, 4), ('plain', 'bigint', 'READY', FALSE, 3), ('secret', 'bigint', 'READY', TRUE, 3)) AS t(name, key_type, state, encrypted, fields)",
    "q114_metrics": "SELECT * FROM (VALUES ('tables', 2), ('handles a', 2), ('handles b', 1)) AS t(metric, value)",
    "q115_refused_names": _refusals("name that is there", "empty name", "name with a slash", "unknown table", "drop of an unknown table", allowed=("table that is there",)),
    "q116_schema_kept": "SELECT * FROM (VALUES ('a', 'OPAQUE', 'string', TRUE), ('v', 'NONE', 'array<float>', TRUE), ('o', 'NONE', 'struct<l:array<float>,b:string>', TRUE)) AS t(name, encryption, type, same)",
    "q117_ranges": "SELECT * FROM (VALUES (10, 0, 1000, TRUE, 'node-a'), (20, 1000, 4000, TRUE, 'node-a'), (30, 4000, 9000, FALSE, NULL)) AS t(partition_id, low, high, touched, owner)",
    "q118_json_values": f"""SELECT * FROM (SELECT feed_pos, CASE WHEN json_type(put_value, '$.addr.zip') IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(put_value->>'$.addr.zip' AS INT) END AS zip,
    CASE WHEN json_type(put_value, '$.name') = 'VARCHAR' THEN put_value->>'$.name' END AS name,
    CASE WHEN json_type(put_value, '$.embedding') = 'ARRAY' THEN json_array_length(put_value, '$.embedding')::BIGINT END AS n,
    round((put_value->>'$.embedding[1]')::DOUBLE, 6) AS second FROM wal_entries WHERE {_WAL}) WHERE zip IS NOT NULL OR name IS NOT NULL OR n IS NOT NULL""",
    "q118_json_elements": f"""SELECT feed_pos, i - 1 AS at, round(e[i], 6) AS x FROM (SELECT feed_pos, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT feed_pos, (put_value->'$.embedding')::DOUBLE[] AS e FROM wal_entries
WHERE {_WAL} AND json_type(put_value, '$.embedding') = 'ARRAY'))""",
    "q119_usable_vectors": "SELECT field_name, count(*) AS n, count_if(len(node_vector) = dimensions AND len(list_filter(node_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS usable FROM vector_nodes JOIN vector_fields USING (field_name) GROUP BY 1",
    "q120_newest_of_all": "SELECT entry_key AS _key, max(sequence_number) AS _seq FROM wal_entries WHERE entry_key IS NOT NULL AND sequence_number IS NOT NULL GROUP BY 1",
}
