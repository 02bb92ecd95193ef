import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafold import crypto, storage
from stratafold.functions import text, vector
from stratafold.schema import BOOLEAN, FLOAT32, FLOAT64, INT8, INT16, INT32, INT64, STRING, TIMESTAMP, ArrayOf, BoundedString, Field, ObjectOf, TableSchema, VectorOf
from stratafold.sources import jsondocs

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
    "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "by": "by", "": "",
}


def test_published_stems():
    assert {w: text.stem(w) for w in STEMS} == STEMS


def test_tokens(spark):
    df = spark.createDataFrame([(1, "  Don't STOP, the déjà-vu!  x1 "), (2, ""), (3, None), (4, "... --"), (5, "日本 a\tb\nc")], "id int, t string")
    got = {r.id: r.w for r in df.select("id", text.tokens(F.col("t")).alias("w")).collect()}
    assert got == {1: ["dont", "stop", "the", "déjàvu", "x1"], 2: [], 3: None, 4: [], 5: ["日本", "a", "b", "c"]}
    kept = {r.id: r.w for r in df.select("id", text.analyse(F.col("t")).alias("w")).collect()}
    assert kept[1] == ["dont", "stop", "déjàvu", "x1"] and kept[3] is None
    posts = {(r.field, r.term, r.id) for r in text.postings(df, "id", "t").collect()}
    assert ("t", "stop", 1) in posts and not any(p[2] in (2, 3, 4) for p in posts)
    for bad in ("", " ", "a\0b"):
        with pytest.raises(ValueError):
            text.postings(df, "id", bad)
    assert len(text.STOP_WORDS) == 128


def test_similarities(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 2.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "id int, v array<float>")
    q = [2.0, 1.0, 2.0]
    got = {r.id: (r.d, r.c, r.e) for r in df.select("id", vector.dot(F.col("v"), q).alias("d"), vector.cosine(F.col("v"), q).alias("c"), vector.euclidean(F.col("v"), q).alias("e")).collect()}
    assert got[1] == pytest.approx((8, 8 / 9, 2**0.5)) and got[2] == pytest.approx((0, 0, 3)) and got[3][0] is None
    assert vector.top_k(df, "id", "v", q, 5, "euclidean").count() == 2
    with pytest.raises(ValueError):
        vector.score(F.col("v"), q, "manhattan")


def test_half_precision(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1, 65504.0, 1e6, 6e-8]), (2, None), (3, [])], "id int, v array<float>")
    got = {r.id: r.h for r in df.select("id", vector.half_precision("v").alias("h")).collect()}
    with np.errstate(over="ignore"):
        assert got[1] == [float(np.float16(x)) for x in (1.0, 0.1, 65504.0, 1e6, 6e-8)]
    assert got[2] is None and got[3] == []


@pytest.mark.parametrize("metric", vector.METRICS)
def test_inverted_file(spark, metric, tmp_path):
    r = np.random.default_rng(4)
    data = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    index = vector.InvertedFile(df, "id", "v", metric, 12)
    q = [float(x) for x in r.normal(size=6)]
    exact = [(x.id, round(x.score, 6)) for x in vector.top_k(df, "id", "v", q, 10, metric).collect()]
    assert [(x.id, round(x.score, 6)) for x in index.search(q, 10, 12).collect()] == exact
    part = index.search(q, 10, 3).collect()
    assert len(part) == 10 and {x.id for x in part} & {i for i, _ in exact}
    removed = spark.createDataFrame([(exact[0][0],)], "id bigint")
    assert exact[0][0] not in {x.id for x in index.search(q, 10, 12, removed).collect()}
    index.write(str(tmp_path / "ivf"))
    assert [(x.id, round(x.score, 6)) for x in index.search(q, 10, 12).collect()] == exact
    assert index.lists.where("centroid = 0 AND id = 0").count() == 1
    for bad in (0, 13):
        with pytest.raises(ValueError):
            index.search(q, 10, bad)


@pytest.mark.parametrize("metric", vector.METRICS)
def test_inverted_file_reads_what_it_needs(spark, metric):
    r = np.random.default_rng(5)
    data = [(i, [float(x) for x in r.normal(size=16) * r.uniform(0.2, 3)]) for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    index = vector.InvertedFile(df, "id", "v", metric, 40)
    for _ in range(3):
        q = [float(x) for x in r.normal(size=16)]
        assert [x.id for x in index.search(q, 10).collect()] == [x.id for x in vector.top_k(df, "id", "v", q, 10, metric).collect()]
    whole, part = (index.recall(df.where("id % 50 = 0"), 10, probes).first() for probes in (None, 2))
    assert (whole.queries, whole.wanted, whole.recall) == (8, 80, 1.0) and part.recall < 0.9


def test_inverted_file_of_nothing(spark):
    index = vector.InvertedFile(spark.createDataFrame([], "id bigint, v array<float>"), "id", "v")
    assert index.search([1.0], 3).count() == 0


KEYS = crypto.Keys({1: b"k" * 32, 2: b"l" * 32})


def test_ciphertexts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "id int, v string")
    enc = df.select("id", crypto.deterministic(F.col("v"), "v", KEYS).alias("d"), crypto.opaque(F.col("v"), "v", KEYS).alias("o"), crypto.deterministic(F.col("v"), "w", KEYS).alias("w")).persist()
    got = {r.id: r for r in enc.collect()}
    assert got[1].d == got[2].d != got[3].d and got[1].d != got[1].w and got[1].o != got[2].o and got[4].d is None and got[4].o is None
    back = enc.select("id", crypto.decrypt(F.col("d"), "v", KEYS, "DETERMINISTIC").alias("d"), crypto.decrypt(F.col("o"), "v", KEYS, "OPAQUE").alias("o"), crypto.decrypt(F.col("w"), "v", KEYS, "DETERMINISTIC").alias("w"))
    assert sorted((r.id, r.d, r.o) for r in back.collect() if r.d is not None) == [(1, "a", "a"), (2, "a", "a"), (3, "b", "b"), (5, "", "")]
    assert all(r.w is None for r in back.collect())
    only_old = crypto.Keys({1: b"k" * 32})
    assert all(r[0] is None for r in enc.select(crypto.decrypt(F.col("d"), "v", only_old, "DETERMINISTIC")).collect())
    assert enc.where(crypto.valid_length(F.col("d"), "DETERMINISTIC") & crypto.valid_length(F.col("o"), "OPAQUE")).count() == 4
    enc.unpersist()


def test_key_rules():
    for bad in ({}, {0: b"k" * 32}, {1: b"short"}):
        with pytest.raises(crypto.CryptoError):
            crypto.Keys(bad)
    assert crypto.supports("DETERMINISTIC", "equality") and not crypto.supports("DETERMINISTIC", "range") and not crypto.supports("OPAQUE", "equality") and crypto.supports("DISTANCE_PRESERVING", "nearest")
    with pytest.raises(crypto.CryptoError):
        crypto.supports("ROT13", "equality")


@settings(deadline=None, max_examples=100)
@given(st.integers(-32768, 32767), st.integers(-32768, 32767))
def test_order_is_preserved(a, b):
    scheme = _order("INT16")
    assert (a < b) == (scheme.encrypt_value(a) < scheme.encrypt_value(b))


_cache = {}


def _order(kind):
    return _cache.setdefault(kind, crypto.OrderPreserving(KEYS, "f", kind))


def test_order_columns(spark):
    df = spark.createDataFrame([(-5,), (0,), (127,), (-128,), (None,)], "n int")
    scheme = _order("INT8")
    got = df.select("n", scheme.encrypt(F.col("n")).alias("e")).withColumn("back", scheme.decrypt(F.col("e"))).collect()
    assert [r.n for r in got] == [r.back for r in got]
    words = _order("STRING")
    assert words.encrypt_value("a") < words.encrypt_value("ab") < words.encrypt_value("b")
    for bad in (lambda: words.encrypt_value("abc"), lambda: scheme.encrypt_value(128), lambda: crypto.OrderPreserving(KEYS, "f", "INT64"), lambda: crypto.OrderPreserving(KEYS, "f", "STRING", 3), lambda: words.decrypt(F.lit(1))):
        with pytest.raises(crypto.CryptoError):
            bad()


def test_keyword_index(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([(1, "hello world"), (2, "other words"), (3, None)], "id int, bio string")
    index = crypto.keyword_index(df, "id", "bio", KEYS)
    assert [r.id for r in crypto.keyword_search(index, "hello", "bio", KEYS).collect()] == [1]
    tokens = {r.token for r in index.collect()}
    assert hmac.new(KEYS.derived("bio", "keyword"), b"world", hashlib.sha256).hexdigest() in tokens and len(tokens) == 4


def test_envelopes_of_every_scheme(spark):
    """Lengths as declared, values back, and null for changed bytes, other fields and unknown keys."""
    r = np.random.default_rng(1)
    data = [(i, f"t{i}", i - 20, "ab"[: i % 3], [float(x) for x in r.normal(size=16)]) for i in range(40)] + [(99, None, None, None, None)]
    df = spark.createDataFrame(data, "id bigint, t string, n smallint, c string, v array<float>")
    made = [Field("t", STRING, "DETERMINISTIC"), Field("t", STRING, "OPAQUE"), Field("n", INT16, "ORDER_PRESERVING"), Field("c", BoundedString(2), "ORDER_PRESERVING"), Field("v", VectorOf(16), "DISTANCE_PRESERVING")]
    old = crypto.Keys(KEYS.versions, 1)
    for field in made:
        cipher, name = crypto.FieldCipher(field, old), field.name
        enc = storage.materialise(df.select("id", name, cipher.encrypt(F.col(name)).alias("e")), "test")
        assert enc.where("e IS NULL").count() == 1 and enc.where(crypto.valid_length(F.col("e"), field.encryption, 16)).count() == 40
        anew = storage.materialise(crypto.rekey(enc, {"e": crypto.FieldCipher(field, KEYS)}, KEYS), "test")
        for stored, version in ((enc, 1), (anew, 2)):
            got = stored.select("id", name, crypto.FieldCipher(field, KEYS).decrypt(F.col("e")).alias("back"), crypto.version_of(F.col("e")).alias("version")).collect()
            assert {x.version for x in got if x[name] is not None} == {version}
            assert all(np.allclose(x.back, x[name], atol=1e-5) if name == "v" and x[name] else x.back == x[name] for x in got)
        damaged = F.concat(F.substring(F.col("e"), F.lit(1), F.octet_length("e") - 20), F.lit(b"\x01"), F.substring(F.col("e"), F.octet_length("e") - 18, F.lit(19)))
        other = crypto.FieldCipher(Field("other", field.type, field.encryption), KEYS)
        strange = crypto.FieldCipher(field, crypto.Keys({3: b"m" * 32}))
        assert enc.where(cipher.decrypt(damaged).isNotNull() & (damaged != F.col("e"))).count() == 0
        assert enc.where(other.decrypt(F.col("e")).isNotNull() | strange.decrypt(F.col("e")).isNotNull()).count() == 0
    for bad in (Field("x", INT64, "ORDER_PRESERVING"), Field("x", STRING, "DISTANCE_PRESERVING"), Field("x", BoundedString(3), "ORDER_PRESERVING")):
        with pytest.raises(crypto.CryptoError):
            crypto.FieldCipher(bad, KEYS)


def test_blurred_neighbours(spark):
    r = np.random.default_rng(1)
    data = [(i, [float(x) for x in r.normal(size=16)]) for i in range(200)]
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    cipher = crypto.FieldCipher(Field("v", VectorOf(16), "DISTANCE_PRESERVING"), KEYS)
    blurred = storage.materialise(df.select("id", cipher.encrypt(F.col("v")).alias("v")), "test").select("id", cipher.nearby(F.col("v")).alias("v"))
    q = data[7][1]
    near = {x.id for x in vector.top_k(df, "id", "v", q, 5, "euclidean").collect()}
    assert len(near & {x.id for x in vector.top_k(blurred, "id", "v", q, 5, "euclidean").collect()}) >= 4
    assert blurred.where("id = 7").first().v != df.where("id = 7").first().v


class Vault(crypto.KeyProvider):
    def versions(self):
        return [3, 4]

    def key(self, version):
        return bytes([version]) * 32


def test_keys_of_a_provider():
    keys = crypto.Keys(Vault(), 3)
    assert keys.current == 3 and keys.rotated(b"z" * 32).current == 5 and set(keys.pruned({4}).versions) == {3, 4} and set(keys.pruned(set()).versions) == {3}
    with pytest.raises(crypto.CryptoError):
        keys.pruned({9})


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', '{" ":1}', '{"":1}', "[1,]", "{} x", "01", "NaN", "[Infinity]", '"\\ud800"', "", "{'a':1}", "[" * 300 + "]" * 300])
def test_strict_json_refuses(bad):
    with pytest.raises(jsondocs.JsonError):
        jsondocs.parse_strict(bad)


def test_strict_json_accepts():
    assert jsondocs.parse_strict('{"a":[1,2.5,"x",null,true,{"b":"[["}]}') == {"a": [1, 2.5, "x", None, True, {"b": "[["}]}
    with pytest.raises(jsondocs.JsonError):
        jsondocs.parse_strict("[]", 5000)


DOC = TableSchema("doc", 1, (Field("s", STRING), Field("i", INT8), Field("n", INT64), Field("f", FLOAT64), Field("b", BOOLEAN), Field("at", TIMESTAMP), Field("l", ArrayOf(FLOAT32)), Field("o", ObjectOf((Field("x", INT32), Field("y", STRING))))))


def test_json_documents(spark):
    lines = [
        '{"s":"x","i":5,"n":12345678901,"f":1.5,"b":true,"at":1704067200123,"l":[1,null,2.5],"o":{"x":1,"unknown":2},"more":0}', '{"s":null}', '{"i":300,"n":1.0,"s":"kept"}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, j string")
    docs = jsondocs.documents_from_json(df, "j", DOC, keep=("id",))
    got = {r.id: r for r in docs.collect()}
    assert (got[0].s, got[0].i, got[0].n, got[0].l, got[0].o.x, got[0].o.y, str(got[0].at)) == ("x", 5, 12345678901, [1.0, None, 2.5], 1, None, "2024-01-01 00:00:00.123000")
    assert got[1].s is None and got[2].i is None and got[2].s == "kept"
    again = jsondocs.documents_from_json(docs.select("id", jsondocs.documents_to_json(docs, DOC).alias("j")), "j", DOC, True, ("id",))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, docs.collect()))
    text_of = docs.where("id = 1").select(jsondocs.documents_to_json(docs, DOC).alias("j")).first().j
    assert text_of == '{"s":null,"i":null,"n":null,"f":null,"b":null,"at":null,"l":null,"o":null}'
    odd = spark.createDataFrame([(float("inf"), [float("nan"), 1.0])], "f double, l array<float>")
    assert odd.select(jsondocs.documents_to_json(odd, TableSchema("t", 1, (Field("f", FLOAT64), Field("l", ArrayOf(FLOAT32)))))).first()[0] == '{"f":null,"l":[null,1.0]}'
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        jsondocs.documents_from_json(spark.createDataFrame([("{",)], "j string"), "j", DOC, True).collect()


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"s":"1"}\n\n{"s":"2","s":"3"}\n   \n{"s":"4"}')
    schema = TableSchema("t", 1, (Field("s", STRING),))
    path = str(tmp_path / "a.jsonl")
    assert sorted(r.s for r in jsondocs.read_lines(spark, path, schema, "SKIP_ON_ERROR").collect()) == ["1", "4"]
    with pytest.raises(Exception, match="repeated key"):
        jsondocs.read_lines(spark, path, schema).collect()
    assert [(r.line, r.problem) for r in jsondocs.problem_lines(spark, path).collect()] == [(3, "repeated key")]
    with pytest.raises(ValueError):
        jsondocs.read_lines(spark, path, schema, "IGNORE")
    out = storage.workspace(spark, "test-lines")
    jsondocs.write_lines(spark.createDataFrame([("x",), (None,)], "s string"), schema, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"s":"x"}', '{"s":null}']
    assert sorted(str(r.s) for r in jsondocs.read_lines(spark, out, schema).collect()) == ["None", "x"]


def test_members(spark):
    df = spark.createDataFrame([('{"a":{"b":1},"c d":[1]}',), ("no json",), (None,)], "j string")
    got = [(r.a, r.c, r.k) for r in df.select(jsondocs.member(F.col("j"), "a").alias("a"), jsondocs.member(F.col("j"), "c d").alias("c"), jsondocs.keys(F.col("j")).alias("k")).collect()]
    assert got == [('{"b":1}', "[1]", ["a", "c d"]), (None, None, None), (None, None, None)]


def test_json_accessors(spark):
    texts = ['{"a": 5, "b": 2.5, "c": "7", "d": [1, "x", {"y": null}], "e": true, "f": null, "g": 99999999999}', "[]", "no json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, j string")
    j = F.col("j")
    got = df.select(
        "id", jsondocs.number_at(j, "int", "$.a").alias("a"), jsondocs.number_at(j, "int", "$.b").alias("b_int"), jsondocs.number_at(j, "double", "$.b").alias("b"), jsondocs.number_at(j, "int", "$.c").alias("c"),
        jsondocs.number_at(j, "int", "$.g").alias("g_int"), jsondocs.number_at(j, "long", "$.g").alias("g"), jsondocs.text_at(j, "$.c").alias("text"), jsondocs.text_at(j, "$.a").alias("no_text"), jsondocs.boolean_at(j, "$.e").alias("e"),
        jsondocs.number_at(j, "int", "$.f").alias("f"), jsondocs.array_size(j, "$.d").alias("n"), jsondocs.array_get(j, 2, "$.d").alias("third"), jsondocs.array_get(j, 3, "$.d").alias("fourth"), jsondocs.array_size(j).alias("top"),
    ).orderBy("id").collect()
    assert tuple(got[0])[1:] == (5, None, 2.5, None, None, 99999999999, "7", None, True, None, 3, '{"y":null}', None, None)
    assert got[1].top == 0 and all(x is None for x in tuple(got[2])[1:]) and all(x is None for x in tuple(got[3])[1:])
    assert [(r.id, r.at, r.element) for r in jsondocs.array_stream(df, "j", "id", path="$.d").collect()] == [(0, 0, "1"), (0, 1, '"x"'), (0, 2, '{"y":null}')]
    assert df.where("id = 0").select(jsondocs.number_at(j, "int", "$.a", strict=True).alias("n")).first().n == 5
    for path in ("$.b", "$.c", "$.g"):
        with pytest.raises(Exception, match="is no int"):
            df.where("id = 0").select(jsondocs.number_at(j, "int", path, strict=True)).collect()
