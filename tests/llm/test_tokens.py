import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafold.llm import tokens

TEXTS = [
    None, "", " ", "\n\n \t", "a", "Hello, world's  best!", "<|endoftext|> is text", "x" * 5000, "ab" * 3000, " " * 3000, "\r\n\r\n  x", "日本語テキスト, שלום, привет", "\U0001f600\U0001f468‍\U0001f469",
    "1234567890 " * 50, "é́ nfd", "\u0000 ﻿", "don't CAN'T we'll", "SELECT * FROM t WHERE a<=1;--", "".join(map(chr, range(32, 600))),
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder()


def ids(encoder, text):
    return encoder.encode([text])[0].tolist()


def test_fixed_texts(encoder, reference):
    for t in TEXTS:
        assert ids(encoder, t) == reference.encode_ordinary(t or "")


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=300))
def test_any_text(encoder, reference, text):
    assert ids(encoder, text) == reference.encode_ordinary(text)


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="abcdeinorst", min_size=100, max_size=900))
def test_long_words(encoder, reference, text):
    assert ids(encoder, text) == reference.encode_ordinary(text)


def test_both_trees_agree():
    merges = tokens.Merges(tokens.VOCABULARY)
    r = random.Random(2)
    words = ["".join(r.choice("etaoinshr lu") for _ in range(r.randrange(1, 120))).encode() for _ in range(400)]
    for word, a in zip(words, tokens.merge_pieces(merges, words), strict=True):
        assert a.tolist() == (tokens._merge_one(merges, word).tolist() if len(word) > 1 else [int(merges.byte_ids[word[0]])])


def test_memory_is_bounded(reference):
    encoder = tokens.Encoder(remembered=50)
    r = random.Random(1)
    for _ in range(40):
        batch = [" ".join(str(r.randrange(10**6)) for _ in range(30)) for _ in range(3)]
        flat, sizes = encoder.encode(batch)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [reference.encode_ordinary(t) for t in batch]
        assert len(encoder.known) < 50 + 90 + 90


def test_encode_and_count(spark, reference):
    df = spark.createDataFrame([(i, t, "?", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "?", 1), (3, TEXTS[3], "?", 1)], "doc_id bigint, text string, ids string, n_tokens int")
    got = sorted(((r.doc_id is None, r.doc_id, r.ids) for r in tokens.encode(df).collect()), key=repr)
    want = sorted(((r.doc_id is None, r.doc_id, reference.encode_ordinary(r.text or "")) for r in df.collect()), key=repr)
    assert got == want
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).where(F.col("doc_id").isNotNull()).collect()}
    assert counts == {i: len(reference.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}
    assert tokens.encode(df.limit(0)).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert len(tokens.encode(df).first().ids) >= 3
