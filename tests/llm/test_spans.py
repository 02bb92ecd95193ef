import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafold.llm import spans

DOCS = "doc_id bigint, text string, h string, first int, around string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "?", 0, "?") for i, t in docs], DOCS)


def letters(seed, n, of):
    r = random.Random(seed)
    return "".join(r.choice(of) for _ in range(n))


def brute(docs, least):
    where = {}
    for i, t in docs:
        for s in range(len(t or "") - least + 1):
            where.setdefault(t[s : s + least], set()).add(i)
    marked = {}
    for i, t in docs:
        for s in range(len(t or "") - least + 1):
            if i is not None and len(where[t[s : s + least]] - {None}) > 1:
                marked.setdefault(i, set()).update(range(s, s + least))
    out = set()
    for i, at in marked.items():
        for s in at:
            if s - 1 not in at:
                e = s
                while e in at:
                    e += 1
                out.add((i, s, e))
    return out


def got(spark, docs, **how):
    return {tuple(r) for r in spans.shared_spans(frame(spark, docs), **how).select("doc_id", "span_start", "span_end").collect()}


def corpus(seed, n=60, alphabet="abcdefghij \n", size=400):
    r = random.Random(seed)
    pieces = ["".join(r.choice(alphabet) for _ in range(r.randrange(40, 300))) for _ in range(12)]
    docs = []
    for i in range(n):
        t = ""
        for _ in range(r.randrange(1, 6)):
            p = r.choice(pieces)
            a = r.randrange(len(p))
            t += p[a : a + r.randrange(20, 300)] if r.random() < 0.6 else "".join(r.choice(alphabet) for _ in range(r.randrange(size)))
        docs.append((i, t))
    return docs


@pytest.mark.parametrize("in_task", [spans.IN_TASK, 3])
def test_against_brute_force(spark, in_task):
    docs = corpus(1) + [(500, None), (501, ""), (502, "x" * 99), (503, "y" * 100), (504, "y" * 100), (505, "z" * 400)]
    assert got(spark, docs, in_task=in_task) == brute(docs, 100)


def test_monotonous_texts(spark):
    docs = [(1, "a" * 5000), (2, "b" * 120 + "a" * 150), (3, "ab" * 300), (4, "ba" * 60), (5, "c" * 3000)]
    assert got(spark, docs) == brute(docs, 100)


def test_code_points_count(spark):
    common = "日本語\U0001f600é" * 25
    docs = [(1, "\U0001f468" * 7 + common), (2, common + "tail"), (3, "é" * 100), (4, "é" * 100)]
    assert got(spark, docs) == brute(docs, 100)


def test_one_text_many_times(spark):
    """A third of all texts are copies; rows of one id are one text."""
    t = letters(3, 700, "abcdef")
    docs = [(i, t) for i in range(200)] + [(1000 + i, letters(i, 300, "ghijkl")) for i in range(400)]
    assert got(spark, docs, in_task=50) == {(i, 0, 700) for i in range(200)}
    assert got(spark, [(1, t), (1, t), (None, t)]) == set()


def test_nothing(spark):
    assert got(spark, []) == set() and got(spark, [(1, None)]) == set()


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(alphabet="ab", max_size=60), max_size=6), st.integers(8, 20))
def test_equal_windows_have_equal_units(texts, least):
    text, first, last, h = spans.units([t for t in texts if t], least, 5)
    kept = [t for t in texts if t]
    of = {}
    for t, a, b, x in zip(text.tolist(), first.tolist(), last.tolist(), h.tolist(), strict=True):
        for s in range(a, b + 1):
            of.setdefault(kept[t][s : s + least], set()).add(x)
    assert all(len(x) == 1 for x in of.values())
    assert sum(b - a + 1 for a, b in zip(first.tolist(), last.tolist(), strict=True)) == sum(max(0, len(t) - least + 1) for t in kept)


def test_parts(spark):
    t = letters(5, 150, "abcdef")
    df = frame(spark, [(1, t + "!" * 50), (2, t), (3, None), (4, "")])
    got = {r.doc_id: (r.chars, r.shared_chars, r.share) for r in spans.shared_parts(df, spans.shared_spans(df)).collect()}
    assert got == {1: (200, 150, 0.75), 2: (150, 150, 1.0), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}


def test_lines(spark):
    long = "This line has a hundred letters or more, so that it counts, which takes some words to say in full " * 2
    docs = [(2, f"short\n  {long.upper()}\nshort"), (1, f"{long}\nshort"), (3, None), (4, long.replace(" ", "\t") + "\n" + long), (5, "short\nshort")]
    got = {tuple(r) for r in spans.duplicate_lines(frame(spark, docs)).select("doc_id", "line_start", "line_end", "first_doc_id", "first_start").collect()}
    n = len(long)
    assert got == {(2, 6, 8 + n, 1, 0), (4, 0, n, 1, 0), (4, n + 1, 2 * n + 1, 1, 0)}
    assert spans.duplicate_lines(frame(spark, docs).limit(0)).where(F.lit(True)).count() == 0


def test_windows_of_equal_hash_are_compared_themselves(monkeypatch):
    """Hashes that tell few windows apart change nothing in what a task finds."""
    r = random.Random(2)
    docs = [(i, "".join(r.choice(["abcdefgh" * 3, "xyz" * 9, "qrstuv" * 4, letters(i, 20, "klmn")]) for _ in range(6))) for i in range(12)]
    least = 24
    kept = [(i, t) for i, t in docs if len(t) >= least]
    table = [(0, i, 0, t) for i, t in kept]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*table, strict=True)], schema=spans._UNIT_ARROW)
    exact = spans.window_hashes
    for mask in (2**64 - 1, 15, 0):
        monkeypatch.setattr(spans, "window_hashes", lambda codes, sizes, base=0, m=mask: [h & np.uint64(m) for h in exact(codes, sizes)])
        found = {tuple(x.values()) for b in spans._compare(least)(iter([batch])) for x in b.to_pylist()}
        marked = {(d, c) for d, a, b in found for c in range(a, b)}
        assert marked == {(d, c) for d, a, b in brute(docs, least) for c in range(a, b)}


def test_units_are_compared_in_bounded_portions(monkeypatch):
    """However the units of one hash are spread over batches, and however few characters a task takes at once."""
    t = letters(9, 60, "abcdef")
    rows = [(h, d, 0, t if h % 2 else letters(100 * h + d, 60, "ghij")) for h in range(9) for d in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=spans._UNIT_ARROW)
    for bound in (4, 400, 10**6):
        monkeypatch.setattr(spans, "IN_TASK", bound)
        for step in (1, 7, 45):
            pieces = (batch.slice(s, step) for s in range(0, 45, step))
            found = sorted(tuple(x.values()) for b in spans._compare(20)(pieces) for x in b.to_pylist())
            assert found == sorted((d, 0, 60) for h in range(1, 9, 2) for d in range(5))


def test_hot_lines_are_dealt_to_several_tasks(spark):
    line = letters(4, 120, "abcdefg ")
    docs = [(i, f"{line}\nown {i}") for i in range(300)]
    df = spans.duplicate_lines(frame(spark, docs), copies=40)
    assert {tuple(r) for r in df.select("doc_id", "first_doc_id", "first_start").collect()} == {(i, 0, 0) for i in range(1, 300)} and df.count() == 299


def test_texts_without_repeated_lines(spark):
    a, b = letters(6, 130, "abcdefg "), letters(7, 140, "hijkl ")
    docs = [(1, f"{a}\n{b}"), (2, f"x\n{a}\ny\n{b}"), (3, a), (4, f"{b}\n{b}\nz\n"), (5, None), (6, ""), (7, "short")]
    df = frame(spark, docs)
    got = {r.doc_id: (r.text, r.removed) for r in spans.without_lines(df, spans.duplicate_lines(df)).collect()}
    assert got == {1: (f"{a}\n{b}", 0), 2: ("x\ny\n", 2), 3: ("", 1), 4: ("z\n", 2), 5: (None, 0), 6: ("", 0), 7: ("short", 0)}
