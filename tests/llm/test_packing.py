import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.llm import packing

KINDS = "container_kind string, capacity_tokens int"


def plain(sizes, capacity):
    """The rule said literally: try every open gap and a new container, count all squares."""
    open_bins, out, n = [], [], 0
    for s in sizes:
        count = np.bincount([g for g in open_bins if 0 < g], minlength=capacity + 1).astype(int) if open_bins else np.zeros(capacity + 1, int)
        best = None
        for gap in [*sorted({g for g in open_bins if g >= s}), None]:
            c = count.copy()
            if gap is not None:
                c[gap] -= 1
            rest = (capacity if gap is None else gap) - s
            if rest:
                c[rest] += 1
            cost = int((c * c).sum())
            if best is None or cost < best[0]:
                best = (cost, gap)
        gap = best[1]
        if gap is None:
            open_bins.append(capacity - s)
            out.append(n)
            n += 1
        else:
            at = max(i for i, g in enumerate(open_bins) if g == gap)
            open_bins[at] -= s
            out.append(at)
    return out, open_bins


@settings(deadline=None, max_examples=150)
@given(st.integers(1, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_rule(case):
    capacity, sizes = case
    got = packing.sum_of_squares(np.array(sizes, dtype=np.int64), capacity)
    _, gaps = plain(sizes, capacity)
    fill = np.bincount(got, weights=sizes).astype(int).tolist() if sizes else []
    assert sorted(capacity - f for f in fill) == sorted(gaps)


def pack(spark, sizes, kinds):
    df = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), spark.createDataFrame(kinds, KINDS))
    return df.collect()


def check(rows, sizes, kinds):
    """Everything is there once, in order, and no container is overfull; a document is cut only if it must be."""
    for kind, capacity in kinds:
        own = [r for r in rows if r.container_kind == kind]
        fill = {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.token_count
        assert max(fill.values(), default=0) <= capacity
        by_doc = {}
        for r in own:
            by_doc.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.token_count))
        assert set(by_doc) == {d for d, _ in sizes}
        for d, n in sizes:
            pieces = sorted(by_doc[d])
            assert sum(c for *_, c in pieces) == (n or 0)
            assert [s for _, s, _ in pieces] == [i * capacity for i in range(len(pieces))]
            assert len(pieces) == max(1, -(-(n or 0) // capacity))


def test_packs_everything(spark, monkeypatch):
    r = np.random.default_rng(1)
    sizes = [(i, int(x)) for i, x in enumerate(r.lognormal(3, 1.2, 3000))] + [(5000, None), (5001, 0), (5002, 100_000)]
    kinds = [("small", 64), ("large", 1000)]
    for shard in (packing.SHARD_ITEMS, 500):
        monkeypatch.setattr(packing, "SHARD_ITEMS", shard)
        rows = pack(spark, sizes, kinds)
        check(rows, sizes, kinds)
        for kind, capacity in kinds:
            used = len({x.container_id for x in rows if x.container_kind == kind})
            assert used <= 1.03 * sum((n or 0) for _, n in sizes) / capacity + 2


def test_same_result_again(spark):
    sizes = [(i, 1 + i * 7 % 50) for i in range(500)]
    assert sorted(map(tuple, pack(spark, sizes, [("k", 64)]))) == sorted(map(tuple, pack(spark, sizes[::-1], [("k", 64)])))


def test_nothing_and_only_empty(spark):
    assert pack(spark, [], [("k", 8)]) == []
    assert pack(spark, [(1, 5)], []) == []
    assert pack(spark, [(1, 5)], [("k", 0), (None, 8), ("n", None)]) == []
    rows = pack(spark, [(1, 0), (2, None)], [("k", 8)])
    check(rows, [(1, 0), (2, None)], [("k", 8)])


def test_documents_without_an_id(spark):
    big = 2**62 + 1
    rows = pack(spark, [(None, 3), (None, 4), (big, 5), (0, 6)], [("k", 100)])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.token_count) for r in rows) == [(False, 0, 6), (False, big, 5), (True, 0, 3), (True, 0, 4)]


def test_repeated_rows_are_packed_each(spark):
    rows = pack(spark, [(1, 6), (1, 6), (1, 6)], [("k", 10)])
    assert len(rows) == 3 and len({r.container_id for r in rows}) == 3
