import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratafold.llm import clusters, nearest
from stratafold.llm.polytope import CrossPolytope, hadamard, units_of
from stratafold.llm.vectors import Cells, of_sketches, sketches

NODES = "node_id bigint, field_name string, node_vector array<float>, removed boolean, written_at timestamp"
QUERIES = "query_id bigint, field_name string, query_vector array<float>, top_k int, asked_at timestamp"
FIELDS = [("a", 16), ("b", 5)]
NOW = dt.datetime(2031, 3, 1)


def fields(spark):
    return spark.createDataFrame(FIELDS, "field_name string, dimensions int")


def sample(seed=0, groups=12, most=60):
    """Groups of near vectors of uneven sizes and norms, in two fields, with lone ones."""
    r = np.random.default_rng(seed)
    rows, n = [], 0
    for f, d in FIELDS:
        for g in range(groups):
            centre = r.normal(size=d)
            for _ in range(int(r.integers(1, most)) if g else 3 * most):
                n += 1
                v = (centre + 0.25 * np.linalg.norm(centre) / np.sqrt(d) * r.normal(size=d)) * r.uniform(0.2, 4)
                rows.append((n, f, v.astype(np.float32)))
    return rows


DIRT = [
    (9001, "a", None, False), (9002, "a", [], False), (9003, "a", [1.0] * 15, False), (9004, "a", [float("nan")] * 16, False), (9005, "a", [float("inf")] + [0.0] * 15, False),
    (9006, "a", [0.0] * 16, None), (9007, "c", [1.0] * 16, False), (9008, None, [1.0] * 16, False), (9009, "a", [1.0] * 16, True), (None, "a", [1.0] * 16, False), (9010, "b", [None, 1.0, 1.0, 1.0, 1.0], False),
]


def node_frame(spark, rows, dirt=DIRT):
    listed = [(n, f, [float(x) for x in v], False, NOW) for n, f, v in rows]
    return spark.createDataFrame(listed + listed[:3] + [(*x, NOW) for x in dirt], NODES)


def cosine(a, b):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    s = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / s) if s else 0.0


def answer(rows, queries):
    rows = [*rows, (9006, "a", np.zeros(16))]
    out = set()
    for q, f, v, k in queries:
        ranked = sorted(((-round(cosine(v, w), 10), n) for n, g, w in rows if g == f))
        out |= {(q, n) for _, n in ranked[:k]}
    return out


def found(spark, rows, queries):
    nodes, dims = nearest.load_nodes(node_frame(spark, rows), fields(spark))
    asked = spark.createDataFrame([(q, f, None if v is None else [float(x) for x in v], k, NOW) for q, f, v, k in queries], QUERIES)
    return {(r.query_id, r.node_id) for r in nearest.nearest(nodes, nearest.load_queries(asked, dims), dims).collect()}


def test_nearest_against_brute_force(spark):
    rows = sample()
    r = np.random.default_rng(1)
    queries = [(i, f, v + 0.05 * np.float32(r.normal()), int(r.integers(1, 12))) for i, (_, f, v) in enumerate(rows[::9])]
    queries += [(1000, "b", r.normal(size=5).astype(np.float32), 10_000), (1001, "a", r.normal(size=16).astype(np.float32), 40)]
    dirt = [(2000, "a", rows[0][2], 0), (2001, "a", rows[0][2], None), (2002, "a", np.zeros(16), 3), (2003, "a", None, 3), (2004, "a", rows[0][2][:5], 3), (2005, "x", rows[0][2], 3), (2006, "a", rows[0][2], -1)]
    got, want = found(spark, rows, queries + queries[:2] + dirt), answer(rows, queries)
    assert len(got & want) >= 0.999 * len(want) and len(got) == len(want)


def test_copies_tie_by_id(spark):
    v = np.arange(1, 17, dtype=np.float32)
    rows = [(n, "a", v if n % 2 else 2 * v) for n in range(40, 0, -1)]
    assert found(spark, rows, [(1, "a", v, 5)]) == {(1, n) for n in range(1, 6)}


def test_crowded_cells_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 8)
    rows = sample(3, groups=3, most=50)
    queries = [(i, f, v, 7) for i, (_, f, v) in enumerate(rows[::20])]
    assert found(spark, rows, queries) == answer(rows, queries)


def test_nearest_of_nothing(spark):
    assert found(spark, [], []) == set()
    assert found(spark, sample(4, 2, 4), []) == set()


def brute_clusters(rows, threshold=0.87):
    of = set()
    for f, _ in FIELDS:
        part = [(n, v.astype(float) / np.linalg.norm(v)) for n, g, v in rows if g == f]
        ids = [n for n, _ in part]
        near = np.stack([v for _, v in part]) @ np.stack([v for _, v in part]).T >= threshold
        label = np.arange(len(ids))
        while True:
            new = np.array([label[near[i]].min() for i in range(len(ids))])
            if (new == label).all():
                break
            label = new
        groups = {}
        for i, lab in enumerate(label):
            groups.setdefault(lab, []).append(ids[i])
        of |= {(min(g), n) for g in groups.values() if len(g) > 1 for n in g}
    return of


@pytest.mark.parametrize("chunk", [clusters.CHUNK, 24])
def test_clusters_against_brute_force(spark, chunk):
    rows = sample(5)
    nodes, dims = nearest.load_nodes(node_frame(spark, rows), fields(spark))
    got = {(r.cluster_id, r.node_id) for r in clusters.components(nodes, dims, chunk=chunk).collect()}
    want = brute_clusters(rows)
    assert got == want


def sets_of(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("spread", [0.05, 0.3, 0.5, 0.8])
def test_blocks_are_joined_as_all_pairs_do(spread):
    """Sure links and verified doubtful ones give the sets that all similar pairs give, from tight groups to loose clouds."""
    r = np.random.default_rng(int(100 * spread))
    centres = r.normal(size=(9, 24))
    x = units_of(np.repeat(centres, 40, axis=0) + spread * r.normal(size=(360, 24)) * r.uniform(0.2, 1.6, size=(360, 1)))
    ids = r.permutation(10_000)[:360]
    kept, away = of_sketches(pa.chunked_array([pa.array([row.tobytes() for row in sketches(x)], type=pa.binary())]))
    assert np.linalg.norm(kept.astype(np.float64) - x, axis=1).max() <= away < 0.02
    a, b, sure = clusters.join_block(ids, kept, away, 0.87)
    at = {n: i for i, n in enumerate(ids.tolist())}
    exact = x.astype(np.float64) @ x.T.astype(np.float64)
    found = [(p, q) for p, q, s in zip(a.tolist(), b.tolist(), sure.tolist(), strict=True) if s or exact[at[p], at[q]] >= 0.87]
    close = np.argwhere(np.triu(exact >= 0.87, 1))
    assert sets_of(found) == sets_of([(int(ids[i]), int(ids[j])) for i, j in close])


def test_pairs_at_the_threshold(spark):
    """Cosines a millionth above and below the threshold, which sketches cannot tell apart."""
    rows, want = [], set()
    r = np.random.default_rng(4)
    for n in range(60):
        c = 0.87 + (1e-6 if n % 2 else -1e-6)
        x, z = np.linalg.qr(r.normal(size=(16, 2)))[0].T
        rows += [(2 * n + 1, "a", x), (2 * n + 2, "a", c * x + np.sqrt(1 - c * c) * z)]
        want |= {(2 * n + 1, 2 * n + 1), (2 * n + 1, 2 * n + 2)} if n % 2 else set()
    nodes, dims = nearest.load_nodes(node_frame(spark, rows, []), fields(spark))
    assert {(r.cluster_id, r.node_id) for r in clusters.components(nodes, dims).collect()} == want


def lonely_pairs(fineness, count=120_000):
    """Pairs just above the threshold that share no cell of this fineness."""
    r = np.random.default_rng(1)
    x = units_of(r.normal(size=(count, 16))).astype(np.float64)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.8705 * x + np.sqrt(1 - 0.8705**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    tables, tail, probes, loss = fineness
    cells, met = Cells((16,), tables, tail, probes, loss).hashes()[0], np.zeros(count, dtype=bool)
    for table in range(tables):
        (a, lost), (b, more) = (cells.probe(units_of(v), table, probes) for v in (x, y))
        met |= (np.where(lost <= loss, a, -1)[:, :, None] == np.where(more <= loss, b, -2)[:, None, :]).any(axis=(1, 2))
    return [(x[i], y[i]) for i in np.flatnonzero(~met)]


@pytest.mark.parametrize("block", [clusters.BLOCK, 1])
def test_links_do_not_depend_on_cells(spark, monkeypatch, block):
    """Pairs without a common cell are linked, in the coarse cells of small inputs and in the finest ones, which large inputs have."""
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "LEAST_SIDE", 40)
    used = clusters.FINENESS[0 if block > 1 else -1]
    pairs = lonely_pairs(used)
    assert pairs
    rows = [(n, "a", v.astype(np.float32)) for n, v in enumerate((v for pair in pairs for v in pair), 1)] + [(n + 1000, f, v) for n, f, v in sample(9)]
    nodes, dims = nearest.load_nodes(node_frame(spark, rows, []), fields(spark))
    cells = clusters.fitting({r.field_no: r["count"] for r in nodes.groupBy("field_no").count().collect()}, dims)
    assert (cells.tables, cells.tail, cells.probes, cells.loss) == used
    assert {(r.cluster_id, r.node_id) for r in clusters.components(nodes, dims).collect()} == brute_clusters(rows)


@pytest.mark.parametrize("spread", [0.05, 0.3, 0.5, 0.8])
@pytest.mark.parametrize("sides", [1, 2])
def test_balls_are_joined_as_all_pairs_do(spread, sides):
    """Balls of clusters that were not joined to the end are, by sure links and verified doubtful ones."""
    r = np.random.default_rng(int(100 * spread))
    centres = r.normal(size=(9, 24))
    x = units_of(np.repeat(centres, 40, axis=0) + spread * r.normal(size=(360, 24)) * r.uniform(0.2, 1.6, size=(360, 1)))
    ids = r.permutation(10_000)[:360]
    kept, away = of_sketches(pa.chunked_array([pa.array([row.tobytes() for row in sketches(x)], type=pa.binary())]))
    exact = x.astype(np.float64) @ x.T.astype(np.float64)
    # clusters so far: what the links of one row in three give
    some = np.flatnonzero(np.arange(360) % 3 == 0)
    known = [(int(ids[i]), int(ids[j])) for i in some for j in some if i < j and exact[i, j] >= 0.87]
    root = ids.copy()
    for group in sets_of(known):
        root[np.isin(ids, list(group))] = min(group)
    pivot, reach = ids.copy(), np.zeros(360)
    for one in np.unique(root):
        rows = np.flatnonzero(root == one)
        at, far = clusters.balls_of(ids[rows], kept[rows], away, 0.87)
        pivot[rows], reach[rows] = ids[rows[at]], far
    of = {int(n): i for i, n in enumerate(ids)}
    assert all(np.arccos(min(1, exact[i, of[int(p)]])) <= f + 1e-3 for i, (p, f) in enumerate(zip(pivot, reach, strict=True)))
    side = pivot % sides
    found = list(known)
    for parts in [[0]] if sides == 1 else [[0], [1], [0, 1]]:
        rows = np.flatnonzero(np.isin(side, parts))
        a, b, sure = clusters.join_balls(ids[rows], root[rows], pivot[rows], reach[rows], side[rows], kept[rows], away, 0.87)
        found += [(p, q) for p, q, s in zip(a.tolist(), b.tolist(), sure.tolist(), strict=True) if s or exact[of[p], of[q]] >= 0.87]
    close = np.argwhere(np.triu(exact >= 0.87, 1))
    assert sets_of(found) == sets_of([(int(ids[i]), int(ids[j])) for i, j in close])


def test_chain_is_one_cluster(spark):
    """Neighbours are similar, the ends are opposite."""
    turn = np.arccos(0.9)
    rows = [(n + 1, "b", np.array([np.cos(n * turn), np.sin(n * turn), 0, 0, 0])) for n in range(7)]
    nodes, dims = nearest.load_nodes(node_frame(spark, rows, []), fields(spark))
    assert {(r.cluster_id, r.node_id) for r in clusters.components(nodes, dims).collect()} == {(1, n) for n in range(1, 8)}


def test_contraction_of_long_paths_and_loops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 502), (502, 500), (7, 7)], "a bigint, b bigint")
    roots = clusters.contract(links).collect()
    groups = {}
    for r in roots:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(301)), [500, 501, 502]]


def test_clusters_of_nothing_and_of_copies(spark):
    nodes, dims = nearest.load_nodes(node_frame(spark, [], []), fields(spark))
    assert clusters.components(nodes, dims).count() == 0
    assert clusters.describe(nodes, clusters.components(nodes, dims)).count() == 0
    v = np.arange(1, 6, dtype=np.float32)
    nodes, dims = nearest.load_nodes(node_frame(spark, [(n, "b", v * n) for n in range(1, 30)], []), fields(spark))
    assert clusters.components(nodes, dims).count() == 29


@pytest.mark.parametrize("chunk", [clusters.BLOCK, 40])
def test_pivot_clusters(spark, chunk):
    rows = sample(6)
    of = {n: (f, v) for n, f, v in rows}
    nodes, dims = nearest.load_nodes(node_frame(spark, rows), fields(spark))
    got = {r.node_id: r.cluster_id for r in clusters.pivot_clusters(nodes, dims, chunk=chunk).collect()}
    assert set(got) == set(of)
    pivots = set(got.values())
    assert all(got[p] == p for p in pivots)
    assert all(of[n][0] == of[p][0] and cosine(of[n][1], of[p][1]) >= 0.87 - 1e-9 for n, p in got.items())
    near = [(p, q) for p in pivots for q in pivots if p < q and of[p][0] == of[q][0] and cosine(of[p][1], of[q][1]) >= 0.87]
    assert not near
    closest = {n: max((round(cosine(v, of[p][1]), 9), -p) for p in pivots if of[p][0] == f) for n, f, v in rows}
    assert all(-closest[n][1] == p for n, p in got.items())
    assert clusters.pivot_clusters(nodes.limit(0), dims).count() == 0


def test_pivots_do_not_depend_on_blocks(spark):
    """A group of scaled copies over many blocks is one star, and crowded cells give what uncrowded ones do."""
    v = np.random.default_rng(8).normal(size=16)
    rows = [*sample(7), *((5000 + n, "a", (v * (1 + n)).astype(np.float32)) for n in range(200))]
    nodes, dims = nearest.load_nodes(node_frame(spark, rows), fields(spark))
    whole, cut = ({r.node_id: r.cluster_id for r in clusters.pivot_clusters(nodes, dims, chunk=chunk).collect()} for chunk in (clusters.BLOCK, 24))
    nonzero = nodes.where(F.exists("vec", lambda x: x != 0)).select("id", "field_no", F.lit(0).alias("extra"), "vec")
    assert whole == {r.node_id: r.cluster_id for r in clusters.pivot_rounds(nonzero, dims).collect()}
    assert len({cut[5000 + n] for n in range(200)}) == 1
    assert set(cut.values()) == set(whole.values()) and cut == whole


def test_pivots_do_not_depend_on_cells(spark):
    """Components beyond a block, dealt with in rounds, give what one task does, also for similar nodes without a common cell."""
    pairs = lonely_pairs((6, 8, 4, 0.14))
    assert pairs
    rows = [(n, "a", v.astype(np.float32)) for n, v in enumerate((v for pair in pairs for v in pair), 1)] + [(n + 1000, f, v) for n, f, v in sample(9)]
    nodes, dims = nearest.load_nodes(node_frame(spark, rows, []), fields(spark))
    whole = {r.node_id: r.cluster_id for r in clusters.pivot_clusters(nodes, dims).collect()}
    assert all(whole[2 * n + 1] == whole[2 * n + 2] for n in range(len(pairs)))
    assert whole == {r.node_id: r.cluster_id for r in clusters.pivot_rounds(nodes, dims, chunk=100).collect()}


def test_description(spark):
    rows = [(1, "b", np.array([1.0, 0, 0, 0, 0])), (2, "b", np.array([1.0, 0.2, 0, 0, 0])), (3, "b", np.array([2.0, 0.8, 0, 0, 0])), (9, "b", np.array([0, 0, 0, 0, 1.0]))]
    nodes, dims = nearest.load_nodes(node_frame(spark, rows, []), fields(spark))
    got = {r.cluster_id: r for r in clusters.describe(nodes, clusters.components(nodes, dims), 2).collect()}
    assert (got[1].size, got[1].medoid, len(got[1].typical)) == (3, 2, 2)
    assert (got[9].size, got[9].medoid, got[9].mean_cosine) == (1, 9, 1.0)
    mean = np.mean([cosine(rows[1][2], v) for _, _, v in rows[:3]])
    assert got[1].mean_cosine == pytest.approx(mean, abs=1e-6)


def test_extra_columns_with_clashing_names(spark):
    frame = node_frame(spark, [(n, "b", np.arange(1, 6)) for n in (1, 2)], [])
    for name in ("id", "vec", "extra", "field_no", "cell", "chunk", "root", "at", "dimensions"):
        frame = frame.withColumn(name, F.lit("?"))
    nodes, dims = nearest.load_nodes(frame, fields(spark))
    assert clusters.components(nodes, dims).count() == 2


def test_latest_of_repeated_rows_holds(spark):
    late = dt.datetime(2031, 4, 1)
    frame = spark.createDataFrame([(1, "b", [1.0, 0.0, 0.0, 0.0, 0.0], False, NOW), (1, "b", [0.0, 1.0, 0.0, 0.0, 0.0], False, late)], NODES)
    assert nearest.load_nodes(frame, fields(spark))[0].first().vec == [0, 1, 0, 0, 0]


def test_hashing():
    x = np.random.default_rng(0).normal(size=(50, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    units = units_of(x)
    h = CrossPolytope(64, 2, 8)
    cells, losses = h.probe(units, 0, 6)
    assert (cells[:, 0] == h.cell(units, 0)).all() and (np.diff(losses, axis=1) >= 0).all()
    assert all(len(set(row)) == 6 for row in cells.tolist())
    assert (CrossPolytope(64, 2, 8).probe(units, 1, 3)[0] == h.probe(units, 1, 3)[0]).all()


def test_sums_over_batch_borders():
    r = np.random.default_rng(3)
    ids = np.sort(r.integers(0, 12, 200))
    vec = r.normal(size=(200, 4))
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.ones(200, dtype=np.int64)), pa.array(list(vec), type=pa.list_(pa.float64()))], schema=clusters._PART_ARROW)
    for step in (1, 7, 200):
        got = {x["cluster_id"]: x for b in clusters._join_sums(rows.slice(s, step) for s in range(0, 200, step)) for x in b.to_pylist()}
        assert {k: x["members"] for k, x in got.items()} == {k: int((ids == k).sum()) for k in set(ids.tolist())}
        assert all(np.allclose(x["total"], vec[ids == k].sum(axis=0)) for k, x in got.items())
