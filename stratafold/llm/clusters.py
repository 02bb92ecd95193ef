"""Grouping vectors into clusters of mutually similar ones.

Similar vectors meet in the cells of a cross-polytope hashing, as sketches of a byte for each coordinate with a known
error. Inside a block of a cell hash-ordered pivots absorb what is similar to them, groups are joined by what is similar
across them, and every block leaves a star of links for each of its groups. The links of all blocks are contracted
in rounds: in each, every vertex is absorbed by the neighbour first in hash order, until no link is left. Cells with too
many rows for one block are compared a second time, first by one row of each cluster so far, then across their blocks
where the clusters still differ, so a group that holds a third of all rows costs no pairs within it.

Cells only save work: how fine they are follows the number of rows, and a similar pair may share none. So every cluster so far
is covered by balls around pivots, and all balls of a field are compared, members only where the angle between two pivots
leaves room for a link between different clusters. No link is left out, whatever the cells. Pairs that sketches leave open
are decided by the exact vectors. Clusters are described by the members of the greatest mean cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.llm.polytope import units_of, width_of
from stratafold.llm.vectors import CHUNK, Cells, chunk_of, chunked, cosines, grouped, matrix, of_sketches, partitions_for, runs, sketch_column, table_matrix

THRESHOLD = 0.87
#: Rows that are compared in one task.
BLOCK = 16_384
#: Rows of one side where all balls are compared, and the fewest rows of a side and most sides for which smaller ones are cut.
SIDE, LEAST_SIDE, SIDES = 262_144, 4096, 4
#: Tables, tail, probes and greatest loss of height, from coarse cells to fine ones. A pair at the threshold misses in all tables
#: with a probability below 0.0002, simulated for 32, 64 and 128 dimensions.
FINENESS = ((2, 0, 6, 0.15), (3, 4, 8, 0.15), (4, 16, 8, 0.15), (5, 64, 8, 0.15))
_LINK = "a bigint, b bigint, sure boolean"
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])
_SLACK = np.float32(4e-6)


def _hash_order(ids: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random rank value of each id."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of ``a`` has at least the cosine ``threshold`` with each of ``b``; close calls in double precision."""
    near = units_of(a) @ units_of(b).T
    yes = near >= threshold
    rows, cols = np.nonzero(np.abs(near - np.float32(threshold)) <= _SLACK)
    if len(rows):
        yes[rows, cols] = cosines(a[rows], b[cols]) >= threshold
    return yes


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def join_block(ids: np.ndarray, x: np.ndarray, away: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, sure) that join the rows of a block as all their similar pairs do.

    ``x`` are approximations at most ``away`` from the unit vectors. In hash order pivots absorb all free rows that are surely
    similar to them. Of two groups, members are compared only where the angle between the pivots leaves room for a similar
    pair, given how far the members lie from their pivots, and only while the groups are not yet joined. Pairs too
    close to the threshold to tell are returned as not sure, unless their rows are joined anyway.
    """
    order = np.lexsort((ids, _hash_order(ids)))
    ids, x = ids[order], x[order]
    slack = np.float32(2 * away + away * away + 4e-6)
    high, low = np.float32(threshold) + slack, np.float32(threshold) - slack
    pivot, free, pivots = np.arange(len(ids)), np.arange(len(ids)), []
    while len(free):
        lead = free[:64]
        near = x[lead] @ x[free].T >= high
        taken = np.zeros(len(free), dtype=bool)
        for i, p in enumerate(lead):
            if not taken[i]:
                mine = near[i] & ~taken
                mine[i] = True
                pivot[free[mine]] = p
                taken |= mine
                pivots.append(p)
        free = free[~taken]
    pivots = np.array(pivots)
    of = np.searchsorted(pivots, pivot)
    size = np.bincount(of, minlength=len(pivots))
    reach = np.zeros(len(pivots))
    np.maximum.at(reach, of, _angle((x * x[pivot]).sum(axis=1) - slack))
    reach[size == 1] = 0
    by_group = np.argsort(of, kind="stable")
    first = np.concatenate(([0], np.cumsum(size)))
    root = np.arange(len(pivots))
    a, b, near_a, near_b = [], [], [], []
    widest = float(np.arccos(max(-1.0, threshold - slack)))
    for s in range(0, len(pivots), 256):
        apart = x[pivots[s : s + 256]] @ x[pivots[s:]].T
        room = _angle(apart + slack) <= reach[s : s + 256, None] + reach[None, s:] + widest
        room &= np.arange(len(pivots) - s)[None, :] > np.arange(len(room))[:, None]
        for i in np.flatnonzero(room.any(axis=1)):
            g = s + i
            rows = by_group[first[g] : first[g + 1]]
            others = room[i] & (root[s:] != root[g])
            cols = by_group[first[s] :][np.repeat(others, size[s:])]
            for c in range(0, len(cols), BLOCK):
                part = cols[c : c + BLOCK]
                part = part[root[of[part]] != root[g]]
                for r in range(0, len(rows) if len(part) else 0, 512):
                    cosine = x[rows[r : r + 512]] @ x[part].T
                    for h in np.unique(of[part[(cosine >= high).any(axis=0)]]):
                        if root[h] != root[g]:
                            root[root == root[h]] = root[g]
                            a.append(ids[pivots[h]])
                            b.append(ids[pivots[g]])
                    at, to = np.nonzero((cosine >= low) & (root[of[part]] != root[g])[None, :])
                    near_a.append(rows[r + at])
                    near_b.append(part[to])
    own = np.flatnonzero(pivot != np.arange(len(ids)))
    if near_a:
        p, q = np.concatenate(near_a), np.concatenate(near_b)
        open_ = root[of[p]] != root[of[q]]
        p, q = p[open_], q[open_]
    else:
        p = q = np.empty(0, dtype=np.int64)
    sure = np.repeat([True, False], [len(own) + len(a), len(p)])
    return np.concatenate((ids[own], np.array(a, dtype=np.int64), ids[p])), np.concatenate((ids[pivot[own]], np.array(b, dtype=np.int64), ids[q])), sure


def _block_links(threshold: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cell", "chunk"]):
            if group.num_rows < 2:
                continue
            x, away = of_sketches(group.column("sketch"))
            a, b, sure = join_block(group.column("id").to_numpy(), x, away, threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], schema=_LINK_ARROW)

    return link


def _cross_links(threshold: float):
    """Links between the clusters so far of two blocks; a pair of clusters is surely linked once."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cell", "x", "y"]):
            left, root, ids = group.column("is_left").to_numpy(), group.column("root").to_numpy(), group.column("id").to_numpy()
            if left.all() or not left.any():
                continue
            x, away = of_sketches(group.column("sketch"))
            slack = np.float32(2 * away + away * away + 4e-6)
            one, other = np.flatnonzero(left), np.flatnonzero(~left)
            for s in range(0, len(one), CHUNK):
                part = one[s : s + CHUNK]
                differ = root[part][:, None] != root[other][None, :]
                near = x[part] @ x[other].T
                rows, cols = np.nonzero((near >= np.float32(threshold) + slack) & differ)
                if len(rows):
                    pairs = np.unique(np.stack((root[part][rows], root[other][cols])), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.ones(pairs.shape[1], dtype=bool))], schema=_LINK_ARROW)
                rows, cols = np.nonzero((np.abs(near - np.float32(threshold)) < slack) & differ)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][rows]), pa.array(ids[other][cols]), pa.array(np.zeros(len(rows), dtype=bool))], schema=_LINK_ARROW)

    return link


def contract(links: DataFrame, scratch: storage.Scratch | None = None) -> DataFrame:
    """(node, root) of every node that has a link: one root for each set of nodes joined by links.

    Rounds of absorption over a graph that shrinks: each vertex goes to the first of itself and its neighbours in
    hash order, links are carried over to what absorbed their ends, and loops fall away. Every round's tables are written.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    own = scratch or storage.Scratch(links.sparkSession, "clusters-roots")
    edges = own.keep(links.where("a <> b").select("a", "b").distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = own.keep(first.select(F.col("a").alias("node"), F.least(order("a"), F.col("m")).getField("v").alias("root")), "step")
        steps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = own.keep(moved.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if not steps:
        return links.sparkSession.createDataFrame([], "node bigint, root bigint")
    composed = steps[-1]
    for step in reversed(steps[:-1]):
        later = composed.select(F.col("node").alias("root"), F.col("root").alias("last"))
        composed = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return own.keep(composed, "roots") if scratch else own.result(composed)


def _rooted(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``rows`` with the root of ``column`` in its place; what has none is its own."""
    known = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(known, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def _extended(roots: DataFrame, links: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """``roots`` after further links between nodes or roots."""
    later = contract(_rooted(_rooted(links.where("sure").select("a", "b"), roots, "a"), roots, "b"), scratch)
    merged = _rooted(roots.select("node", "root"), later, "root").select("node", "root")
    known = later.join(roots.select("node"), "node", "left_anti")
    return scratch.keep(merged.unionByName(known), "roots")


def _hot_links(rows: DataFrame, roots: DataFrame, threshold: float, chunk: int, scratch: storage.Scratch) -> DataFrame:
    """Links across the blocks of crowded cells, where the clusters so far differ.

    A cluster that fills blocks gets blocks of its own, the others of a cell share blocks; pairs of blocks of one
    cluster are not formed.
    """
    rooted = rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    of_root = rooted.groupBy("cell", "root").agg(F.count("*").alias("n"))
    big = scratch.keep(of_root.where(F.col("n") > chunk // 2).select("cell", "root", F.ceil(F.col("n") / chunk).cast("int").alias("own")), "big")
    rest = of_root.where(F.col("n") <= chunk // 2).groupBy("cell").agg(F.sum("n").alias("n")).select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("shared"))
    placed = rooted.join(big, ["cell", "root"], "left").join(rest, "cell", "left")
    nth = F.when(F.col("own").isNotNull(), chunk_of(F.col("id"), F.col("own"))).otherwise(chunk_of(F.col("root"), F.col("shared")))
    # a block is named by its cluster (null: shared) and number; the name is hashed into one column
    named = placed.withColumn("owner", F.when(F.col("own").isNotNull(), F.col("root"))).withColumn("block", F.xxhash64(F.coalesce("owner", F.lit(-1)), F.col("own").isNotNull(), nth))
    named = scratch.keep(named.select("cell", "owner", "block", "id", "root", "sketch"), "named")
    blocks = scratch.keep(named.select("cell", "owner", "block").distinct(), "blocks")
    x, y = blocks.select("cell", F.col("owner").alias("ox"), F.col("block").alias("x")), blocks.select("cell", F.col("owner").alias("oy"), F.col("block").alias("y"))
    pairs = x.join(y, "cell").where((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & F.col("ox").isNull())).where(F.col("ox").isNull() | F.col("oy").isNull() | (F.col("ox") != F.col("oy")))
    pairs = scratch.keep(pairs.select("cell", "x", "y"), "pairs")
    pick = lambda side: named.withColumnRenamed("block", side).join(pairs, ["cell", side]).select("cell", "x", "y", "id", "root", "sketch", F.lit(side == "x").alias("is_left"))
    both = pick("x").unionByName(pick("y"))
    copies = 2 * pairs.count() / max(1, blocks.count())
    return grouped(both, ["cell", "x", "y"], partitions_for((named, copies))).mapInArrow(_cross_links(threshold), _LINK)


def _firsts_of_clusters(rows: DataFrame, roots: DataFrame, chunk: int) -> DataFrame:
    """One row of each cluster so far in each crowded cell, in blocks of bounded size."""
    rooted = rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = rooted.groupBy("cell", "root").agg(F.min_by(F.struct("id", "sketch"), "id").alias("r")).select("cell", "r.id", "r.sketch")
    many = chunked(first.groupBy("cell").agg(F.count("*").alias("n")), chunk)
    return first.join(many, "cell", "left").select("cell", F.coalesce(chunk_of(F.col("id"), F.col("chunks")), F.lit(0)).alias("chunk"), "id", "sketch")


_ROW = "field_no int, id bigint, sketch binary"
_ROW_ARROW = pa.schema([("field_no", pa.int32()), ("id", pa.int64()), ("sketch", pa.binary())])
_BALL = "field_no int, id bigint, root bigint, pivot bigint, reach double, sketch binary"
_BALL_ARROW = pa.schema([("field_no", pa.int32()), ("id", pa.int64()), ("root", pa.int64()), ("pivot", pa.int64()), ("reach", pa.float64()), ("sketch", pa.binary())])


def _sketched_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field_no, id, sketch) of the rows that are not all zero."""
    for batch in batches:
        numbers = batch.column("field_no").to_numpy(zero_copy_only=False)
        for no in np.unique(numbers):
            part = batch.take(pa.array(np.flatnonzero(numbers == no)))
            units = units_of(matrix(part.column("vec")))
            some = np.flatnonzero(units.any(axis=1))
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([part.column("field_no").take(take).cast(pa.int32()), part.column("id").take(take), sketch_column(units[some])], schema=_ROW_ARROW)


def _balls(threshold: float):
    """Covers each cluster so far (a block of it, if it is large) by balls: every row with its ball's pivot and how far that ball reaches."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["root", "chunk"]):
            ids = group.column("id").to_numpy()
            x, away = of_sketches(group.column("sketch"))
            pivot, reach = balls_of(ids, x, away, threshold)
            out = pa.table([group.column("field_no"), group.column("id"), group.column("root"), pa.array(ids[pivot]), pa.array(reach), group.column("sketch")], schema=_BALL_ARROW)
            yield from out.combine_chunks().to_batches()

    return cover


def balls_of(ids: np.ndarray, x: np.ndarray, away: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the row of its ball's pivot and the greatest angle between that pivot and a row of the ball, or more.

    ``x`` are approximations at most ``away`` from the unit vectors. Balls stay within 45 degrees, so for thresholds from 0 on no
    sum of two reaches and the angle of a link exceeds 180.
    """
    slack = np.float32(2 * away + away * away + 4e-6)
    high = np.float32(max(threshold, 0.75))
    pivot, free = np.arange(len(ids)), np.lexsort((ids, _hash_order(ids)))
    while len(free):
        lead = free[:64]
        near = x[lead] @ x[free].T >= high
        taken = np.zeros(len(free), dtype=bool)
        for i, p in enumerate(lead):
            if not taken[i]:
                mine = near[i] & ~taken
                mine[i] = True
                pivot[free[mine]] = p
                taken |= mine
        free = free[~taken]
    others = pivot != np.arange(len(ids))
    reach = np.zeros(len(ids))
    np.maximum.at(reach, pivot[others], _angle((x[others].astype(np.float64) * x[pivot[others]]).sum(axis=1) - slack))
    return pivot, reach[pivot]


def join_balls(ids: np.ndarray, root: np.ndarray, pivot: np.ndarray, reach: np.ndarray, side: np.ndarray, x: np.ndarray, away: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, sure) between the rows of balls of different clusters: of every two balls, if ``side`` is the same for all rows, else
    of every two of different sides. ``root`` names a row's cluster so far, ``reach`` bounds the angles between its ball's pivot and rows.

    A ball's rows are compared with another ball only if the angle between the pivots leaves room for a link, then, one by one,
    if the angle between the row and the other pivot does. Two clusters are surely linked once; pairs too close to the threshold to
    tell are returned as not sure.
    """
    order = np.lexsort((ids != pivot, pivot, side))
    ids, root, pivot, reach, side, x = ids[order], root[order], pivot[order], reach[order], side[order], x[order]
    slack = np.float32(2 * away + away * away + 1.6e-5)
    high, low = np.float32(threshold) + slack, np.float32(threshold) - slack
    widest = float(np.arccos(max(-1.0, threshold - float(slack))))
    # a ball's first row is its pivot
    at = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
    ends = np.append(at[1:], len(ids))
    own, heart, far = root[at], x[at], reach[at]
    one_side = side[0] == side[-1]
    left = np.arange(len(at)) if one_side else np.flatnonzero(side[at] == side[0])
    right = left if one_side else np.arange(len(left), len(at))
    limit = np.cos(far + widest).astype(np.float32)
    # x . y - cos(alpha + beta) as one product
    narrow = np.column_stack((heart[left], -np.cos(far[left]), np.sin(far[left]))).astype(np.float32)
    wide = np.ascontiguousarray(np.column_stack((heart[right], np.cos(far[right] + widest), np.sin(far[right] + widest))).astype(np.float32).T)
    a, b, near_a, near_b = [], [], [], []
    for s in range(0, len(left), 256):
        begin = s if one_side else 0
        g, h = np.nonzero(narrow[s : s + 256] @ wide[:, begin:] >= -slack)
        g, h = left[s + g], right[begin + h]
        kept = own[g] != own[h]
        if one_side:
            kept &= h > g
        g, h = g[kept], h[kept]
        for these in np.split(np.arange(len(g)), np.flatnonzero(g[1:] != g[:-1]) + 1) if len(g) else ():
            p, others = g[these[0]], h[these]
            others = others[own[others] != own[p]]
            rows = slice(at[p], ends[p])
            if len(others) and ends[p] - at[p] > 1:
                others = others[(x[rows] @ heart[others].T).max(axis=0) + slack >= limit[others]]
            sizes = ends[others] - at[others]
            # balls are taken together up to a block of rows
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1
            for some in np.split(others, cut) if len(others) else ():
                some = some[own[some] != own[p]]
                if not len(some):
                    continue
                n = ends[some] - at[some]
                cols = np.repeat(at[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                of = np.repeat(some, n)
                for r in range(at[p], ends[p], 512):
                    cosine = x[r : min(r + 512, ends[p])] @ x[cols].T
                    best = cosine.max(axis=0)
                    for q in np.unique(of[best >= high]):
                        if own[q] != own[p]:
                            a.append(own[p])
                            b.append(own[q])
                            own[own == own[q]] = own[p]
                    open_ = np.flatnonzero((best >= low) & (own[of] != own[p]))
                    if len(open_):
                        i, j = np.nonzero(cosine[:, open_] >= low)
                        near_a.append(ids[r + i])
                        near_b.append(ids[cols[open_[j]]])
    near_a = np.concatenate(near_a) if near_a else np.empty(0, dtype=np.int64)
    near_b = np.concatenate(near_b) if near_b else np.empty(0, dtype=np.int64)
    sure = np.repeat([True, False], [len(a), len(near_a)])
    return np.concatenate((np.array(a, dtype=np.int64), near_a)), np.concatenate((np.array(b, dtype=np.int64), near_b)), sure


def _ball_links(threshold: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["field_no", "x", "y"]):
            numbers = [group.column(c).to_numpy() for c in ("id", "root", "pivot", "reach", "side")]
            if group.column("x")[0].as_py() != group.column("y")[0].as_py() and numbers[-1].min() == numbers[-1].max():
                continue
            a, b, sure = join_balls(*numbers, *of_sketches(group.column("sketch")), threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], schema=_LINK_ARROW)

    return link


def _links_of_all(nodes: DataFrame, roots: DataFrame, counts: dict[int, int], threshold: float, chunk: int, scratch: storage.Scratch) -> DataFrame:
    """Every link between different clusters so far that joins clusters, from all pairs of balls of a field; see ``join_balls``."""
    rows = nodes.mapInArrow(_sketched_rows, _ROW)
    rooted = rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    rooted = scratch.keep(rooted.select("field_no", "id", "root", "sketch"), "rooted")
    linked = rooted.where("root IS NOT NULL")
    large = scratch.keep(chunked(linked.groupBy(F.col("root").alias("cell")).agg(F.count("*").alias("n")), chunk).withColumnRenamed("cell", "root"), "large")
    cut = linked.join(large, "root", "left").withColumn("chunk", F.coalesce(chunk_of(F.col("id"), F.col("chunks")), F.lit(0))).drop("chunks")
    balls = grouped(cut, ["root", "chunk"], partitions_for((rooted, 1))).mapInArrow(_balls(threshold), _BALL)
    lone = rooted.where("root IS NULL").select("field_no", "id", F.col("id").alias("root"), F.col("id").alias("pivot"), F.lit(0.0).alias("reach"), "sketch")
    sides = {no: max(-(-n // SIDE), min(SIDES, -(-n // LEAST_SIDE)), 1) for no, n in counts.items()}
    number = F.lit(1)
    for no, n in sides.items():
        number = F.when(F.col("field_no") == no, F.lit(n)).otherwise(number)
    # whole balls are dealt to sides; each side meets each other one and itself
    dealt = balls.unionByName(lone).withColumn("sides", number).withColumn("side", F.pmod(F.xxhash64("pivot", F.lit(11)), F.col("sides")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    met = met.select("field_no", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "id", "root", "pivot", "reach", "side", "sketch")
    n = partitions_for((rooted, max(sides.values(), default=1)))
    return scratch.keep(grouped(met, ["field_no", "x", "y"], n).mapInArrow(_ball_links(threshold), _LINK), "rest")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact cosine reaches the threshold."""
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("vec").alias(f"v{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("va").offsets.to_numpy())
            for n in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == n)))
                good = cosines(matrix(part.column("va")), matrix(part.column("vb"))) >= threshold
                part = part.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(np.ones(part.num_rows, dtype=bool))], schema=_LINK_ARROW)

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "va", "vb").mapInArrow(check, _LINK)


def fitting(counts: dict[int, int], dims: dict[str, int]) -> Cells:
    """Cells fine enough that they hold half a block of rows on average: the more rows of a field, the finer, with as many more
    tables and probes as keep all but few links from being missed."""
    sizes = tuple(dims.values())
    for tables, tail, probes, loss in FINENESS:
        full = [n * probes / (2 * width_of(sizes[no]) * max(1, 2 * tail)) for no, n in counts.items()]
        if max(full, default=0) <= BLOCK // 2:
            break
    return Cells(sizes, tables, tail, probes, loss)


def components(nodes: DataFrame, dims: dict[str, int], threshold: float = THRESHOLD, chunk: int = BLOCK) -> DataFrame:
    """(cluster_id, node_id) of every node that is linked to another; ``cluster_id`` is the cluster's smallest node id.

    ``nodes`` as ``vectors.usable`` gives them. All-zero vectors have cosine 0 with everything and so no links. What is
    shuffled are sketches of a byte for each coordinate; pairs that these leave open are decided by the exact vectors.
    Cells join most of what is linked; all pairs of balls of clusters are compared for the rest, so no link depends on the cells.
    """
    scratch = storage.Scratch(nodes.sparkSession, "clusters")
    counts = {r.field_no: r.n for r in nodes.groupBy("field_no").agg(F.count("*").alias("n")).collect()}
    cells = fitting(counts, dims)
    hot = scratch.keep(chunked(cells.sizes(nodes), chunk), "crowded")
    some_hot = not hot.isEmpty()
    rows = cells.sketched(nodes)
    blocks = rows.join(hot, "cell", "left").withColumn("chunk", F.coalesce(chunk_of(F.col("id"), F.col("chunks")), F.lit(0))).drop("chunks") if some_hot else rows.withColumn("chunk", F.lit(0))
    n = partitions_for((nodes, cells.tables * cells.probes * 0.25))
    links = scratch.keep(grouped(blocks, ["cell", "chunk"], n).mapInArrow(_block_links(threshold), _LINK), "found")
    roots = contract(links.where("sure"), scratch)
    if some_hot:
        crowd = scratch.keep(rows.join(hot.select("cell"), "cell", "left_semi"), "crowd")
        firsts = scratch.keep(grouped(_firsts_of_clusters(crowd, roots, chunk), ["cell", "chunk"], n).mapInArrow(_block_links(threshold), _LINK), "firsts")
        roots = _extended(roots, firsts, scratch)
        across = scratch.keep(_hot_links(crowd, roots, threshold, chunk, scratch), "across")
        roots = _extended(roots, across, scratch)
    # pairs that sketches leave open are among these again, as long as their clusters differ
    rest = _links_of_all(nodes, roots, counts, threshold, chunk, scratch)
    if not rest.where("sure").isEmpty():
        roots = _extended(roots, rest, scratch)
    doubtful = _rooted(_rooted(rest.where("NOT sure").select("a", "b").distinct().withColumns({"ra": F.col("a"), "rb": F.col("b")}), roots, "ra"), roots, "rb")
    doubtful = scratch.keep(doubtful.where("ra <> rb").select("a", "b"), "doubtful")
    if not doubtful.isEmpty():
        roots = _extended(roots, scratch.keep(_verified(doubtful, nodes, threshold), "verified"), scratch)
    least = roots.groupBy("root").agg(F.min("node").alias("cluster_id"))
    return scratch.result(roots.join(least, "root").select("cluster_id", F.col("node").alias("node_id")))


_RANKED = "field_no int, id bigint, rank bigint, vec array<float>"
_BEST = "id bigint, cosine double, pivot bigint"
_BEST_ARROW = pa.schema([("id", pa.int64()), ("cosine", pa.float64()), ("pivot", pa.int64())])
_ID_ARROW = pa.schema([("id", pa.int64())])


def _rank(ids: np.ndarray) -> np.ndarray:
    return (_hash_order(ids) >> np.uint64(2)).astype(np.int64)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank = pa.array(_rank(batch.column("id").to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column("field_no"), batch.column("id"), rank, batch.column("vec")], names=["field_no", "id", "rank", "vec"])


def _firsts(ids: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """The rows that in hash order are similar to none of those before them, ordered by id."""
    free, pivots = np.lexsort((ids, _rank(ids))), []
    while len(free):
        near = similar(x[free[:64]], x[free], threshold)
        taken = np.zeros(len(free), dtype=bool)
        for i, p in enumerate(free[:64]):
            if not taken[i]:
                taken |= near[i]
                taken[i] = True
                pivots.append(p)
        free = free[~taken]
    pivots = np.array(pivots)
    return pivots[np.argsort(ids[pivots])]


def _closest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the most similar one of ``pivots`` (ties: the first) and their cosine; close calls in double precision."""
    near = units_of(x) @ units_of(pivots).T
    rows, cols = np.nonzero(near >= near.max(axis=1, keepdims=True) - _SLACK)
    cosine = cosines(x[rows], pivots[cols])
    order = np.lexsort((cols, -cosine, rows))
    first = order[np.searchsorted(rows[order], np.arange(len(x)))]
    return cols[first], cosine[first]


def _pivots_among(threshold: float):
    """The rows of each field that in hash order are similar to none before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["field_no"]):
            yield from group.take(pa.array(_firsts(group.column("id").to_numpy(), table_matrix(group), threshold))).combine_chunks().to_batches()

    return run


def _blocks_and_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """(ids, vectors) of every block's own rows with, part by part, the rows sent to it; its own rows come first."""
    key, rows, own = None, [], None
    for batch in batches:
        for part in runs([batch], ["field_no", "chunk", "sent"]):
            at = (part.column("field_no")[0].as_py(), part.column("chunk")[0].as_py())
            if not part.column("sent")[0].as_py():
                key, rows, own = at, [*rows, part] if at == key else [part], None
            elif at == key:
                if own is None:
                    block = pa.concat_tables(rows)
                    own = block.column("id").to_numpy(), table_matrix(block)
                for s in range(0, part.num_rows, CHUNK):
                    yield *own, part.slice(s, CHUNK)


def _taken(threshold: float):
    """The ids of a block's rows that are similar to one of those sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vec, sent in _blocks_and_sent(batches):
            x = table_matrix(sent)
            for s in range(0, len(ids), CHUNK):
                mine = ids[s : s + CHUNK][similar(vec[s : s + CHUNK], x, threshold).any(axis=1)]
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(mine)], schema=_ID_ARROW)

    return run


def _best_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a block the most similar of the pivots sent to it, part by part."""
    for ids, vec, sent in _blocks_and_sent(batches):
        pivots = sent.column("id").to_numpy()
        order = np.argsort(pivots)
        pivots, x = pivots[order], table_matrix(sent)[order]
        for s in range(0, len(ids), CHUNK):
            best, cosine = _closest(vec[s : s + CHUNK], x)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + CHUNK]), pa.array(cosine), pa.array(pivots[best])], schema=_BEST_ARROW)


def _with_sent(own: DataFrame, sent: DataFrame) -> DataFrame:
    """The rows of ``own`` in blocks and those of ``sent`` in all blocks of their fields, for ``_blocks_and_sent``."""
    blocks = max(-(-own.count() // BLOCK), int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = own.select("field_no", "id", "vec").withColumn("chunk", chunk_of(F.col("id"), F.lit(blocks))).withColumn("sent", F.lit(False))
    asked = sent.select("field_no", "id", "vec").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("sent", F.lit(True))
    n = partitions_for((own, 1), (sent, blocks))
    return rows.unionByName(asked).repartition(n, "field_no", "chunk").sortWithinPartitions("field_no", "chunk", "sent")


_STAR = "cluster_id bigint, node_id bigint"
_STAR_ARROW = pa.schema([("cluster_id", pa.int64()), ("node_id", pa.int64())])


def pivots_of(ids: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """The pivot of each row: in hash order every free row becomes one and absorbs the free rows similar to it; then each row goes
    to the most similar pivot (ties: the smaller id)."""
    pivots, out = _firsts(ids, x, threshold), np.empty(len(ids), dtype=np.int64)
    for s in range(0, len(ids), 512):
        out[s : s + 512] = ids[pivots[_closest(x[s : s + 512], x[pivots])[0]]]
    out[pivots] = ids[pivots]
    return out


def _stars(threshold: float):
    """The stars of complete components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cluster_id"]):
            ids = group.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(pivots_of(ids, table_matrix(group), threshold)), pa.array(ids)], schema=_STAR_ARROW)

    return run


def pivot_clusters(nodes: DataFrame, dims: dict[str, int], threshold: float = THRESHOLD, chunk: int = BLOCK) -> DataFrame:
    """(cluster_id, node_id) of every node that is not all zero: the star of similar nodes around a pivot, named by it.

    Pivots are the nodes that are the first in hash order among those similar to them that no earlier pivot absorbed; every node belongs to the
    most similar pivot, and is similar to it. Since similar nodes always lie in one component, each component of up to
    ``chunk`` nodes is dealt with by one task, larger ones in rounds by ``pivot_rounds``, which gives the same.
    """
    scratch = storage.Scratch(nodes.sparkSession, "clusters-stars")
    nodes = nodes.where(F.exists("vec", lambda x: x != 0)).select("id", "field_no", F.lit(0).alias("extra"), "vec")
    members = components(nodes, dims, threshold, chunk)
    of = members.select("cluster_id", F.col("node_id").alias("id"))
    large = scratch.keep(members.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("cluster_id"), "large")
    some_large = not large.isEmpty()
    small = of.join(large, "cluster_id", "left_anti") if some_large else of
    joined = nodes.select("id", "vec").join(small, "id").select("cluster_id", "id", "vec")
    stars = grouped(joined, ["cluster_id"], partitions_for((nodes, 1))).mapInArrow(_stars(threshold), _STAR)
    lone = nodes.select("id").join(of, "id", "left_anti").select(F.col("id").alias("cluster_id"), F.col("id").alias("node_id"))
    found = stars.unionByName(lone)
    rounds = None
    if some_large:
        crowd = scratch.keep(nodes.join(of.join(large, "cluster_id", "left_semi").select("id"), "id", "left_semi").select(*nodes.columns), "crowd")
        rounds = pivot_rounds(crowd, dims, threshold, chunk)
        found = found.unionByName(rounds)
    out = scratch.result(found)
    storage.drop(members, *([rounds] if rounds is not None else []))
    return out


def pivot_rounds(nodes: DataFrame, dims: dict[str, int], threshold: float = THRESHOLD, chunk: int = BLOCK) -> DataFrame:
    """What ``pivot_clusters`` gives, for components of any size.

    In each round the first ``chunk`` free nodes in hash order are taken. Since no earlier pivot is similar to a free node, their
    pivots are those that one task finds among them alone; the free nodes similar to these are absorbed. At last every node is
    compared with all pivots of its field. Nothing depends on the rounds or blocks.
    """
    scratch = storage.Scratch(nodes.sparkSession, "clusters-pivots")
    nodes = nodes.where(F.exists("vec", lambda x: x != 0)).select("id", "field_no", "vec")
    every = scratch.keep(nodes.mapInArrow(_ranked, _RANKED), "ranked")
    free, rounds = every, []
    while not free.isEmpty():
        lead = scratch.keep(free.orderBy("rank", "id").limit(chunk), "lead")
        last = lead.agg(F.max(F.struct("rank", "id")).alias("m")).first().m
        new = scratch.keep(grouped(lead, ["field_no"], max(1, len(dims))).mapInArrow(_pivots_among(threshold), _RANKED), "pivots")
        rounds.append(new)
        later = free.where((F.col("rank") > last.rank) | ((F.col("rank") == last.rank) & (F.col("id") > last.id)))
        taken = scratch.keep(_with_sent(later, new).mapInArrow(_taken(threshold), "id bigint").distinct(), "taken")
        free = scratch.keep(later.join(taken, "id", "left_anti").select(*every.columns), "free")
    if not rounds:
        return scratch.result(nodes.sparkSession.createDataFrame([], _STAR))
    pivots = rounds[0]
    for some in rounds[1:]:
        pivots = pivots.unionByName(some)
    pivots = scratch.keep(pivots, "all-pivots")
    others = scratch.keep(every.join(pivots.select("id"), "id", "left_anti").select(*every.columns), "others")
    best = _with_sent(others, pivots).mapInArrow(_best_pivots, _BEST).groupBy("id").agg(F.max(F.struct("cosine", (-F.col("pivot")).alias("p"))).alias("b"))
    own = pivots.select(F.col("id").alias("cluster_id"), F.col("id").alias("node_id"))
    return scratch.result(own.unionByName(best.select((-F.col("b.p")).alias("cluster_id"), F.col("id").alias("node_id"))))


_PART = "cluster_id bigint, members bigint, total array<double>"
_PART_ARROW = pa.schema([("cluster_id", pa.int64()), ("members", pa.int64()), ("total", pa.list_(pa.float64()))])


def _totals(ids: np.ndarray, members: np.ndarray, lists: pa.Array) -> Iterator[pa.RecordBatch]:
    """Members and vectors added up for each id, separately for each length of vectors."""
    lengths = np.diff(lists.offsets.to_numpy())
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        own = ids[rows]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        total = np.add.reduceat(matrix(lists.take(pa.array(rows))).astype(np.float64), starts, axis=0)
        offsets = pa.array(np.arange(len(starts) + 1) * n, type=pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(own[starts]), pa.array(np.add.reduceat(members[rows], starts)), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], schema=_PART_ARROW)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the count and the sum of unit vectors of each cluster in it."""
    for batch in batches:
        lists = batch.column("vec")
        lengths = np.diff(lists.offsets.to_numpy())
        for n in np.unique(lengths):
            rows = pa.array(np.flatnonzero(lengths == n))
            units = units_of(matrix(lists.take(rows))).astype(np.float64)
            unit_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * n, type=pa.int32()), pa.array(units.ravel()))
            ids = batch.column("cluster_id").take(rows).to_numpy()
            yield from _totals(ids, np.ones(len(ids), dtype=np.int64), unit_lists)


def _join_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial sums of each cluster; rows come ordered by cluster, whose last one may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        together = pa.Table.from_batches([*held, batch.cast(_PART_ARROW)]).combine_chunks().to_batches()[0]
        ids = together.column("cluster_id").to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))
        if cut:
            done = together.slice(0, cut)
            yield from _totals(ids[:cut], done.column("members").to_numpy(), done.column("total"))
        rest = together.slice(cut)
        held = list(_totals(ids[cut:], rest.column("members").to_numpy(), rest.column("total")))
    yield from held


def describe(nodes: DataFrame, clusters: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, field_no, size, medoid, typical, mean_cosine) of every cluster; a node without links is one by itself.

    The mean cosine of a member with all members is its product with the mean unit vector, so a cluster of
    any size costs one pass. The medoid has the greatest; ``typical`` lists the best few. Ties: smaller node id.
    """
    scratch = storage.Scratch(nodes.sparkSession, "clusters-described")
    named = nodes.join(clusters.select("cluster_id", F.col("node_id").alias("id")), "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "id"))
    named = scratch.keep(named.select("cluster_id", "id", "field_no", "vec"), "members")
    parts = named.select("cluster_id", "vec").mapInArrow(_sums, _PART)
    sums = grouped(parts, ["cluster_id"], partitions_for((named, 0.5))).mapInArrow(_join_sums, _PART)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    dot: Column = F.aggregate(F.zip_with("vec", "total", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = named.join(sums, "cluster_id").select("cluster_id", "id", "field_no", "members", F.round(F.when(length > 0, dot / length / F.col("members")).otherwise(0.0), 9).alias("score"))
    best = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), "id")
    top = scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= typical)
    listed = F.sort_array(F.collect_list(F.struct("nth", "id", "score")))
    described = top.groupBy("cluster_id").agg(F.first("field_no").alias("field_no"), F.first("members").alias("size"), listed.alias("t")).select(
        "cluster_id", "field_no", "size", F.col("t")[0]["id"].alias("medoid"), F.col("t.id").alias("typical"), F.col("t")[0]["score"].alias("mean_cosine")
    )
    return scratch.result(described)
