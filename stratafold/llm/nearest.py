"""The k most similar vectors for every query vector.

Every indexed vector lies in one cell of each of several cross-polytope tables; a query looks into several cells of
each table, and all candidates found are reranked by their exact cosine. Search goes in rounds of more and more probes.
A round settles the queries whose whole answer reaches the cosine down to which its probes are dense enough; what no
round settles (far neighbours, fields with fewer rows than asked for) gets an exact scan in blocks, so nothing is
dropped for being hard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.llm.polytope import units_of, width_of
from stratafold.llm.vectors import CHUNK, Cells, chunk_of, chunked, cosines, field_dimensions, grouped, partitions_for, runs, table_matrix, usable

#: Tables, tail and probes in each table for each round, from coarse cells to fine ones.
FINENESS = ((2, 0, (8, 16, 48)), (3, 4, (8, 32, 128)), (4, 16, (16, 64, 256)), (5, 64, (32, 128, 512)))
#: The least cosine of an answer for which a round's probes are relied on. A neighbour at just that cosine misses all tables with a
#: probability of 0.0002, 0.001 and 0.003 in the coarsest cells, 0.0008, 0.002 and 0.02 in the next (64 dimensions, simulated).
FLOORS = (0.95, 0.85, 0.6)
#: What comparing a node with one more query costs, against the cost of shuffling the node.
COMPARE = 0.002
#: The step of the exact scan.
SCAN = len(FLOORS) + 1
_FOUND = "query_id bigint, node_id bigint, cosine double, top_k int"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("node_id", pa.int64()), ("cosine", pa.float64()), ("top_k", pa.int32())])
#: Slack of single-precision products against the exact cosine.
_SLACK = np.float32(4e-6)


def _best(q_ids: np.ndarray, ks: np.ndarray, q: np.ndarray, n_ids: np.ndarray, n: np.ndarray, floor: float) -> Iterator[pa.RecordBatch]:
    """The best ``ks`` nodes of a block of nodes for each query, those of at least the cosine ``floor``: products in blocks, then
    exact cosines of the leaders."""
    order = np.argsort(ks, kind="stable")
    q_ids, ks, q = q_ids[order], ks[order], q[order]
    qu, nu = units_of(q), units_of(n)
    for a in range(0, len(q), 512):
        b = min(a + 512, len(q))
        want = np.minimum(ks[a:b], len(n))
        near = qu[a:b] @ nu.T
        least = np.full(b - a, np.float32(max(floor, -2.0)))
        if want.min() < len(n):
            at = np.unique(np.minimum(len(n) - want, len(n) - 1))
            ordered = np.partition(near, at, axis=1)
            least = np.maximum(least, np.where(want < len(n), ordered[np.arange(b - a), np.minimum(len(n) - want, len(n) - 1)], -2))
        rows, cols = np.nonzero(near >= (least - _SLACK)[:, None])
        exact = np.empty(len(rows))
        for s in range(0, len(rows), 1 << 16):
            part = slice(s, s + (1 << 16))
            exact[part] = cosines(q[a + rows[part]], n[cols[part]])
        kept = exact >= floor
        rows, cols, exact = rows[kept], cols[kept], exact[kept]
        ranked = np.lexsort((n_ids[cols], -exact, rows))
        rows, cols, exact = rows[ranked], cols[ranked], exact[ranked]
        first = np.searchsorted(rows, np.arange(b - a))
        keep = np.arange(len(rows)) - first[rows] < want[rows]
        rows, cols, exact = rows[keep], cols[keep], exact[keep]
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[a + rows]), pa.array(n_ids[cols]), pa.array(exact), pa.array(ks[a + rows].astype(np.int32))], schema=_FOUND_ARROW)


def _search(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cell", "chunk", "round"]):
            is_query = group.column("is_query").to_numpy()
            if is_query.all() or not is_query.any():
                continue
            ids, extra, vec = group.column("id").to_numpy(), group.column("extra").to_numpy(), table_matrix(group)
            yield from _best(ids[is_query], extra[is_query], vec[is_query], ids[~is_query], vec[~is_query], floor)

    return run


def _run(nodes: DataFrame, queries: DataFrame, partitions: int, floor: float = float("-inf")) -> DataFrame:
    """Search of rows (cell, chunk, round, id, extra, vec), nodes and queries of a group together."""
    both = nodes.withColumn("is_query", F.lit(False)).unionByName(queries.withColumn("is_query", F.lit(True)))
    return grouped(both, ["cell", "chunk", "round"], partitions).mapInArrow(_search(floor), _FOUND)


def _leaders(found: DataFrame, partitions: int) -> DataFrame:
    """The best ``top_k`` of each query; equal cosines by smaller node id. One shuffle by query serves both steps."""
    best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "node_id")
    one = found.repartition(partitions, "query_id").dropDuplicates(["query_id", "node_id"])
    return one.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= F.col("top_k"))


def _cut(rows: DataFrame, own: DataFrame | None, own_column: str, others: DataFrame | None, other_column: str) -> DataFrame:
    """``rows`` in blocks of their cells: each row in one of its own side's blocks, and in all blocks of the other side's."""
    for sizes, column, spread in ((own, own_column, False), (others, other_column, True)):
        if sizes is None:
            rows = rows.withColumn(column, F.lit(0))
            continue
        rows = rows.join(sizes, "cell", "left")
        number = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)) if spread else F.coalesce(chunk_of(F.col("id"), F.col("chunks")), F.lit(0))
        rows = rows.withColumn(column, number).drop("chunks")
    return rows


Fineness = tuple[int, int, tuple[int, ...]]


def _cells_of(dimensions: int, tail: int) -> int:
    return 2 * width_of(dimensions) * max(1, 2 * tail)


def fitting(nodes: DataFrame, dims: dict[str, int]) -> Fineness:
    """Of ``FINENESS`` the first whose cells hold a chunk of rows or less on average."""
    counts = {r.field_no: r.n for r in nodes.groupBy("field_no").agg(F.count("*").alias("n")).collect()}
    sizes = tuple(dims.values())
    for fineness in FINENESS:
        if max((n / _cells_of(sizes[no], fineness[1]) for no, n in counts.items()), default=0) <= CHUNK:
            break
    return fineness


def by_cells(nodes: DataFrame, queries: DataFrame, dims: dict[str, int], round: int = 0, floor: float = float("-inf"), fineness: Fineness | None = None) -> DataFrame:
    """Search through the cells that ``round`` probes, for answers of at least the cosine ``floor``. Cells crowded with nodes or with queries are
    searched in blocks of both."""
    tables, tail, probes = fineness or fitting(nodes, dims)
    scratch = storage.Scratch(nodes.sparkSession, "nearest-cells")
    index, look = Cells(tuple(dims.values()), tables, tail), Cells(tuple(dims.values()), tables, tail, probes[round])
    asked = scratch.keep(look.sizes(queries), "asked")
    many_nodes, many_queries = scratch.keep(chunked(index.sizes(nodes), CHUNK), "nodes"), scratch.keep(chunked(asked, 4 * CHUNK), "queries")
    hot, busy = (None if df.isEmpty() else df for df in (many_nodes, many_queries))
    n = partitions_for((nodes, tables), (queries, tables * probes[round]))
    placed = index.placed(nodes)
    if storage.broadcasts(asked):
        placed = placed.join(asked.select("cell"), "cell", "left_semi")
    found = _run(_cut(placed, hot, "chunk", busy, "round"), _cut(look.placed(queries), busy, "round", hot, "chunk"), n, floor)
    return scratch.result(_leaders(found, n))


def by_scan(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact search: every query against every node of its field, in blocks of bounded size."""
    block = 4 * CHUNK
    n_nodes = nodes.groupBy("field_no").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias("node_blocks"))
    n_queries = queries.groupBy("field_no").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias("query_blocks"))
    # written, so that its size is known and the join does not shuffle the vectors; as many rows as there are fields
    scratch = storage.Scratch(nodes.sparkSession, "nearest-scan")
    sizes = scratch.keep(n_nodes.join(n_queries, "field_no"), "sizes")
    cell = F.col("field_no").cast("bigint").alias("cell")
    a = nodes.join(sizes, "field_no").select(cell, chunk_of(F.col("id"), F.col("node_blocks")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("round"), "id", "extra", "vec")
    b = queries.join(sizes, "field_no").select(cell, F.explode(F.sequence(F.lit(0), F.col("node_blocks") - 1)).alias("chunk"), chunk_of(F.col("id"), F.col("query_blocks")).alias("round"), "id", "extra", "vec")
    copies = sizes.agg(F.max("query_blocks"), F.max("node_blocks")).first()
    n = partitions_for((nodes, copies[0] or 1), (queries, copies[1] or 1))
    return scratch.result(_leaders(_run(a, b, n), n))


def _scan_is_cheaper(queries: int, probes: int, cells: int, tables: int) -> bool:
    """Whether so few queries are left that sending every node once to them all costs less than sending the share of nodes that
    lies in the cells probed, once for each table."""
    return min(1.0, queries * probes / cells) * tables > -(-queries // (4 * CHUNK)) + COMPARE * queries


def nearest(nodes: DataFrame, queries: DataFrame, dims: dict[str, int]) -> DataFrame:
    """(query_id, node_id, cosine, top_k, nth, step) of the ``extra`` most similar nodes of each query.

    ``nodes`` and ``queries`` are as ``vectors.usable`` gives them; all-zero queries are left out, all-zero nodes have
    cosine 0. A query whose field has fewer nodes than it asks for gets them all. ``step`` is the round that settled the
    query, or ``SCAN``, which also takes the place of rounds after the first where it costs less for the queries left.
    """
    scratch = storage.Scratch(nodes.sparkSession, "nearest")
    fineness = fitting(nodes, dims)
    tables, tail, probes = fineness
    cells = min((_cells_of(d, tail) for d in dims.values()), default=1)
    parts, left, held = [], queries, []
    for step, floor in enumerate(FLOORS, 1):
        found = by_cells(nodes, left, dims, step - 1, floor, fineness)
        held.append(found)
        full = found.groupBy("query_id").agg(F.count("*").alias("n"), F.first("top_k").alias("k")).where("n = k").select("query_id")
        parts.append(found.join(full, "query_id", "left_semi").withColumn("step", F.lit(step)))
        left = scratch.keep(left.join(full.withColumnRenamed("query_id", "id"), "id", "left_anti").select(*queries.columns), "open")
        n = left.count()
        if not n or (step < len(FLOORS) and _scan_is_cheaper(n, probes[step], cells, tables)):
            break
    if n:
        held.append(by_scan(nodes, left))
        parts.append(held[-1].withColumn("step", F.lit(SCAN)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    out = scratch.result(every)
    storage.drop(*held)
    return out


def load_nodes(nodes: DataFrame, fields: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    dims = field_dimensions(fields)
    return usable(nodes, dims, "node_id", "node_vector", "removed", "written_at", purpose="nearest-nodes"), dims


def load_queries(queries: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Usable queries: besides a usable vector a positive ``top_k`` and an element that is not zero."""
    asked = queries.where((F.col("top_k") >= 1) & F.exists("query_vector", lambda x: x != 0))
    return usable(asked, dims, "query_id", "query_vector", None, "asked_at", "top_k", purpose="nearest-queries")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact answer that was found, over all queries of ``exact``; null if nothing was asked."""
    hit = found.select("query_id", "node_id", F.lit(1).alias("hit"))
    both = exact.select("query_id", "node_id").join(hit, ["query_id", "node_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.try_divide("found", "wanted"))
