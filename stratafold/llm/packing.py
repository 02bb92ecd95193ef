"""Filling containers of fixed capacity with whole items.

Sum-of-squares packing: with N(g) open containers of gap g, an item goes where the sum of N(g)^2 becomes least,
into one of the open containers it fits in or into a new one. Items are dealt into shards of bounded size by a
hash, each packed by one task; the items of containers that a shard leaves too empty are packed once more, together.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold import storage

#: Items of one packing task, and the share of a container below which its items are packed again.
SHARD_ITEMS = 40_000
SETTLED = 0.995
_PLACED = "container_kind string, container_id bigint, doc_id bigint, has_id boolean, piece int, token_start bigint, token_count bigint, fill bigint"

_KINDS = "array<struct<container_kind:string,capacity:bigint>>"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (0 to ``capacity``), taken in the order given.

    Placing a size s into gap g changes the sum of squares by 2 N(g-s) - 2 N(g) + 2, into a gap of just s by
    1 - 2 N(s), into a new container by 2 N(capacity-s) + 1; a full container is closed and not counted. Ties: the smaller gap, a new container last. Sizes
    of 0 take no room; they are spread over the containers that the others open.
    """
    out = np.full(len(sizes), -1, dtype=np.int64)
    gaps = np.zeros(capacity + 1, dtype=np.int64)
    open_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    highest = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        gap = 0
        fresh = 2 * gaps[capacity - s] + 1 if s < capacity else 0
        if highest >= s:
            now = gaps[s : highest + 1]
            change = 2 * (gaps[: highest + 1 - s] - now) + 2
            change[0] -= 1
            change[now == 0] = 2 * len(sizes) + 4
            at = int(change.argmin())
            if now[at] and change[at] <= fresh:
                gap = at + s
        if gap:
            box = open_of[gap].pop()
            gaps[gap] -= 1
        else:
            box, gap = opened, capacity
            opened += 1
        out[i] = box
        if gap > s:
            gaps[gap - s] += 1
            open_of[gap - s].append(box)
            highest = max(highest, gap - s)
    nothing = np.flatnonzero(out < 0)
    out[nothing] = np.arange(len(nothing)) % max(1, opened)
    return out


def _items(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """One row for each piece: a document, or the capacity-sized pieces and the rest of one that exceeds the capacity."""
    known = capacities.where("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c")).orderBy("container_kind").collect()
    # the catalogue of kinds is part of the plan; each document is copied once for each of them
    each = F.array(*[F.struct(F.lit(r.container_kind).alias("container_kind"), F.lit(int(r.c)).cast("bigint").alias("capacity")) for r in known]) if known else F.array().cast(_KINDS)
    pieces = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)).cast("int")
    return (
        sizes.select("doc_id", "has_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.explode(each).alias("kind"))
        .select("kind.*", "doc_id", "has_id", "n_tokens")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("token_start", F.col("piece") * F.col("capacity"))
        .withColumn("token_count", F.least(F.col("capacity"), F.col("n_tokens") - F.col("token_start")))
    )


def _pack(stage: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mark", "doc_id", "piece"], kind="stable")
        capacity = int(rows["capacity"].iloc[0])
        box = sum_of_squares(rows["token_count"].to_numpy(), capacity)
        fill = np.bincount(box, weights=rows["token_count"]).astype(np.int64)
        return rows.assign(container_id=(stage << 60) + (rows["shard"].to_numpy().astype(np.int64) << 32) + box, fill=fill[box])[
            ["container_kind", "container_id", "doc_id", "has_id", "piece", "token_start", "token_count", "fill"]
        ]

    return pack


def _packed(items: DataFrame, per_kind: DataFrame, stage: int) -> DataFrame:
    mark = F.xxhash64("doc_id", "piece", "token_count")
    shards = F.ceil(F.col("n") / SHARD_ITEMS).cast("bigint")
    sharded = items.join(per_kind, "container_kind").withColumn("mark", mark).withColumn("shard", F.pmod("mark", shards)).drop("n")
    n = max(items.sparkSession.sparkContext.defaultParallelism, storage.spread(items, 1 << 20, 1))
    return sharded.repartition(n, "container_kind", "shard").groupBy("container_kind", "shard").applyInPandas(_pack(stage), _PLACED)


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """Assign every document to containers of every kind.

    ``sizes``: (doc_id, n_tokens), null counts as none. ``capacities``: (container_kind, capacity_tokens), a small table.
    Result: container_kind, container_id, doc_id, piece, token_start, token_count. Only a document larger than the
    capacity has more than one piece. Documents of no tokens lie in containers too, taking no room. Repeated rows are packed
    like different documents, and so are documents without an id.
    """
    scratch = storage.Scratch(sizes.sparkSession, "packing")
    # pandas has no whole numbers that may be null: the ids of documents without one go as 0 and are put back at the end
    items = scratch.keep(_items(sizes.select(F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), capacities), "items")
    first = scratch.keep(_packed(items, items.groupBy("container_kind").agg(F.count("*").alias("n")), 0), "first")
    kinds = items.groupBy("container_kind").agg(F.max("capacity").alias("capacity"))
    settled = F.col("fill") >= F.col("capacity") * SETTLED
    judged = first.join(kinds, "container_kind")
    again = scratch.keep(judged.where(~settled).drop("container_id", "fill"), "again")
    second = _packed(again, again.groupBy("container_kind").agg(F.count("*").alias("n")), 1)
    packed = judged.where(settled).select(*first.columns).unionByName(second)
    return scratch.result(packed.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("fill", "has_id"))


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per kind: containers used, the least number that could hold the tokens, and the share of room used."""
    of = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("token_count").alias("tokens"))
    both = of.join(capacities.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")), "container_kind")
    return both.select("container_kind", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"))


