"""Range partitions of a key space, and owners of partitions by rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold import storage
from stratafold.operators.versions import in_range


class PartitionError(ValueError):
    """Ranges that do not form a key space, or keys outside it."""


class RangePartitions:
    """Contiguous half-open ranges [b0, b1), [b1, b2), ... with an id each."""

    def __init__(self, bounds: Sequence[Any], ids: Sequence[int] | None = None):
        self.bounds = list(bounds)
        if len(self.bounds) < 2 or any(not a < b for a, b in zip(self.bounds, self.bounds[1:], strict=False)):
            raise PartitionError("bounds increase, and there are two or more")
        self.ids = list(ids) if ids is not None else list(range(len(self.bounds) - 1))
        if len(self.ids) != len(self.bounds) - 1 or len(set(self.ids)) != len(self.ids):
            raise PartitionError("there is one distinct id for each range")

    @staticmethod
    def from_ranges(ranges: Sequence[tuple[int, Any, Any]]) -> RangePartitions:
        """From (id, low, high), which must leave no gap and not overlap."""
        ordered = sorted(ranges, key=lambda r: r[1])
        for a, b in zip(ordered, ordered[1:], strict=False):
            if a[2] != b[1]:
                raise PartitionError(f"ranges {a[0]} and {b[0]} do not meet")
        return RangePartitions([r[1] for r in ordered] + [ordered[-1][2]] if ordered else [], [r[0] for r in ordered])

    def route(self, key: Column) -> Column:
        """The id of the range of each key, null outside all: a binary search as nested conditions."""

        def search(a: int, b: int) -> Column:
            if b - a == 1:
                return F.lit(self.ids[a])
            mid = (a + b) // 2
            return F.when(key < F.lit(self.bounds[mid]), search(a, mid)).otherwise(search(mid, b))

        return F.when((key >= F.lit(self.bounds[0])) & (key < F.lit(self.bounds[-1])), search(0, len(self.ids)))

    def route_key(self, key: Any) -> int:
        for i, (a, b) in enumerate(zip(self.bounds, self.bounds[1:], strict=False)):
            if a <= key < b:
                return self.ids[i]
        raise PartitionError(f"{key!r} is outside all ranges")

    def overlapping(self, low: Any, high: Any) -> list[int]:
        """Ids of the ranges that [low, high) touches."""
        if not low < high:
            raise PartitionError("a range begins before it ends")
        return [i for i, a, b in zip(self.ids, self.bounds, self.bounds[1:], strict=False) if a < high and low < b]

    def assigned(self, df: DataFrame, key: str, column: str = "partition_id") -> DataFrame:
        return df.withColumn(column, self.route(F.col(key)))

    def write(self, df: DataFrame, key: str, path: str) -> None:
        """Write ``df`` with a folder for each range, ordered by key, so that scans read only the ranges they touch. A range that
        holds most rows is written by several tasks, since the key takes part in the shuffle."""
        n = max(len(self.ids), storage.spread(df, 64 << 20))
        self.assigned(df, key).repartitionByRange(n, "partition_id", key).sortWithinPartitions("partition_id", key).write.partitionBy("partition_id").parquet(path)

    def scan(self, df: DataFrame, key: str, low: Any, high: Any, column: str = "partition_id") -> DataFrame:
        """Rows of [low, high) in key order; ``df`` has the column of range ids, which prunes folders."""
        return df.where(F.col(column).isin(self.overlapping(low, high)) & in_range(F.col(key), low, high)).orderBy(key)


def capped_per_partition(df: DataFrame, column: str, key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of every partition in key order, as a fan-out with a limit collects them."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(column).orderBy(key))).where(F.col("_nth") <= limit).drop("_nth")


def gathered(df: DataFrame, column: str, key: str, limit: int) -> DataFrame:
    """Global best ``limit`` of what the partitions give, each asked for the full limit; in key order."""
    return capped_per_partition(df, column, key, limit).orderBy(key).limit(limit)


def gathered_by_score(parts: Sequence[DataFrame], key: str, score: str, limit: int) -> DataFrame:
    """The best ``limit`` rows of all parts, each of which gave up to that many: greatest score first, NaN last, ties by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.isnan(score).asc(), F.col(score).desc_nulls_last(), key).limit(limit)


def ordered_merge(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows of all parts in key order; a key that several parts have stays as often."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(key)


# The FNV-1a offset and prime, and the finishing multipliers of the 64-bit mix.
_FNV_OFFSET, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_MIX_1, _MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _weights(ids: Sequence[str], node: str) -> np.ndarray:
    """Signed 64-bit weight of ``node`` for each id, all ids at once, byte by byte."""
    raw = [i.encode() + b"\xff" + node.encode() for i in ids]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    width = int(sizes.max(initial=0))
    padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), dtype=np.uint8).reshape(len(raw), width).astype(np.uint64)
    h = np.full(len(raw), _FNV_OFFSET, dtype=np.uint64)
    for at in range(width):
        h = np.where(at < sizes, (h ^ padded[:, at]) * np.uint64(_FNV_PRIME), h)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX_2)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def owners(identity: Column, nodes: Sequence[str], replicas: int = 1) -> Column:
    """The ``replicas`` nodes that own each id, best first: the greatest weights win, ties by node."""
    if not nodes:
        raise PartitionError("no live nodes")
    ordered = sorted(set(nodes))

    @F.pandas_udf("array<string>")
    def rank(ids: pd.Series) -> pd.Series:
        there = ids.notna().to_numpy()
        known = ids[there].astype(str).tolist()
        weights = np.stack([_weights(known, n) for n in ordered], axis=1) if known else np.empty((0, len(ordered)))
        best = np.argsort(~weights if known else weights, axis=1, kind="stable")[:, :replicas]
        out = pd.Series([None] * len(ids), dtype=object)
        out[there] = pd.Series([[ordered[j] for j in row] for row in best], index=np.flatnonzero(there), dtype=object)
        return out

    return rank(identity.cast("string"))


def owners_of_range(space: RangePartitions, prefix: str, low: Any, high: Any, nodes: Sequence[str]) -> dict[int, str]:
    """The owner of each partition that [low, high) touches; partitions are named ``prefix`` and id."""
    out = {}
    for i in space.overlapping(low, high):
        weights = [(int(_weights([f"{prefix}{i}"], n)[0]), n) for n in sorted(set(nodes))]
        out[i] = max(weights, key=lambda w: w[0])[1]
    return out


def reassigned(df: DataFrame, identity: str, before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """The ids whose owner differs between two sets of nodes, with both owners."""
    both = df.select(identity).distinct().select(identity, owners(F.col(identity), before)[0].alias("owner_before"), owners(F.col(identity), after)[0].alias("owner_after"))
    return both.where(F.col("owner_before") != F.col("owner_after"))
