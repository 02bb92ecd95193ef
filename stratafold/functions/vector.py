"""Similarity of vectors, half precision, exact and inverted-file search."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold import storage

METRICS = ("cosine", "euclidean", "dot")
#: Defaults of an inverted file: its lists, and those that a search looks into first.
CLUSTERS, PROBES = 256, 8


def _vector(v: Column | Sequence[float]) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    """Inner product in double precision."""
    return _sum(F.zip_with(a, _vector(b), lambda x, y: x.cast("double") * y))


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """Cosine in double precision; 0 where one vector is all zero."""
    size = F.sqrt(dot(a, a) * dot(_vector(b), _vector(b)))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def euclidean(a: Column, b: Column | Sequence[float]) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.transform(F.zip_with(a, _vector(b), lambda x, y: x.cast("double") - y), lambda d: d * d)))


def score_fixed(v: Column, query: Sequence[float], metric: str) -> Column:
    """Similarity to one fixed vector, computed for whole Arrow batches at once; null for vectors of another length, with
    null or non-finite elements, and for null."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    q = np.asarray(query, dtype=np.float64)
    qq = float((q * q).sum())

    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        fit = np.flatnonzero(np.nan_to_num(pc.list_value_length(a).to_numpy(zero_copy_only=False), nan=-1) == len(q))
        if len(fit) and len(q):
            x = a.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fit), len(q))
            with np.errstate(all="ignore"):
                if metric == "euclidean":
                    s = -np.sqrt(((x - q) ** 2).sum(axis=1))
                else:
                    s = x @ q
                    if metric == "cosine":
                        size = np.sqrt((x * x).sum(axis=1) * qq)
                        s = np.where(size == 0, 0.0, s / np.where(size == 0, 1.0, size))
                out[fit] = np.where(np.isfinite(x).all(axis=1), s, np.nan)
        return pa.array(out, mask=np.isnan(out))

    return run(v)


def score(a: Column, b: Column | Sequence[float], metric: str) -> Column:
    """Similarity: the greater, the nearer. Euclidean distance counts negated."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return {"cosine": cosine, "dot": dot, "euclidean": lambda x, y: -euclidean(x, y)}[metric](a, b)


def distance(a: Column, b: Column | Sequence[float], metric: str) -> Column:
    """Distance: the smaller, the nearer; 1 - cosine, the Euclidean distance, or the negated inner product."""
    s = score(a, b, metric)
    return 1 - s if metric == "cosine" else -s


def distance_fixed(v: Column, query: Sequence[float], metric: str) -> Column:
    """``distance`` to one fixed vector."""
    s = score_fixed(v, query, metric)
    return 1 - s if metric == "cosine" else -s


def usable(v: Column, dimensions: int) -> Column:
    """Whether a vector has the right length and only finite elements; false for null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def half_precision(a: pa.Array) -> pa.Array:
    """Vectors rounded to half precision, elements beyond its range to infinity."""
    flat = a.flatten()
    with np.errstate(over="ignore"):
        half = flat.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
    values = pa.array(half, mask=flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None)
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy()))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=a.is_null() if a.null_count else None)


def top_k(df: DataFrame, key: str, field: str, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """(key, score) of the ``k`` most similar rows by an exact scan; ties by key."""
    scored = df.where(F.col(field).isNotNull()).select(key, score_fixed(F.col(field), query, metric).alias("score"))
    return scored.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), key).limit(k)


def _near(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of each row of ``x`` to each centroid."""
    if metric == "euclidean":
        return -((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T)
    near = x @ c.T
    if metric == "cosine":
        size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((c * c).sum(1))
        near = np.where(size > 0, near / np.where(size > 0, size, 1), 0)
    return near


def _places(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """For each row of ``x`` the place of each list in the order of probing."""
    return np.argsort(np.argsort(-np.round(_near(x, c, metric), 12), axis=1, kind="stable"), axis=1)


def _units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def _bounds(x: np.ndarray, c: np.ndarray, radii: np.ndarray, metric: str) -> np.ndarray:
    """For each row of ``x`` the greatest score that a vector of each list can have, by the triangle inequality."""
    if metric == "cosine":
        x, c = _units(x), _units(c)
    if metric == "euclidean":
        apart = np.sqrt(((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
        most = -np.maximum(apart - radii, 0)
        slack = apart + radii
    else:
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        most = x @ c.T + length * radii
        slack = length * (np.sqrt((c * c).sum(axis=1)) + radii)
    return most + 1e-9 * slack


class InvertedFile:
    """An index of flat lists: the first ``clusters`` vectors by key are the centroids, every vector lies in the list
    of the centroid most similar to it (ties: the earlier centroid).

    The centroids, at most ``clusters`` vectors whatever the size of the table, are held by the driver and sent with
    the tasks.
    """

    def __init__(self, df: DataFrame, key: str, field: str, metric: str = "cosine", clusters: int = CLUSTERS):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.key, self.field, self.metric = key, field, metric
        rows = df.where(F.col(field).isNotNull()).select(key, field).orderBy(key).limit(clusters).collect()
        self.centroids = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0][1]) if rows else 1)
        self.clusters = len(rows)
        self._radii: np.ndarray | None = None
        self.lists = df.where(F.col(field).isNotNull()).withColumn("centroid", self._nearest(F.col(field)))

    def _scores(self, x: np.ndarray) -> np.ndarray:
        return _near(x, self.centroids, self.metric)

    def radii(self) -> np.ndarray:
        """The greatest distance of a vector of each list from its centroid, for cosines of the unit vectors; -inf for empty lists."""
        if self._radii is None:
            c, unit = self.centroids, self.metric == "cosine"

            @F.pandas_udf("double")
            def away(v: pd.Series, centroid: pd.Series) -> pd.Series:
                if not len(v):
                    return pd.Series([], dtype="float64")
                x, own = np.stack(v.to_numpy()).astype(np.float64), c[centroid.to_numpy()]
                return pd.Series(np.sqrt((((_units(x) - _units(own)) if unit else (x - own)) ** 2).sum(axis=1)))

            found = np.full(self.clusters, -np.inf)
            for r in self.lists.select("centroid", away(self.field, "centroid").alias("away")).groupBy("centroid").agg(F.max("away").alias("away")).collect():
                found[r.centroid] = np.inf if r.away is None or np.isnan(r.away) else r.away
            self._radii = found
        return self._radii

    def _nearest(self, v: Column) -> Column:
        scores = self._scores

        @F.pandas_udf("int")
        def nearest(s: pd.Series) -> pd.Series:
            if not len(s):
                return pd.Series([], dtype="int32")
            return pd.Series(np.argmax(np.round(scores(np.stack(s.to_numpy()).astype(np.float64)), 12), axis=1).astype(np.int32))

        return nearest(v)

    def write(self, path: str) -> None:
        """Write the lists, a folder for each centroid, so that a search reads only those it probes, and what a search needs to
        know of them. A list of more than its share of rows is cut by key, so that no task writes it alone."""
        n = storage.spread(self.lists, 64 << 20)
        self.lists.repartitionByRange(n, "centroid", self.key).write.partitionBy("centroid").parquet(f"{path}/lists")
        spark = self.lists.sparkSession
        self.lists = spark.read.schema(self.lists.schema).parquet(f"{path}/lists")
        facts = {"key": self.key, "field": self.field, "metric": self.metric, "centroids": self.centroids.tolist(), "radii": [None if r == -np.inf else float(r) for r in self.radii()]}
        storage.write_text(spark, f"{path}/FACTS", json.dumps(facts | {"schema": self.lists.schema.json()}))

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedFile:
        """The inverted file that was written under ``path``."""
        facts = json.loads(storage.read_text(spark, f"{path}/FACTS"))
        out = InvertedFile.__new__(InvertedFile)
        out.key, out.field, out.metric = facts["key"], facts["field"], facts["metric"]
        out.centroids = np.array(facts["centroids"], dtype=np.float64)
        out.clusters = len(facts["centroids"])
        out._radii = np.array([-np.inf if r is None else r for r in facts["radii"]])
        out.lists = spark.read.schema(T.StructType.fromJson(json.loads(facts["schema"]))).parquet(f"{path}/lists")
        return out

    def search(self, query: Sequence[float], k: int, probes: int | None = None, removed: DataFrame | None = None) -> DataFrame:
        """(key, score) of the ``k`` best rows of the ``probes`` lists most similar to the query; without ``probes`` of all rows.

        For the latter the first few lists give a least score, and of the other lists those are read that may hold a better
        row. ``removed`` holds keys to be left out before the best are taken. An explicit number of probes beyond the
        number of lists is refused; fewer than all of them may miss rows.
        """
        if probes is not None and not 1 <= probes <= self.clusters:
            raise ValueError(f"{probes} probes of {self.clusters} lists")
        if not self.clusters:
            return top_k(self.lists, self.key, self.field, query, k, self.metric)

        def best(lists: Sequence[int]) -> DataFrame:
            rows = self.lists.where(F.col("centroid").isin(list(lists)))
            if removed is not None:
                rows = rows.join(removed.select(self.key), self.key, "left_anti")
            return top_k(rows, self.key, self.field, query, k, self.metric)

        x = np.asarray(query, dtype=np.float64)[None, :]
        place = _places(x, self.centroids, self.metric)[0]
        first = np.flatnonzero(place < (probes or PROBES)).tolist()
        if probes is not None or len(first) == self.clusters:
            return best(first)
        lead = best(first).agg(F.count("*"), F.min("score")).first()
        floor = lead[1] if lead[0] == k and k > 0 else -np.inf
        return best(np.flatnonzero((place < PROBES) | ~(_bounds(x, self.centroids, self.radii(), self.metric)[0] < floor)).tolist())

    def recall(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(queries, wanted, found, recall): the share of the exact ``k`` best that searches for the vectors of ``queries``, rows
        (key, field) as the index has them, find by reading the lists they do."""
        c, metric = self.centroids, self.metric
        radii = self.radii() if probes is None else np.zeros(self.clusters)

        @F.pandas_udf("array<double>")
        def places(v: pd.Series) -> pd.Series:
            return pd.Series(list(_places(np.stack(v.to_numpy()).astype(np.float64), c, metric).astype(np.float64)) if len(v) else [], dtype=object)

        @F.pandas_udf("array<double>")
        def bounds(v: pd.Series) -> pd.Series:
            return pd.Series(list(_bounds(np.stack(v.to_numpy()).astype(np.float64), c, radii, metric)) if len(v) else [], dtype=object)

        asked = queries.where(F.col(self.field).isNotNull()).select(F.col(self.key).alias("_asked"), F.col(self.field).alias("_query"), places(self.field).alias("_places"), bounds(self.field).alias("_bounds"))
        at = F.col("centroid") + 1
        pairs = self.lists.crossJoin(asked).select("_asked", self.key, score(F.col(self.field), F.col("_query"), metric).alias("score"), F.element_at("_places", at).alias("place"), F.element_at("_bounds", at).alias("bound"))
        nth = F.row_number().over(Window.partitionBy("_asked").orderBy(F.col("score").desc(), self.key))
        exact = pairs.withColumn("nth", nth).where(F.col("nth") <= k)
        reached = F.col("place") < (probes or PROBES)
        if probes is None:
            floors = pairs.where(reached).withColumn("nth", nth).where(F.col("nth") == k).select("_asked", F.col("score").alias("floor"))
            exact = exact.join(floors, "_asked", "left")
            reached = reached | F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))
        return exact.agg(F.countDistinct("_asked").alias("queries"), F.count("*").alias("wanted"), F.count_if(reached).alias("found")).withColumn("recall", F.try_divide("found", "wanted"))
