"""Newest-wins resolution of a change log, and the reads on top of it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE = "P", "D"


def newest(log: DataFrame, key: str = "_key", sequence: str = "_seq", keep_deletes: bool = False, operation: str = "_op") -> DataFrame:
    """One row for each key of a log: that of the greatest sequence number. Keys whose newest change is a delete are
    left out unless ``keep_deletes``. A partial aggregate per task comes before the shuffle, so hot keys do not gather."""
    rest = [c for c in log.columns if c not in (key, sequence)]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("_row"), F.max(sequence).alias(sequence))
    out = best.select(key, sequence, *[F.col("_row").getField(c).alias(c) for c in rest])
    return out if keep_deletes else out.where(F.col(operation) != DELETE)


def in_range(key: Column, low: Any = None, high: Any = None) -> Column:
    """Half-open range [low, high); null ends are open."""
    cond = F.lit(True)
    if low is not None:
        cond = cond & (key >= F.lit(low))
    if high is not None:
        cond = cond & (key < F.lit(high))
    return cond


def point(df: DataFrame, value: Any, key: str = "_key") -> DataFrame:
    """The row of one key, if there is one."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def patch(current: DataFrame, changes: DataFrame, key: str = "_key") -> DataFrame:
    """The rows of ``changes`` whose key exists, every null field filled from the current row."""
    fields = [c for c in current.columns if c != key]
    old, new = current.alias("old"), changes.alias("new")
    return new.join(old, key).select(key, *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in fields])


def replace(current: DataFrame, changes: DataFrame, key: str = "_key") -> DataFrame:
    """The current rows with those of ``changes``, whose keys must exist, in place of them."""
    fields = list(current.columns)
    kept = current.join(changes.select(key), key, "left_anti")
    return kept.select(*fields).unionByName(changes.join(current.select(key), key, "left_semi").select(*fields))


def missing_keys(current: DataFrame, changes: DataFrame, key: str = "_key") -> DataFrame:
    return changes.select(key).join(current.select(key), key, "left_anti")


def existing_keys(current: DataFrame, changes: DataFrame, key: str = "_key") -> DataFrame:
    return changes.select(key).join(current.select(key), key, "left_semi")


def unique_violations(df: DataFrame, field: str) -> DataFrame:
    """Values of ``field`` that more than one row has; nulls are never a violation."""
    return df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("rows")).where("rows > 1")
