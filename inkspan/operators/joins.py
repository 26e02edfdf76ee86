"""Joins with a choice of plan behind a check of size, and unions by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast.
BROADCAST_ROWS = 100_000


def small_or_shuffled(right: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(right) if right.limit(rows + 1).count() <= rows else right


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than the cluster has cores, dealt out evenly; larger tables stay as read.

    For small files of wide texts, where one task would do all the work; at scale no shuffle comes of it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_remembered: dict[tuple[str, str], DataFrame] = {}


def remembered(spark: SparkSession, name: str, make: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """The table of this name as this application made it first, cached; what is evicted is computed anew."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _remembered:
        _remembered[key] = make(spark).cache()
    return _remembered[key]


def lookup(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with defaults for what isn't found."""
    out = left.join(right, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def top_semi(df: DataFrame, key: str, weight: str | None, k: int) -> DataFrame:
    """Rows whose key is among the k largest by count (or sum of ``weight``); k bounds the broadcast."""
    measure = F.count("*") if weight is None else F.sum(weight)
    best = df.groupBy(key).agg(measure.alias("_m")).orderBy(F.desc("_m"), key).limit(k).select(key)
    return df.join(F.broadcast(best), key, "left_semi")


def aligned(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """The keys of ``current`` with both values; a key without a previous one has 0 there."""
    return current.join(previous.withColumnRenamed(value, f"previous_{value}"), key, "left").na.fill(0, [f"previous_{value}"])


def both_sides(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """All keys of either with both values, missing ones 0: one aggregate over the union instead of an outer join."""
    marked = left.select(key, F.col(value).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.col(value).alias("r")))
    return marked.groupBy(key).agg(F.sum("l").alias("previous"), F.sum("r").alias("current"))


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_distinct(parts: Iterable[DataFrame]) -> DataFrame:
    return union_all(parts).distinct()


def routed(df: DataFrame, column: str, routes: dict[str, object]) -> DataFrame:
    """Each row through the function of its value in ``column``, results in one table; other rows fall away."""
    return union_all([f(df.where(F.col(column) == value)) for value, f in routes.items()])
