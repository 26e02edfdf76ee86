"""Vectors of integers packed into blocks, and jobs over pairs of such blocks.

A table of vectors becomes rows of a few thousand vectors each: their ids, the matrix of their components and other
columns of integers, as bytes. A stated set of queries is packed likewise. A job over tiles then brings each block of
queries together with bunches of shards, which move through the shuffle whole; no pair of vectors ever is a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_batches, pick

#: Most vectors of a block, and most components: two MB where they fit 16 bits.
BLOCK_ROWS, BLOCK_VALUES = 8192, 1 << 20
#: Queries that are multiplied with a shard at a time.
STRIPE = 256
#: Least long that counts; the one below it marks an empty place.
LEAST, NONE = -(2**63) + 1, -(2**63)


def finite(vector: str) -> Column:
    """Whether a vector is there, without null, NaN or infinite components."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def usable(df: DataFrame, ident: str, vector: str, *others: str) -> DataFrame:
    """The named columns of the rows that take part: those with an id and a finite vector."""
    return pick(df, ident, vector, *others).where(F.col(ident).isNotNull() & finite(vector))


def one_of_each(df: DataFrame, ident: str, *others: str) -> DataFrame:
    """One row for each id: the least by the other columns."""
    least = df.groupBy(ident).agg(F.min(F.struct(*others)).alias("_least"))
    return least.select(ident, *[F.col("_least")[c].alias(c) for c in others])


def floored(values: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * x) as doubles, which hold it exactly."""
    return np.floor(factor * values.astype(np.float64))


def matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    """A block's components: 16-bit integers where all fit, else doubles."""
    return np.frombuffer(data, np.int16 if data[:1] == b"s" else np.float64, offset=8).reshape(n, dim)


def stored(values: np.ndarray) -> bytes:
    small = not values.size or (values.min() >= -32768 and values.max() <= 32767)
    return (b"s" if small else b"d").ljust(8) + values.astype(np.int16 if small else np.float64).tobytes()


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def pack(df: DataFrame, factor: float, rows: int = BLOCK_ROWS, more: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, object]] | None = None, fields: Sequence[T.StructField] = (), bucket: str | None = None) -> DataFrame:
    """(block, dim, n, vec_id, data, ...): the rows of (vec_id, embedding, further longs) in blocks of one length each.

    Rows stay in their partitions, or come together by a ``bucket`` of few rows; inside a block they are sorted by id.
    ``more`` makes further columns of a block, described by ``fields``, of its components and its longs.
    """
    arrow_batches(df.sparkSession)
    extra = [c for c in df.columns if c not in ("vec_id", "embedding", bucket)]
    df = df.select(F.col("vec_id").cast("long"), "embedding", *[F.col(c).cast("long") for c in extra], *([bucket] if bucket else []))
    binary = [T.StructField(c, T.BinaryType()) for c in ("vec_id", "data", *extra)]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("n", T.IntegerType()), *binary, *fields])
    arrow = to_arrow_schema(schema)

    def block(number: int, dim: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        own = [np.concatenate(x) for x in zip(*held)]
        order = np.argsort(own[1], kind="stable")
        values, ids, *rest = [x[order] for x in own]
        columns: dict[str, object] = {"block": number, "dim": dim, "n": len(ids), "vec_id": ids.tobytes(), "data": stored(values)}
        columns |= {c: x.tobytes() for c, x in zip(extra, rest)}
        if more:
            columns |= more(values, dict(zip(["vec_id", *extra], [ids, *rest])))
        return pa.RecordBatch.from_pylist([columns], schema=arrow)

    def blocks(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors, *rest = [batch.column(i) for i in range(2 + len(extra))]
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, rest = floored(vectors.flatten().to_numpy(zero_copy_only=False), factor), [x.to_numpy() for x in rest]
            starts, ids = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), ids.to_numpy()
            for dim in np.unique(lengths).tolist():
                at, most = np.flatnonzero(lengths == dim), max(1, min(rows, BLOCK_VALUES // max(1, dim)))
                for k in range(0, len(at), most):
                    part = at[k : k + most]
                    if held.get(dim) and sizes[dim] + len(part) > most:
                        yield block(first, dim, held.pop(dim))
                        first, sizes[dim] = first + 1, 0
                    held.setdefault(dim, []).append((flat[starts[part, None] + np.arange(dim)], ids[part], *[x[part] for x in rest]))
                    sizes[dim] = sizes.get(dim, 0) + len(part)
        for dim, own in held.items():
            yield block(first, dim, own)
            first += 1

    if bucket:
        return df.groupBy(bucket).applyInArrow(lambda key, rows: pa.Table.from_batches(blocks(rows.to_batches(), key[0].as_py() << 32), arrow), schema)
    return df.mapInArrow(lambda batches: blocks(batches, TaskContext.get().partitionId() << 32), schema)


def bucketed(df: DataFrame, ident: str, rows: int) -> DataFrame:
    """Adds ``bucket``: about ``rows`` rows each, by a hash of the id."""
    buckets = -(-df.count() // rows) or 1
    return df.withColumn("bucket", F.pmod(F.xxhash64(ident), F.lit(buckets)))


def over_tiles(queries: DataFrame, shards: DataFrame, wanted: Callable[[DataFrame], DataFrame], keep: Sequence[str], function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies ``function`` to each block of ``queries`` with each bunch of ``shards``, both written as ``pack`` made them.

    ``keep`` are the small columns of either side that ``wanted`` may choose tiles by, named q_ and s_ there; a tile is
    never moved if it isn't wanted. Sides of different vector lengths don't meet.
    """
    spark = queries.sparkSession
    n_shards, n_queries = shards.count(), queries.count()
    bunches = max(1, min(n_shards, 4 * math.isqrt(n_shards)))
    shards = shards.withColumnRenamed("block", "shard").withColumn("bunch", F.pmod(F.xxhash64("shard"), F.lit(bunches)).cast("int"))
    small = queries.select("block", "dim", F.explode(F.sequence(F.lit(0), F.lit(bunches - 1))).alias("bunch"), *[F.col(c).alias(f"q_{c}") for c in keep])
    tiles = shards.select("shard", "bunch", "dim", *[F.col(c).alias(f"s_{c}") for c in keep]).join(small, ["dim", "bunch"])
    tiles = wanted(tiles).select("shard", "bunch", "block")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bunches * n_queries // 16)
    left = queries.join(tiles.select("block", "bunch").distinct(), "block")
    right = shards.join(tiles, ["shard", "bunch"])
    left, right = [x.toDF(*x.columns).repartition(tasks, "block", "bunch") for x in (left, right)]  # names of their own
    return left.groupBy("block", "bunch").cogroup(right.groupBy("block", "bunch")).applyInArrow(function, schema)


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products of integers: in single or double precision where every partial sum fits its mantissa, by
    the lengths of the vectors; else in Python's integers, cut off at the ends of a long."""
    most = math.prod(float(np.sqrt(np.max(np.square(x, dtype=np.float64).sum(1), initial=0))) for x in (queries, shard))
    for kind, limit in ((np.float32, 2**23), (np.float64, 2**52)):
        if most < limit:
            return queries.astype(kind) @ shard.astype(kind).T
    whole = [np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape) for x in (queries, shard)]
    return np.clip(whole[0] @ whole[1].T, LEAST, 2**63 - 1).astype(np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its k best scores and their ids, ties to smaller ids; ``ids`` ascend, and scores that don't count
    are -inf or NONE. Fewer than k leave places of NONE."""
    none = NONE if scores.dtype == np.int64 else -np.inf
    if len(ids) > 1 and (same := ids[1:] == ids[:-1]).any():
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        scores, ids = np.maximum.reduceat(scores, starts, axis=1), ids[starts]
    n, m = scores.shape
    best, own = np.full((n, k), NONE, np.int64), np.zeros((n, k), np.int64)
    if not m:
        return best, own
    if m > k:
        limit = np.partition(scores, m - k, axis=1)[:, m - k, None]
        over = scores > limit
        equal = (scores == limit) & (limit > none)
        row, column = np.nonzero(over | equal & (np.cumsum(equal, 1) <= k - over.sum(1, keepdims=True)))
    else:
        row, column = np.nonzero(scores > none)
    found = scores[row, column].astype(np.int64)
    order = np.lexsort((column, -found, row))
    row, column, found = row[order], column[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best[row, place], own[row, place] = found, ids[column]
    return best, own


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two such lists for each row; an id found in both counts once, by its better score."""
    scores, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.lexsort((ids, -scores), axis=1) if scores.min(initial=0) > NONE else np.lexsort((ids, -np.maximum(scores, LEAST), scores == NONE), axis=1)
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    for j in range(1, ids.shape[1]):
        again[:, j] = ((ids[:, :j] == ids[:, j, None]) & (scores[:, :j] > NONE)).any(1)
    if again.any():
        order = np.argsort(again, axis=1, kind="stable")
        scores, ids = np.take_along_axis(np.where(again, NONE, scores), order, 1), np.take_along_axis(ids, order, 1)
    return scores[:, :k], ids[:, :k]
