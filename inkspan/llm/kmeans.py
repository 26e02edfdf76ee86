"""Centroid clustering with Elkan's bounds.

Of each vector an upper bound of the distance to its centroid and a lower one to every centroid are kept beside it.
When centroids move, bounds give way by as much; a centroid is measured only where neither its lower bound nor half its
distance from the vector's own centroid shows that it is farther. Bounds are rounded outwards and only strictly farther
centroids are skipped, so ties are decided by exact integer distances. Vectors and bounds stay in their blocks: a round
reads the blocks, writes them anew and sums what each cluster holds; only sums travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_batches, new_path, pick, remove, remove_at_end, table
from .tiles import LEAST, finite, floored, longs, matrix, pack

_WHOLE = T.DecimalType(38, 0)
_STATE = T.StructType([T.StructField(c, T.LongType() if c == "block" else T.IntegerType()) for c in ("block", "dim", "n")] + [T.StructField(c, T.BinaryType()) for c in ("vec_id", "data", "nameless", "cluster", "upper", "lower", "distance")] + [T.StructField("totals", T.ArrayType(_WHOLE))])
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf)), 0)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Centroids:
    """Exact centroids, how far each has moved, and half the distances between them, rounded inwards."""

    def __init__(self, values: list[list[int]], before: list[list[int]] | None = None):
        self.values = values
        whole = np.array(values, object)
        self.doubles = whole.astype(np.float64)
        apart = [[float(sum((a - b) ** 2 for a, b in zip(x, y))) for y in values] for x in values]
        self.half = _down(np.sqrt(apart) / 2)
        moved = [float(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(values, before or values)]
        self.moved = np.where(np.array(moved) > 0, _up(np.sqrt(moved)), 0).astype(np.float64)
        self.longest = float(np.sqrt(np.square(self.doubles).sum(1).max()))

    def measure(self, vectors: np.ndarray, squares: np.ndarray, longest: float, j: int) -> np.ndarray:
        """Exact squared distances to centroid j: in doubles where nothing can pass their mantissa, else in Python's
        integers."""
        if longest + self.longest < 2**25.5:
            c = self.doubles[j]
            return squares - 2 * (vectors @ c) + c @ c
        out = np.empty(len(vectors), object)
        out[:] = [sum((int(a) - b) ** 2 for a, b in zip(x, self.values[j])) for x in vectors.tolist()]
        return out


def assign(values: np.ndarray, centroids: Centroids, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances measured) of a block; bounds of the round before, or None at first."""
    n, k = len(values), len(centroids.values)
    vectors = values.astype(np.float64)
    squares = np.square(vectors).sum(1)
    longest = float(np.sqrt(squares.max(initial=0)))
    if cluster is None:
        cluster, lower = np.zeros(n, np.int32), np.zeros((n, k), np.float32)
        upper = np.full(n, np.inf, np.float32)
    else:
        cluster = cluster.copy()
        upper = _up(upper + centroids.moved[cluster])
        lower = _down(lower - centroids.moved[None])
    maybe = (lower <= upper[:, None]) & (centroids.half[cluster] <= upper[:, None])
    maybe[np.arange(n), cluster] = False
    rows = np.flatnonzero(maybe.any(1))
    measured = len(rows)
    best = np.zeros(n, object if longest + centroids.longest >= 2**25.5 else np.float64)
    for j in np.unique(cluster[rows]).tolist():
        own = rows[cluster[rows] == j]
        best[own] = centroids.measure(vectors[own], squares[own], longest, j)
        upper[own], lower[own, j] = _up(_root(best[own])), _down(_root(best[own]))
    first = cluster.copy()
    for j in range(k):
        own = rows[(first[rows] != j) & (lower[rows, j] <= upper[rows]) & (centroids.half[cluster[rows], j] <= upper[rows])]
        if not len(own):
            continue
        measured += len(own)
        apart = centroids.measure(vectors[own], squares[own], longest, j)
        lower[own, j] = _down(_root(apart))
        nearer = ((apart < best[own]) | ((apart == best[own]) & (j < cluster[own]))).astype(bool)
        own, apart = own[nearer], apart[nearer]
        cluster[own], best[own], upper[own] = j, apart, _up(_root(apart))
    return cluster, upper, lower, measured


def _totals(values: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int, measured: int) -> list[Decimal]:
    """Exact sums of each cluster's components, then counts, sums of distances, and how many distances were measured."""
    most = float(np.abs(values, dtype=np.float64).max(initial=0)) * max(1, len(values))
    sums = []
    for j in range(k):
        own = values[cluster == j]
        sums += own.sum(0, dtype=np.float64).tolist() if most < 2**53 else [sum(int(v) for v in column) for column in own.T.tolist()]
    inertia = [sum(int(d) for d in distance[cluster == j].tolist()) for j in range(k)]
    return [Decimal(int(v)) for v in [*sums, *np.bincount(cluster, minlength=k).tolist(), *inertia, measured]]


def _round(centroids: Centroids, first: bool, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k, schema = len(centroids.values), to_arrow_schema(_STATE)
    for batch in batches:
        for b in batch.to_pylist():
            values = matrix(b["data"], b["n"], b["dim"])
            bounds = (None, None, None) if first else (np.frombuffer(b["cluster"], np.int32), np.frombuffer(b["upper"], np.float32), np.frombuffer(b["lower"], np.float32).reshape(b["n"], k))
            cluster, upper, lower, measured = assign(values, centroids, *bounds)
            distance = np.zeros(0)
            if last:
                vectors = values.astype(np.float64)
                squares = np.square(vectors).sum(1)
                longest = float(np.sqrt(squares.max(initial=0)))
                distance = np.empty(b["n"], object)
                for j in np.unique(cluster).tolist():
                    own = cluster == j
                    distance[own] = [int(d) for d in centroids.measure(vectors[own], squares[own], longest, j).tolist()]
                upper = lower = np.zeros(0, np.float32)
            totals = _totals(values, cluster, distance if last else np.zeros(b["n"]), k, measured)
            cut = np.array([min(d, 2**63 - 1) for d in distance.tolist()], np.int64)
            state = b | {"cluster": cluster.astype(np.int32).tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "distance": cut.tobytes(), "totals": totals}
            yield pa.RecordBatch.from_pylist([{c: state[c] for c in schema.names}], schema=schema)


def first_centroids(rows: DataFrame, k: int, seed: str, factor: float) -> list[list[int]]:
    """The k vectors of the smallest sha256 of the seed, a colon and the id; rows without an id come last."""
    picked = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "embedding").limit(k)
    return [[int(v) for v in floored(np.array(r["embedding"], np.float64), factor).tolist()] for r in picked.collect()]


def rounds_of(rows: DataFrame, k: int, rounds: int, dim: int, factor: float, seed: str) -> tuple[DataFrame | None, list[list[int]], list[int], list[int]]:
    """The blocks after the last assignment, the centroids, each one's inertia, and how many distances every round
    measured. Blocks of a round are removed when the next one's are written."""
    spark = rows.sparkSession
    arrow_batches(spark)
    fine = pick(rows, "vec_id", "embedding").where(finite("embedding") & (F.size("embedding") == dim))
    values = first_centroids(fine, k, seed, factor)
    if not values:
        return None, [], [], []
    k, before, measured, path = len(values), None, [], None
    state = pack(fine.withColumn("nameless", F.col("vec_id").isNull()).withColumn("vec_id", F.coalesce("vec_id", F.lit(0))), factor)
    for r in range(rounds + 1):
        centroids = Centroids(values, before)
        first, last = r == 0, r == rounds
        state = state.mapInArrow(lambda batches, own=(centroids, first, last): _round(*own, batches), _STATE)
        old, path = path, new_path(spark, "clusters")
        state.write.parquet(path)
        remove_at_end(spark, path)
        if old:
            remove(spark, old)
        state = spark.read.schema(_STATE).parquet(path)
        summed = state.select(F.posexplode("totals").alias("place", "part")).groupBy("place").agg(F.sum("part").alias("part"))
        totals = [int(x["part"]) for x in sorted(summed.collect(), key=lambda x: x["place"])]
        counts, inertia = totals[k * dim : k * dim + k], totals[k * dim + k : k * dim + 2 * k]
        measured.append(totals[-1])
        before = values
        if not last:
            values = [[s // counts[j] for s in totals[j * dim : (j + 1) * dim]] if counts[j] else values[j] for j in range(k)]
    return state, values, inertia, measured


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, factor: float = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of ``dim`` components.

    Components become floor(factor * x). Rows with a null vector, another length, or a null, NaN or infinite component
    are left out. Repeated rows are vectors of their own, and so are rows without an id. Fewer vectors than ``k`` make
    fewer centroids; an empty table gives an empty result; other columns play no part. Distances beyond a long are cut
    off at its end; clusters and centroids are exact as long as a sum has at most 38 digits.
    """
    state, values, inertia, _ = rounds_of(rows, k, rounds, dim, factor, seed)
    if state is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    cut = lambda x: max(LEAST, min(x, 2**63 - 1))
    each, total = [cut(x) for x in inertia], cut(sum(inertia))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                cluster = np.frombuffer(b["cluster"], np.int32)
                columns = [pa.array(longs(b["vec_id"]), mask=longs(b["nameless"]) == 1), cluster, longs(b["distance"]), np.array(each)[cluster], np.full(b["n"], total), pa.array(digests).take(pa.array(cluster))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return state.select("n", "vec_id", "nameless", "cluster", "distance").mapInArrow(run, RESULT)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all ``embeddings`` after three rounds; ``clusters`` says how nulls, ties, repeated rows and
    empty tables count."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    apart = "list_inner_product(f.v, f.v) - 2 * list_inner_product(f.v, c.v) + list_inner_product(c.v, c.v)"
    parts = []
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT f.row, any_value(f.vec_id) AS vec_id, any_value(f.v) AS v, min({{'d': ({apart})::BIGINT, 'c': c.c}}) AS best FROM fine f, c{r} c GROUP BY f.row)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, place, sum(x) AS total, count(*) AS n FROM (SELECT best.c AS c, unnest(v)::HUGEINT AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY c, place)")
            parts.append(f"m{r} AS (SELECT c, list(((total - ((total % n) + n) % n) // n)::DOUBLE ORDER BY place) AS v FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)")
    return f"""
WITH fine AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS c, v FROM fine
  QUALIFY c < {k}),
{(',' + chr(10)).join(parts)}
SELECT vec_id, best.c AS cluster, best.d AS distance,
       (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c
"""


OP13_SQL = _sql()
