"""Exact top-k search by inner product: tiled matrix products of queries and shards.

Each tile, a block of queries with a shard, keeps its k best for every query; lists merge as a tree: the shards of a
bunch inside the task, then bunches by a salted query, then the salts of each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, table, written
from .tiles import NONE, STRIPE, bucketed, first_of, longs, matrix, merged, one_of_each, over_tiles, pack, products, usable

#: Queries of a block.
QUERY_ROWS = 4096


def without_own(scores: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores of a query with rows of its own id don't count; ``ids`` ascend."""
    low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    for i in np.flatnonzero(high > low).tolist():
        scores[i, low[i] : high[i]] = NONE if scores.dtype == np.int64 else -np.inf
    return scores


def _search(k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    out = []
    shards = right.to_pylist()
    for block in left.to_pylist():
        own, vectors = longs(block["vec_id"]), matrix(block["data"], block["n"], block["dim"])
        for at in range(0, block["n"], STRIPE):
            ids, best = own[at : at + STRIPE], None
            for shard in shards:
                if shard["dim"] == block["dim"]:
                    theirs = longs(shard["vec_id"])
                    scores = without_own(products(vectors[at : at + STRIPE], matrix(shard["data"], shard["n"], shard["dim"])), ids, theirs)
                    found = first_of(scores, theirs, k)
                    best = merged(best, found, k) if best else found
            if best:
                row, place = np.nonzero(best[0] > NONE)
                out.append(pa.table({"query_id": ids[row], "bunch": np.full(len(row), shards[0]["bunch"], np.int32), "vec_id": best[1][row, place], "score": best[0][row, place]}))
    return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "bunch": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})


def best_of(lists: DataFrame, keys: list[str], ident: str, k: int) -> DataFrame:
    """(keys, ident, score, rank): the k best of each key, an id once; lists are shuffled by their keys alone."""
    once = lists.repartition(*keys).groupBy(*keys, ident).agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), ident))).where(F.col("rank") <= k)


def search(queries: DataFrame, rows: DataFrame, k: int = 5, factor: float = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of the highest score, ties to the smaller vec_id.

    Both tables have vec_id and embedding. Components become floor(factor * x); scores are integer inner products,
    exact up to the ends of a long, where they are cut off. A query's own id is no candidate. Rows of a null id, or
    with a null vector or component, NaN or infinity take no part; vectors of different lengths aren't compared.
    Repeated rows of one id are one candidate, by their best score, and one query, by the least vector. A query
    without candidates, and with it an empty table, returns no rows; other columns play no part.
    """
    mine = bucketed(one_of_each(usable(queries, "vec_id", "embedding"), "vec_id", "embedding"), "vec_id", QUERY_ROWS)
    mine = written(pack(mine, factor, QUERY_ROWS, bucket="bucket"), "queries")
    shards = written(pack(usable(rows, "vec_id", "embedding"), factor), "shards")
    lists = over_tiles(mine, shards, lambda tiles: tiles, (), lambda left, right: _search(k, left, right), "query_id long, bunch int, vec_id long, score long")
    salts = max(1, math.isqrt(math.isqrt(max(1, shards.count()))))
    first = best_of(lists.withColumn("salt", F.col("bunch") % salts), ["query_id", "salt"], "vec_id", k).drop("rank")
    return best_of(first, ["query_id"], "vec_id", k).select("query_id", "rank", "vec_id", "score")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of all ``embeddings`` for each row whose id is divisible by 50; ``search`` says how nulls, ties,
    repeated rows and empty tables count."""
    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows.where(F.col("vec_id") % 50 == 0), rows)


OP11_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
