"""Hard negatives by a pivot table.

Each row x gets one more component, sqrt(M^2 - |x|^2) for the length M of the longest row, and each anchor q a zero:
then |q - x|^2 = |q|^2 + M^2 - 2 qx, so the largest inner product is the least distance. Of each row the distances to
a few pivots are stored, a pivot p having a zero there too: their squares, |p|^2 + M^2 - 2 px, are integers. By the
triangle inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p), which brackets the score of q and x without
their product. Shards whose brackets miss what a block of anchors looks for aren't moved to it, rows whose brackets do
aren't multiplied; the rest get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, table, written
from .tiles import NONE, STRIPE, bucketed, first_of, floored, longs, matrix, merged, one_of_each, over_tiles, pack, products, usable
from .topk import best_of, without_own

#: Anchors of a block, pivots of each vector length, and the rows that pivots are chosen from.
ANCHOR_ROWS, PIVOTS, PIVOT_SAMPLE = 2048, 8, 1024
#: Share of the longest lengths by which brackets are widened, far above what rounding can take from them.
SLACK = 1e-5
_FIELDS = [T.StructField("pivots", T.BinaryType()), T.StructField("near", T.ArrayType(T.DoubleType())), T.StructField("far", T.ArrayType(T.DoubleType())), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType())]


def _squares(values: np.ndarray) -> np.ndarray:
    return np.square(values, dtype=np.float64).sum(1)


def chosen_pivots(rows: DataFrame, factor: float) -> dict[int, np.ndarray]:
    """By vector length up to PIVOTS rows, each the farthest from those before, out of the PIVOT_SAMPLE rows of the
    least hashes. The sample is bounded; results don't depend on it."""
    sample = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(PIVOT_SAMPLE).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for dim, vectors in by_length.items():
        values = floored(np.array(vectors, np.float64).reshape(len(vectors), dim), factor)
        picked = [0]
        apart = _squares(values - values[0])
        while len(picked) < PIVOTS and apart.max() > 0:
            picked.append(int(apart.argmax()))
            apart = np.minimum(apart, _squares(values - values[picked[-1]]))
        out[dim] = values[picked]
    return out


def longest(rows: DataFrame, factor: float) -> float:
    """M^2: the largest squared length of a row, or 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            values = np.square(floored(batch.column(0).flatten().to_numpy(zero_copy_only=False), factor))
            most = max(most, float(np.bincount(np.repeat(np.arange(len(lengths)), lengths), values).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"most": [most]})

    return rows.select("embedding").mapInArrow(run, "most double").agg(F.max("most")).first()[0] or 0.0


def with_cells(rows: DataFrame, pivots: dict[int, np.ndarray], factor: float) -> DataFrame:
    """Adds the nearest pivot's number, by which rows that share shards are near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("embedding"))
            offsets, flat = vectors.offsets.to_numpy(), floored(vectors.flatten().to_numpy(zero_copy_only=False), factor)
            lengths, starts = np.diff(offsets), offsets[:-1] - offsets[0]
            cells = np.zeros(len(lengths), np.int32)
            for dim, own in pivots.items():
                at = np.flatnonzero(lengths == dim)
                cells[at] = (_squares(own) - 2 * (flat[starts[at, None] + np.arange(dim)] @ own.T)).argmin(1) if len(at) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def _table(pivots: dict[int, np.ndarray], height: float, values: np.ndarray, _: dict[str, np.ndarray]) -> dict[str, object]:
    """A block's distances to the pivots: ``height`` is M^2 for rows and, with their zero, |q|^2 for anchors (None)."""
    own, squares = pivots.get(values.shape[1], np.zeros((0, values.shape[1]))), _squares(values)
    raised = squares[:, None] if height is None else height
    apart = np.sqrt(np.maximum(_squares(own) + raised - 2 * (values @ own.T), 0)).astype(np.float32)
    return {"pivots": apart.tobytes(), "near": apart.min(0).tolist(), "far": apart.max(0).tolist(), "least": float(squares.min()), "most": float(squares.max())}


class Bracket:
    """Lower and upper scores of some anchors with a shard's rows."""

    def __init__(self, anchors: np.ndarray, own: np.ndarray, theirs: np.ndarray, height: float):
        base = _squares(anchors)[:, None] + height
        slack = SLACK * (np.sqrt(height) + np.sqrt(base.max(initial=0)))
        near, far = np.zeros((len(own), len(theirs)), np.float32), np.full((len(own), len(theirs)), np.inf, np.float32)
        for q, x in zip(own.T, theirs.T):
            np.maximum(near, np.abs(q[:, None] - x[None]), out=near)
            np.minimum(far, q[:, None] + x[None], out=far)
        self.high = (base - np.square(np.maximum(near - slack, 0, dtype=np.float64))) / 2
        self.low = (base - np.square(far + slack, dtype=np.float64)) / 2


def _shards(right: pa.Table, dim: int) -> list[tuple]:
    out = []
    for s in right.to_pylist():
        if s["dim"] == dim:
            out.append((longs(s["vec_id"]), longs(s["label"]), matrix(s["data"], s["n"], dim), np.frombuffer(s["pivots"], np.float32).reshape(s["n"], -1)))
    return out


def _positives(k: int, height: float, left: pa.Table, right: pa.Table) -> pa.Table:
    """For each anchor of the block its k best rows of the same label in the bunch."""
    out = {"anchor_id": [], "bunch": [], "vec_id": [], "score": []}
    bunch = right["bunch"][0].as_py() if right.num_rows else 0
    for block in left.to_pylist():
        own, labels, vectors = longs(block["vec_id"]), longs(block["label"]), matrix(block["data"], block["n"], block["dim"])
        apart, shards = np.frombuffer(block["pivots"], np.float32).reshape(block["n"], -1), _shards(right, block["dim"])
        for label in np.unique(labels).tolist():
            mine, best = np.flatnonzero(labels == label), {}
            for ids, their_labels, values, table_of in shards:
                same = np.flatnonzero(their_labels == label)
                if not len(same):
                    continue
                ids, values, table_of = ids[same], values[same], table_of[same]
                for at in range(0, len(mine), STRIPE):
                    part = mine[at : at + STRIPE]
                    bracket = Bracket(vectors[part], apart[part], table_of, height)
                    limit = best[at][0][:, -1].astype(np.float64) if at in best else np.full(len(part), -np.inf)
                    if len(ids) > k and not (ids[1:] == ids[:-1]).any():
                        low = without_own(bracket.low.copy(), own[part], ids)
                        limit = np.maximum(limit, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
                    some = np.flatnonzero(~(bracket.high < limit[:, None]).all(0))
                    scores = without_own(products(vectors[part], values[some]), own[part], ids[some])
                    found = first_of(scores, ids[some], k)
                    best[at] = merged(best[at], found, k) if at in best else found
            for at, (scores, ids) in best.items():
                row, place = np.nonzero(scores > NONE)
                out["anchor_id"].append(own[mine[at + row]])
                out["vec_id"].append(ids[row, place])
                out["score"].append(scores[row, place])
    return _joined(out, bunch, len(out["score"]))


def _joined(out: dict[str, list], bunch: int, parts: int) -> pa.Table:
    columns = {c: np.concatenate(x) if parts else np.zeros(0, np.int64) for c, x in out.items() if c != "bunch"}
    n = len(next(iter(columns.values())))
    return pa.table({c: np.full(n, bunch, np.int32) if c == "bunch" else columns[c] for c in out})


def _negatives(k: int, positives: int, height: float, left: pa.Table, right: pa.Table) -> pa.Table:
    """For each anchor of the block and each of its positives the k best rows of other labels inside the band."""
    out = {"anchor_id": [], "bunch": [], "positive_id": [], "positive_score": [], "vec_id": [], "score": []}
    bunch = right["bunch"][0].as_py() if right.num_rows else 0
    for block in left.to_pylist():
        own, labels, vectors = longs(block["vec_id"]), longs(block["label"]), matrix(block["data"], block["n"], block["dim"])
        apart, shards = np.frombuffer(block["pivots"], np.float32).reshape(block["n"], -1), _shards(right, block["dim"])
        named, score, floor, top = [np.stack([longs(block[f"{c}{j}"]) for j in range(positives)], 1) for c in ("positive", "score", "floor", "top")]
        open_ = (top > NONE) & (floor <= top)
        for at in range(0, len(own), STRIPE):
            part = slice(at, at + STRIPE)
            best: list = [None] * positives
            for ids, their_labels, values, table_of in shards:
                bracket = Bracket(vectors[part], apart[part], table_of, height)
                least = np.where(open_[part], floor[part], np.inf).astype(np.float64)
                for j in range(positives):
                    if best[j]:
                        least[:, j] = np.maximum(least[:, j], best[j][0][:, -1])
                most = np.where(open_[part], top[part], -np.inf).astype(np.float64).max(1)
                out_of_band = (bracket.high < least.min(1)[:, None]) | (bracket.low > most[:, None]) | (their_labels[None] == labels[part, None])
                some = np.flatnonzero(~out_of_band.all(0))
                if not len(some):
                    continue
                scores = without_own(products(vectors[part], values[some]), own[part], ids[some])
                none = NONE if scores.dtype == np.int64 else -np.inf
                scores[their_labels[some][None] == labels[part, None]] = none
                for j in range(positives):
                    inside = (scores >= floor[part, j, None]) & (scores <= top[part, j, None]) & open_[part, j, None]
                    found = first_of(np.where(inside, scores, scores.dtype.type(none)), ids[some], k)
                    best[j] = merged(best[j], found, k) if best[j] else found
            for j in range(positives):
                if best[j]:
                    row, place = np.nonzero(best[j][0] > NONE)
                    for c, x in (("anchor_id", own[part][row]), ("positive_id", named[part, j][row]), ("positive_score", score[part, j][row]), ("vec_id", best[j][1][row, place]), ("score", best[j][0][row, place])):
                        out[c].append(x)
    return _joined(out, bunch, len(out["score"]))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, factor: float = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables have vec_id, embedding and label, a whole number. An anchor's positives are its first ``positives``
    other rows of its label; for each, its negatives are the first ``negatives`` rows of other labels whose score is
    from ``low`` to ``high`` hundredths of the positive's. Scores are integer inner products of floor(factor * x); the
    higher comes first, ties by the smaller vec_id. Rows of a null id or label, or with a null vector or component, NaN
    or infinity take no part; vectors of different lengths aren't compared. Repeated rows of one id count once, by
    their best score, and as an anchor by the least label and vector; an anchor's own id is none of its rows. Anchors
    without positives, or without negatives in the band, return nothing, and so does an empty table.
    """
    fine = usable(rows, "vec_id", "embedding", "label").where(F.col("label").isNotNull())
    pivots, height = chosen_pivots(fine, factor), longest(fine, factor)
    near = with_cells(fine, pivots, factor).repartitionByRange("cell", "vec_id", "label").sortWithinPartitions("cell", "vec_id").drop("cell")
    shards = written(pack(near, factor, more=partial(_table, pivots, height), fields=_FIELDS), "pivots")
    asked = one_of_each(usable(anchors, "vec_id", "embedding", "label").where(F.col("label").isNotNull()), "vec_id", "label", "embedding")
    asked = written(bucketed(asked, "vec_id", ANCHOR_ROWS), "anchors")
    of_anchors = partial(_table, pivots, None)
    blocks = written(pack(asked, factor, ANCHOR_ROWS, of_anchors, _FIELDS, bucket="bucket"), "blocks")
    lists = over_tiles(blocks, shards, lambda tiles: tiles, (), partial(_positives, positives, height), "anchor_id long, bunch int, vec_id long, score long")
    first = best_of(lists, ["anchor_id"], "vec_id", positives)
    of_rank = [F.max(F.when(F.col("rank") == j + 1, F.struct("vec_id", "score"))).alias(f"p{j}") for j in range(positives)]
    found = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(*of_rank)
    wide = found.select("vec_id", *[F.coalesce(F.col(f"p{j}.{c}"), F.lit(NONE)).alias(f"{name}{j}") for j in range(positives) for c, name in (("vec_id", "positive"), ("score", "score"))])
    # Decimals, as products may pass a long.
    share = [F.col(f"score{j}").cast("decimal(20,0)") / 100 for j in range(positives)]
    ends = [(F.ceil(x * low), F.floor(x * high)) for x in share]
    edges = [F.when(F.col(f"score{j}") > NONE, e.cast("long")).otherwise(NONE).alias(f"{name}{j}") for j in range(positives) for name, e in zip(("floor", "top"), ends[j])]
    paired = asked.join(wide.select("*", *edges), "vec_id")

    def aims(values: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, object]:
        own = of_anchors(values, columns)
        tops, floors = [np.stack([columns[f"{c}{j}"] for j in range(positives)]).astype(np.float64) for c in ("top", "floor")]
        some = (tops > NONE) & (floors <= tops)
        return own | {"lowest": float(np.where(some, floors, np.inf).min()), "highest": float(np.where(some, tops, -np.inf).max())}

    blocks = pack(paired, factor, ANCHOR_ROWS, aims, [*_FIELDS, T.StructField("lowest", T.DoubleType()), T.StructField("highest", T.DoubleType())], bucket="bucket")
    blocks, shards = written(blocks, "aims"), shards.withColumns({"lowest": F.lit(0.0), "highest": F.lit(0.0)})
    lists = over_tiles(blocks, shards, partial(_in_reach, height), ("near", "far", "least", "most", "lowest", "highest"), partial(_negatives, negatives, positives, height), "anchor_id long, bunch int, positive_id long, positive_score long, vec_id long, score long")
    best = best_of(lists, ["anchor_id", "positive_id", "positive_score"], "vec_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _in_reach(height: float, tiles: DataFrame) -> DataFrame:
    """Tiles whose best bracketed score isn't below what the block looks for, nor its worst above."""
    zero = F.lit(0.0)
    gaps = F.zip_with(F.zip_with("s_near", "q_far", lambda a, b: a - b), F.zip_with("q_near", "s_far", lambda a, b: a - b), lambda a, b: F.greatest(a, b, zero))
    reach = F.coalesce(F.array_min(F.zip_with("s_far", "q_far", lambda a, b: a + b)), F.lit(float("inf")))
    slack = SLACK * (F.sqrt(F.lit(height)) + F.sqrt(F.col("q_most") + height))
    high = (F.col("q_most") + height - F.pow(F.greatest(F.coalesce(F.array_max(gaps), zero) - slack, zero), 2)) / 2
    low = (F.col("q_least") + height - F.pow(reach + slack, 2)) / 2
    return tiles.where(~(high < F.col("q_lowest")) & ~(low > F.col("q_highest")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives of each of the five positives of the rows of ``embeddings`` whose id is divisible by 100, labels
    of ids divisible by 7 being one off; ``mine`` says how nulls, ties, repeated rows and empty tables count."""
    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM fine a JOIN fine c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
