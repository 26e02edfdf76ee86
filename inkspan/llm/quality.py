"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text: its words, pairs and triples of words, and the same of words' shapes (runs of capitals, small
letters, digits; marks as they are), all hashed to one table of weights. Each of the six kinds has unit length, so
long texts weigh no more than short ones. One more feature for each power of two says how large a share of the word
triples recurs so often. A text's score is one sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, labelled_sample, one_text_each, pick, table, written

#: Weights of the model; each worker holds them once.
BUCKETS = 1 << 18
#: Labelled texts that the model is fitted on, and characters in all of them, at most. A text has a number and a
#: weight for each of its buckets, so 16 M characters make some 150 MB on the driver.
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 16_000_000
EPOCHS = 3
#: Score from which a text is predicted to be good.
THRESHOLD = 0.3

_SHAPE = bytes(b"A"[0] if 65 <= c <= 90 else b"a"[0] if 97 <= c <= 122 or c >= 128 else b"0"[0] if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_shapes: dict[bytes, int] = {}


def _shape(word: bytes) -> int:
    flat = word.translate(_SHAPE)
    code = _shapes.get(flat)
    if code is None:
        if len(_shapes) > 100_000:
            _shapes.clear()
        code = _shapes[flat] = crc32(_RUNS.sub(rb"\1", flat)[:16], 7)
    return code


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values), each bucket once, in order. Words weigh by the logarithm of their counts, shapes by the counts
    themselves, in texts of any length."""
    words = text.split() if text else []
    if not words:
        return np.array([0]), np.array([1.0])
    n = len(words)
    own = _mixed(np.fromiter(map(crc32, words), np.uint64, n))
    shape = _mixed(np.fromiter(map(_shape, words), np.uint64, n) + np.uint64(1 << 33))
    kinds: dict[tuple[str, int], np.ndarray] = {}
    for k, (kind, one) in enumerate((("word", own), ("shape", shape))):
        kinds[kind, 1] = one
        if n > 1:
            kinds[kind, 2] = _mixed(one[:-1] * np.uint64(3) + one[1:] + np.uint64(k))
        if n > 2:
            kinds[kind, 3] = _mixed(one[:-2] * np.uint64(9) + one[1:-1] * np.uint64(3) + one[2:] + np.uint64(k))
    places, values = [np.array([1])], [np.array([1.0])]
    for (kind, size), grams in kinds.items():
        some, counts = np.unique(grams % np.uint64(BUCKETS - 2), return_counts=True)
        weight = np.log1p(counts) if kind == "word" else counts.astype(float)
        places.append(some.astype(np.int64) + 2)
        values.append(weight / np.sqrt(weight @ weight))
        if (kind, size) == ("word", 3):
            level = np.minimum(np.log2(counts).astype(np.int64), 6)
            places.append((_mixed(np.arange(7, dtype=np.uint64) + np.uint64(1 << 40)) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2)
            values.append(np.bincount(level, counts, 7) / len(grams))
    buckets, at = np.unique(np.concatenate(places), return_inverse=True)
    return buckets, np.bincount(at, np.concatenate(values))


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["doc_id", "label", "places", "values"])


def follow_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights by FTRL-proximal updates, one per row and epoch, in an order that only the rows decide; a
    row's buckets differ from each other."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            label, p, v = rows[i]
            v = v.astype(float)
            zp, root = z[p], np.sqrt(n[p])
            w = np.where(np.abs(zp) <= l1, 0.0, (np.sign(zp) * l1 - zp) / ((beta + root) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - label) * v
            z[p] += g - (np.sqrt(n[p] + g * g) - root) / alpha * w
            n[p] += g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> np.ndarray:
    """Weights from about ``rows`` labelled texts of ``chars`` characters at most, none of them held out.

    Of an id with several texts one is taken. Without labelled texts all weights are 0.
    """
    arrow_batches(documents.sparkSession)
    sample = labelled_sample(labels, "quality", rows)
    marked = one_text_each(pick(documents, "doc_id", "text").join(F.broadcast(sample), "doc_id"))
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    sizes = written(marked, "labelled")
    total = sizes.agg(F.sum(F.length("text"))).head()[0] or 0
    if total > chars:
        share = int(chars / total * (1 << 30))
        sizes = sizes.where(F.pmod(F.xxhash64("doc_id", F.lit("characters")), F.lit(1 << 30)) < share).where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    found = sizes.mapInArrow(_featurised, "doc_id bigint, label int, places binary, values binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["places"])))
    return follow_leader([(r["label"], np.frombuffer(r["places"], "<i4"), np.frombuffer(r["values"], "<f4")) for r in found])


def scored(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts have the score of a text without words."""
    spark = documents.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            dots = np.array([w[p] @ v for p, v in map(features, batch.column(1).cast(pa.binary()).to_pylist())], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], names=["doc_id", "score"])

    texts = pick(documents, "doc_id", "text")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``. Null, empty and blank texts have one and the same score; rows of one id are scored
    each by itself, and a null id is not held out."""
    documents = table(spark, sf_dir, "documents")
    out = scored(documents, fit(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
