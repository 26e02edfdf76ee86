"""Line dedup: hashes of lines, range-partitioned and sorted, streamed once; bitmaps of dropped lines come back.

Line rows carry a 128-bit hash of the key, the document and the line's place, never the text. Partitions are ranges
of (hash, document), so a line that fills a third of the corpus is spread over many of them. A run of one hash that
begins inside a partition is decided as it streams by; only the first run of a partition, and a last one too short
to decide, are settled by a table of at most two rows a partition.

Rows without an id are in no document that could hold a line first: they keep all their lines and count for none.
Rows of one id are one document, whatever their texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, bitmaps, pick, table, with_mark, written

_RUNS = {"kind": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "sig": pa.int64(), "place": pa.int32(), "docs": pa.int64(), "best": pa.int64()}
_DROP, _OPEN, _STAT = 0, 1, 2


def line_key(line: bytes, least: int) -> bytes | None:
    """The line without outer blanks, A-Z lower-cased; None if under ``least`` code points."""
    key = line.strip().lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return key


def _hashed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, sigs, places = [], [], [], []
            for doc, text, sig in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if doc is None or not text:
                    continue
                for place, line in enumerate(text.split(b"\n")):
                    if (key := line_key(line, least)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        sigs.append(sig)
                        places.append(place)
            pair = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(docs, pa.int64()), pa.array(sigs, pa.int64()), pa.array(places, pa.int32())], names=["h1", "h2", "doc_id", "sig", "place"])

    return run


def _streamed(least_docs: int):
    """Rows come sorted by hash, then by document downwards, then by place.

    The first document of a run keeps its lines. A row goes at once if its run began here and has shown
    ``least_docs`` documents; before that, the rows of documents but the first wait, and those of the partition's
    first run are left open, as it may have begun next door.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = last = best = None
        docs, first, waiting = 0, True, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(_RUNS)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUNS.values())], names=list(_RUNS))

        for batch in batches:
            for h1, h2, doc, sig, place in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (h1, h2):
                    if first and key is not None:
                        out.append((_STAT, *key, None, None, None, docs, best))
                        first = False
                    key, docs, best, last = (h1, h2), 0, doc, None
                    waiting.clear()
                if doc != last:
                    docs, last = docs + 1, doc
                    if docs >= least_docs and not first:
                        out.extend((_DROP, h1, h2, *w, None, None) for w in waiting)
                        waiting.clear()
                if first:
                    out.append((_OPEN, h1, h2, doc, sig, place, None, None))
                elif doc != best:
                    if docs >= least_docs:
                        out.append((_DROP, h1, h2, doc, sig, place, None, None))
                    else:
                        waiting.append((doc, sig, place))
            yield flush()
        if key is not None:
            out.extend((_OPEN, *key, *w, None, None) for w in waiting)
            out.append((_STAT, *key, None, None, None, docs, best))
        yield flush()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for places in batch.column(2).to_pylist():
            bits = np.zeros(max(places) + 1, np.uint8)
            bits[places] = 1
            packed.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "sig", "dropped"])


def dropped_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, sig, dropped): for each text that loses lines, a compressed bitmap of their places.

    ``sig`` is the xxhash64 of the text, as an id may have several. Texts that keep all lines have no row.
    """
    spark = documents.sparkSession
    arrow_batches(spark)
    texts = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("sig", F.xxhash64("text"))
    rows = texts.mapInArrow(_hashed(min_chars), "h1 bigint, h2 bigint, doc_id bigint, sig bigint, place int")
    sort = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort, "sig", "place")
    runs = ranged.mapInArrow(_streamed(min_docs), "kind int, h1 bigint, h2 bigint, doc_id bigint, sig bigint, place int, docs bigint, best bigint")
    # Both readers below must see one and the same range partitioning, also after an executor is lost.
    runs = written(runs, "runs")
    ends = runs.where(F.col("kind") == _STAT).groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("best").alias("keeper")).where(F.col("n") >= min_docs)
    open_rows = runs.where(F.col("kind") == _OPEN).select("h1", "h2", "doc_id", "sig", "place")
    settled = open_rows.join(F.broadcast(ends), ["h1", "h2"]).where("doc_id <> keeper")
    gone = runs.where(F.col("kind") == _DROP).select("doc_id", "sig", "place").union(settled.select("doc_id", "sig", "place"))
    by_text = gone.groupBy("doc_id", "sig").agg(F.collect_set("place").alias("places"))
    return written(by_text.mapInArrow(_bitmaps, "doc_id bigint, sig bigint, dropped binary"), "bitmaps")


def with_kept_lines(documents: DataFrame, dropped: DataFrame, digest_only: bool = False) -> DataFrame:
    """The documents with n_lines, n_dropped and kept_text (or kept_sha256 in its place).

    A null or empty text is one empty line. Texts that may lose lines are told apart by a bitmap of 8 MB and meet
    theirs by a hash join; no others are moved, and none is sorted.
    """
    names_of = documents.columns
    left = documents.withColumns({"_doc": F.col("doc_id").cast("long"), "_sig": F.xxhash64("text")})
    marked = with_mark(left, bitmaps(dropped, "doc_id", "sig"), "_doc", "_sig")
    right = dropped.select(F.col("doc_id").alias("_d"), F.col("sig").alias("_s"), "dropped").hint("shuffle_hash")
    met = marked.where("_marked").join(right, (F.col("_doc") == F.col("_d")) & (F.col("_sig") == F.col("_s")), "left")
    joined = marked.where("not _marked").select(*names_of, F.lit(None).cast("binary").alias("dropped")).union(met.select(*names_of, "dropped"))
    at, column = joined.columns.index("text"), "kept_sha256" if digest_only else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, gone, kept = [], [], []
            for text, bitmap in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                own = (text or b"").split(b"\n")
                n = len(own)
                if bitmap is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
                    own = [x for x, b in zip(own, np.pad(bits, (0, n - len(bits)))) if not b]
                lines.append(n)
                gone.append(n - len(own))
                joined_lines = b"\n".join(own)
                kept.append(hashlib.sha256(joined_lines).hexdigest() if digest_only else joined_lines.decode())
            others = [c for i, c in enumerate(batch.columns[:-1]) if not (digest_only and i == at)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=names)

    arrow_batches(documents.sparkSession)
    fields = [f for f in joined.schema.fields[:-1] if not (digest_only and f.name == "text")]
    names = [*[f.name for f in fields], "n_lines", "n_dropped", column]
    return joined.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n_lines bigint", "n_dropped bigint", f"{column} string"]))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all ``documents``. A null or empty text is one empty line; repeated rows of the largest id all keep a
    shared line."""
    documents = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return with_kept_lines(documents, dropped_lines(documents), digest_only=True)


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, place, line, hot.k IS NOT NULL AND keyed.doc_id <> hot.keeper AS gone
  FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
