"""Benchmark decontamination with a stored positional inverted index, sharded by document.

A shard is a few MB of documents. Its row of the index holds all its terms in order and, for each, the sorted places in
the shard's running word count, so a benchmark that comes later needs no reading of texts (``positional_index``). Test
items come in blocks of bounded size, one at a time. A block files each of its windows under the window's rarest term;
a shard takes only the windows that are filed under terms it holds, and of these only those whose other terms it holds
too. From its shortest list on, places less the offset in the window are intersected, and what remains are exact
phrases. Proximity matches take, for each place of the window's rarest term, the nearest place of every other term.

As shards hold whole documents, no posting crosses the network.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_batches, bitmaps, pick, slices, table, with_mark, written

#: Words of test items that one block may have; its lists travel to every executor.
BLOCK_WORDS = 2_000_000
#: Bytes of text in one shard of the index.
SHARD_BYTES = 2 << 20

#: Word bytes stay, A-Z in lower case; all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_INDEX = {"shard": pa.int64(), "doc_id": pa.list_(pa.int64()), "place": pa.list_(pa.int64()), "n_words": pa.list_(pa.int64()), "terms": pa.binary(), "counts": pa.binary(), "places": pa.binary()}
INDEX = "shard bigint, doc_id array<bigint>, place array<bigint>, n_words array<bigint>, terms binary, counts binary, places binary"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Items:
    """A block of test items in flat arrays: its terms in order of their bytes with their digests, the windows as rows of
    term numbers, each once, with the items that hold it, and the windows filed under each term."""

    def __init__(self, names: list[bytes], flat: np.ndarray, lengths: np.ndarray, owners: list[str | None], window: int):
        self.window = window
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int32)
        rank[order] = np.arange(len(names), dtype=np.int32)
        self._keep_terms([names[i] for i in order])
        self.owners = sorted({o for o in owners if o is not None})
        number = {o: i for i, o in enumerate(self.owners)}
        windows, held_by = _windows(rank[flat] if len(flat) else flat, lengths, np.array([number.get(o, -1) for o in owners], np.int32), window)
        # Equal windows come together, and each item counts once for one.
        if len(windows):
            keys = windows.view(np.dtype((np.void, 4 * (window + 1))))[:, 0]
            order = np.lexsort((held_by, np.unique(keys, return_inverse=True)[1]))
            windows, held_by = windows[order], held_by[order]
        new = np.ones(len(windows), bool)
        new[1:] = (windows[1:] != windows[:-1]).any(1)
        at = np.cumsum(new) - 1
        fresh = held_by >= 0
        fresh[1:] &= new[1:] | (held_by[1:] != held_by[:-1])
        self.held_by = held_by[fresh]
        self.windows, self.sizes = np.ascontiguousarray(windows[new, 1:]), windows[new, 0].astype(np.int32)
        self.held_from = np.concatenate([[0], np.cumsum(np.bincount(at[fresh], minlength=len(self.sizes)))])
        self._file()

    def _keep_terms(self, names: list[bytes]) -> None:
        digests = np.fromiter(map(xxhash.xxh64_intdigest, names), "<u8", len(names))
        self.by_digest = np.argsort(digests, kind="stable").astype(np.int32)
        self.digests = digests[self.by_digest]
        self.text = b"".join(names)
        self.ends = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))

    def _file(self) -> None:
        """Files each window under the term that the fewest windows hold, the first of equals by its bytes."""
        n = len(self.ends)
        often = np.zeros(n, np.int64)
        for at in range(0, len(self.windows), 1 << 16):
            own = np.sort(self.windows[at : at + (1 << 16)], axis=1)
            once = own >= 0
            once[:, 1:] &= own[:, 1:] != own[:, :-1]
            often += np.bincount(own[once], minlength=n)
        self.rarest = np.empty(len(self.windows), np.int32)
        for at in range(0, len(self.windows), 1 << 16):
            own = self.windows[at : at + (1 << 16)]
            cost = np.where(own >= 0, often[own] * n + own, np.iinfo(np.int64).max)
            self.rarest[at : at + (1 << 16)] = own[np.arange(len(own)), cost.argmin(1)]
        self.filed = np.argsort(self.rarest, kind="stable").astype(np.int32)
        self.filed_from = np.searchsorted(self.rarest[self.filed], np.arange(n + 1))

    def numbers(self, names: list[bytes]) -> np.ndarray:
        """Each name's number among the terms, or -1; equal digests of other names are passed over."""
        own = np.fromiter(map(xxhash.xxh64_intdigest, names), "<u8", len(names))
        low, high = np.searchsorted(self.digests, own), np.searchsorted(self.digests, own, "right")
        out = np.full(len(names), -1, np.int32)
        for i in np.flatnonzero(high > low).tolist():
            for k in self.by_digest[low[i] : high[i]].tolist():
                if self.text[self.ends[k - 1] if k else 0 : self.ends[k]] == names[i]:
                    out[i] = k
        return out

    def window_of(self, i: int) -> np.ndarray:
        return self.windows[i, : self.sizes[i]]

    def items_of(self, i: int) -> list[str]:
        return [self.owners[k] for k in self.held_by[self.held_from[i] : self.held_from[i + 1]].tolist()]


def _windows(flat: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of items that have words, as rows of (size, terms, -1 ..), and whose each is; short items are one."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    counts = np.where(lengths > 0, np.maximum(1, lengths - window + 1), 0)
    of = np.repeat(np.arange(len(lengths)), counts)
    first = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.full((len(of), window + 1), -1, np.int32)
    out[:, 0] = np.minimum(lengths[of], window)
    for k in range(window):
        some = k < out[:, 0]
        out[some, k + 1] = flat[first[some] + k]
    return out, owners[of]


def item_blocks(benchmark: DataFrame, window: int) -> Iterator[Items]:
    """Test items, read to the driver a partition at a time, in blocks of about BLOCK_WORDS words; one at least.

    A word is a number as soon as it is read: a block of 2 M words takes some 200 MB here and 150 in a worker.
    """

    def block() -> Items:
        return Items(list(terms), np.concatenate(flat) if flat else np.zeros(0, np.int32), np.array(lengths, np.int64), owners, window)

    terms, flat, lengths, owners, total, any_block = {}, [], [], [], 0, False
    for r in pick(benchmark, "item_id", "text").where("text is not null").withColumn("item_id", F.col("item_id").cast("string")).distinct().toLocalIterator():
        words = words_of(r["text"].encode())
        flat.append(np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int32, len(words)))
        lengths.append(len(words))
        owners.append(r["item_id"])
        total += len(words)
        if total >= BLOCK_WORDS:
            yield block()
            terms, flat, lengths, owners, total, any_block = {}, [], [], [], 0, True
    if lengths or not any_block:
        yield block()


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 33
    for group, _ in slices(batches, SHARD_BYTES):
        docs, places, counts, terms, ids = [], [], [], {}, []
        for batch in group:
            docs += batch.column(0).to_pylist()
            places += batch.column(1).to_pylist()
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                for w in words:
                    if w not in terms:
                        terms[w] = len(terms)
                ids.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        # Terms in order of their bytes, each one's places in order.
        names = sorted(terms)
        rank = np.empty(len(terms), np.int32)
        rank[np.fromiter(map(terms.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        own = rank[flat]
        values = [shard, docs, places, counts, b" ".join(names), np.bincount(own, minlength=len(names)).astype("<i4").tobytes(), np.argsort(own, kind="stable").astype("<i4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _INDEX.values())], names=list(_INDEX))
        shard += 1


def _texts(documents: DataFrame) -> DataFrame:
    arrow_batches(documents.sparkSession)
    return pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("place"), "text")


def positional_index(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The index as a stored table: one row a shard, with its documents, their word counts, and all postings.

    With a ``path`` it is kept there, for benchmarks to come: pass it as ``index``, and no text is read again. Else it
    goes with the session.
    """
    made = _texts(documents).mapInArrow(_indexed, INDEX)
    if path is None:
        return written(made, "index")
    made.write.mode("errorifexists").parquet(path)
    return documents.sparkSession.read.schema(INDEX).parquet(path)


def _each_block(documents: DataFrame | None, benchmark: DataFrame, window: int, index: DataFrame | None, match, fields: str) -> tuple[DataFrame, DataFrame]:
    """The index, and what ``match`` (items, shard, its documents) finds by shard, block after block.

    Where there is no index yet, the first block is looked up in each shard as it is made and stored, so postings are
    read back for further blocks only. A block leaves the executors when it is done with.
    """
    spark = benchmark.sparkSession
    arrow_batches(spark)
    kind = to_arrow_type(T._parse_datatype_string(f"array<struct<{fields}>>"))
    parts = []
    for block in item_blocks(benchmark, window):
        shared = spark.sparkContext.broadcast(block)

        def looked_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                of = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_words", "terms", "counts", "places")]
                found = [match(items, Shard(*rest, items), docs) for _, docs, *rest in zip(*of)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "found"])

        def made(batches: Iterator[pa.RecordBatch], looked_up=looked_up) -> Iterator[pa.RecordBatch]:
            return looked_up(_indexed(batches))

        schema = f"{INDEX}, found array<struct<{fields}>>"
        if index is None:
            stored = written(_texts(documents).mapInArrow(made, schema), "index")
            index, found = stored.drop("found"), stored.select("shard", "found")
        else:
            found = written(index.select(*_INDEX).mapInArrow(looked_up, schema).select("shard", "found"), "found")
        parts.append(found.select("shard", F.inline("found")))
        shared.destroy()
    return index, _union(parts)


class Shard:
    """Postings of one index row for the terms of a block."""

    def __init__(self, n_words: list[int], terms: bytes, counts: bytes, places: bytes, items: Items):
        self.n_words = np.array(n_words, np.int64)
        self.ends = np.cumsum(self.n_words)
        sizes, flat = np.frombuffer(counts, "<i4"), np.frombuffer(places, "<i4")
        cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        known = items.numbers(terms.split())
        self.lists = {int(known[i]): flat[cuts[i] : cuts[i + 1]].astype(np.int64) for i in np.flatnonzero(known >= 0).tolist()}

    def windows(self, items: Items) -> list[int]:
        """Windows all of whose terms the shard holds, found by the terms that it holds."""
        held = np.zeros(len(items.ends) + 1, bool)  # the last place stands for what pads short windows
        held[list(self.lists)] = held[-1] = True
        out: list[int] = []
        for t in sorted(self.lists):
            own = items.filed[items.filed_from[t] : items.filed_from[t + 1]]
            if len(own):
                out += own[held[items.windows[own]].all(1)].tolist()
        return out

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Starts of the window's exact occurrences inside one document."""
        lists = [(self.lists.get(int(t)), k) for k, t in enumerate(window)]
        if any(x is None for x, _ in lists):
            return np.zeros(0, np.int64)
        lists.sort(key=lambda x: len(x[0]))
        starts = lists[0][0] - lists[0][1]
        for own, k in lists[1:]:
            if not len(starts):
                return starts
            i = np.searchsorted(own, starts + k)
            i[i == len(own)] = 0
            starts = starts[own[i] == starts + k]
        if not len(starts):
            return starts
        starts = starts[starts >= 0]
        doc = np.searchsorted(self.ends, starts, "right")
        return starts[starts + len(window) <= self.ends[doc]]

    def near(self, window: np.ndarray, rarest: int, within: int) -> np.ndarray:
        """(first, last) of places where all the window's terms stand within so many words of its rarest one."""
        anchor, others = self.lists.get(rarest), [self.lists.get(t) for t in set(map(int, window)) - {rarest}]
        if anchor is None or any(x is None for x in others):
            return np.zeros((0, 2), np.int64)
        first, last = anchor.copy(), anchor.copy()
        doc, keep = np.searchsorted(self.ends, anchor, "right"), np.ones(len(anchor), bool)
        begin, end = self.ends[doc] - self.n_words[doc], self.ends[doc]
        for own in others:
            right = np.searchsorted(own, anchor)
            a, b = own[np.clip(right - 1, 0, len(own) - 1)], own[np.clip(right, 0, len(own) - 1)]
            ok_a, ok_b = [(abs(x - anchor) <= within) & (x >= begin) & (x < end) for x in (a, b)]
            best = np.where(ok_a & (~ok_b | (abs(a - anchor) <= abs(b - anchor))), a, b)
            keep &= ok_a | ok_b
            first, last = np.minimum(first, best), np.maximum(last, best)
        return np.stack([first[keep], last[keep] + 1], 1)


def matches(documents: DataFrame | None, benchmark: DataFrame, window: int = 10, within: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, begin, end, item_id): where windows of test items occur, counted in words from 0, end exclusive.

    Kind 'phrase' is an exact occurrence; with ``within`` there is a row of kind 'near' too wherever all of a window's
    terms stand within so many words of its rarest one. Windows of items without an id have a null ``item_id``. A row
    of documents that occurs twice has its matches twice. With an ``index`` made before, documents aren't read.
    """

    def match(items: Items, shard: Shard, docs: list[int]) -> list[tuple]:
        out, begins = [], shard.ends - shard.n_words
        for i in shard.windows(items):
            own = items.window_of(i)
            spans = [("phrase", s, s + len(own)) for s in shard.phrase(own).tolist()]
            if within is not None:
                spans += [("near", a, b) for a, b in shard.near(own, int(items.rarest[i]), within).tolist()]
            for kind, a, b in spans:
                d = int(np.searchsorted(shard.ends, a, "right"))
                out += [(docs[d], kind, a - int(begins[d]), b - int(begins[d]), item) for item in items.items_of(i) or [None]]
        return out

    fields = "doc_id:bigint,kind:string,begin:bigint,end:bigint,item_id:string"
    return _each_block(documents, benchmark, window, index, match, fields)[1].drop("shard")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _covered(items: Items, shard: Shard, _: list[int]) -> list[tuple]:
    """Of each document that holds a window: its place in the shard, the bits of its hit words, and the items."""
    edge, found = np.zeros((int(shard.ends[-1]) if len(shard.ends) else 0) + 1, np.int32), {}
    for i in shard.windows(items):
        window = items.window_of(i)
        starts = shard.phrase(window)
        if len(starts):
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + len(window), -1)
            for d in np.unique(np.searchsorted(shard.ends, starts, "right")).tolist():
                found.setdefault(d, set()).update(items.items_of(i))
    hit = np.cumsum(edge[:-1]) > 0
    return [(d, np.packbits(hit[shard.ends[d] - shard.n_words[d] : shard.ends[d]], bitorder="little").tobytes(), sorted(own)) for d, own in sorted(found.items())]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, the bits of all blocks united."""
    for batch in batches:
        hits = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in own])).sum()) for own in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), batch.column(3)], names=["shard", "at", "n_hit", "items"])


def contamination(documents: DataFrame | None, benchmark: DataFrame, window: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Per row of documents: doc_id, place, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Items without words match nothing, as do null and empty texts; an item of fewer words than a window is one
    window. Words that items without an id hit count in n_hit; such items aren't in n_items, items or the digest.
    ``place`` is the xxhash64 of the text. With an ``index`` made before, documents aren't read.
    """
    index, found = _each_block(documents, benchmark, window, index, _covered, "at:int,bits:binary,items:array<string>")
    # A document has a row for each block that hits it, so its lists are as long as there are blocks.
    by_doc = found.groupBy("shard", "at").agg(F.collect_list("bits").alias("bits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = by_doc.mapInArrow(_counted, "shard bigint, at int, n_hit bigint, items array<string>")
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "place", "n_words")).alias("at", "d")).select("shard", "at", "d.doc_id", "d.place", "d.n_words")
    out = rows.join(hits, ["shard", "at"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "place", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items")


def without_matches(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows that hold no window of a test item, with all their columns. Texts that may go are told apart by a
    bitmap, so that no others are moved."""
    own = contamination(documents, benchmark, window).where("contaminated").select(F.col("doc_id").alias("_doc"), F.col("place").alias("_place")).distinct()
    gone = written(own, "gone")
    texts = documents.withColumns({"_doc": F.col("doc_id").cast("long"), "_place": F.xxhash64("text")})
    marked = with_mark(texts, bitmaps(gone, "_doc", "_place"), "_doc", "_place")
    right = gone.select(F.col("_doc").alias("_d"), F.col("_place").alias("_p")).hint("shuffle_hash")
    left = marked.where("_marked")
    stay = left.join(right, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_place") == F.col("_p")), "left_anti")
    return marked.where("not _marked").select(*documents.columns).union(stay.select(*documents.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``; ``contamination`` says how nulls, empty and short texts, items
    without an id and repeated rows count."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontamination_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match by itself, proximity matches within ten words of a window's rarest term among them."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=10)


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP4_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase FROM starts),
docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
hits AS (
  SELECT doc_id, item, i, windows.size AS size FROM
    (SELECT doc_id, i, s.size, array_to_string(list_slice(w, i, i + s.size - 1), ' ') AS phrase
     FROM places, (SELECT DISTINCT size FROM windows) s WHERE i + s.size - 1 <= len(w)) p
  JOIN windows ON p.phrase = windows.phrase AND p.size = windows.size),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""

MATCHES_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
held AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS words FROM starts),
windows AS (SELECT row_number() OVER () AS id, words FROM (SELECT DISTINCT words FROM held)),
owners AS (SELECT windows.id, held.item FROM held JOIN windows ON held.words = windows.words),
terms AS (SELECT DISTINCT id, unnest(words) AS term FROM windows),
often AS (SELECT term, count(*) AS n FROM terms GROUP BY term),
rarest AS (SELECT id, arg_min(terms.term, (n, terms.term)) AS term, count(*) AS n_terms FROM terms JOIN often ON terms.term = often.term GROUP BY id),
docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
places AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS term FROM docs),
anchors AS (SELECT rarest.id, n_terms, rarest.term, doc_id, i FROM rarest JOIN places ON rarest.term = places.term),
others AS (SELECT a.id, a.doc_id, a.i, t.term, arg_min(p.i, (abs(p.i - a.i), p.i)) AS q
  FROM anchors a JOIN terms t ON a.id = t.id AND a.term <> t.term JOIN places p ON p.doc_id = a.doc_id AND p.term = t.term AND p.i BETWEEN a.i - 10 AND a.i + 10
  GROUP BY a.id, a.doc_id, a.i, t.term),
near AS (SELECT a.id, a.doc_id, least(a.i, coalesce(min(q), a.i)) AS begin, greatest(a.i, coalesce(max(q), a.i)) + 1 AS "end"
  FROM anchors a LEFT JOIN others o ON a.id = o.id AND a.doc_id = o.doc_id AND a.i = o.i GROUP BY a.id, a.doc_id, a.i, n_terms HAVING count(q) = n_terms - 1),
phrases AS (SELECT windows.id, p.doc_id, p.i AS begin, p.i + len(words) AS "end" FROM windows JOIN places p ON p.term = words[1]
  JOIN docs ON docs.doc_id = p.doc_id WHERE list_slice(docs.w, p.i + 1, p.i + len(words)) = words)
SELECT doc_id, 'near' AS kind, begin, "end", item AS item_id FROM near JOIN owners ON near.id = owners.id
UNION ALL SELECT doc_id, 'phrase', begin, "end", item FROM phrases JOIN owners ON phrases.id = owners.id
"""
