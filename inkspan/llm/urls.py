"""URL filter: a sorted array of 64-bit xxhash digests, memory-mapped, probed by binary search, confirmed by strings.

The index of a list is one file of shards: each has its digests in order, offsets, and the strings they stand for. Spark
sorts the entries by digest range and makes the shards; the driver only strings them together, one at a time. The file
lies in the shared folder and reaches executors through Spark's own file distribution, where it is mapped, not loaded.
Candidates of a URL are its host's suffixes at label borders, each with the path's prefixes of the lengths that rules
have.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, new_path, pick, remove_at_end, table, written

# The contract's rules.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Hosts that the method itself turns down, one a line: a short list to begin with, to be replaced by one's own.
BLOCK_LIST = Path(__file__).with_name("blocked_hosts.txt")


def listed_hosts(path: Path = BLOCK_LIST) -> list[str]:
    return [line.strip().lower() for line in path.read_text().splitlines() if line.strip() and not line.startswith("#")]


_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or without '://'."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_UPPER), tail[:stop]


#: Entries of a shard: some MB, which is what the driver holds at a time.
SHARD_ENTRIES = 1 << 16


def _shard(rows: list[tuple[int, str, str, bool]]) -> tuple[bytes, int, list[int]]:
    """A shard of rows (digest, key, verdict, whether a rule) in order: digests, offsets, strings; and how many labels a
    key's host has at most, and which lengths their paths have."""
    strings = [f"{'rule' if rule else 'list'}\t{verdict}\t{key}".encode() for _, key, verdict, rule in rows]
    hosts = [key.partition("/")[0] for _, key, _, _ in rows]
    lengths = sorted({len(key) - len(host) for host, (_, key, _, _) in zip(hosts, rows)})
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype("<u8")
    packed = np.array([r[0] for r in rows], "<u8").tobytes() + offsets.tobytes() + b"".join(strings)
    return packed + bytes(-len(packed) % 8), max((host.count(".") + 1 for host in hosts), default=0), lengths


def _foot(shards: list[tuple[int, int, int]], labels: int, lengths: Iterable[int]) -> bytes:
    """The file's end: where each shard (first digest, offset, entries) is, what candidates a url has, and its own size."""
    text = json.dumps({"shards": sorted(shards), "labels": labels, "lengths": sorted(lengths)}).encode()
    return text + len(text).to_bytes(8, "little")


def build_index(entries: Iterable[tuple[str, str, bool]]) -> bytes:
    """The index file of a short list of (key, verdict, whether a rule), as one shard."""
    rows = sorted((xxhash.xxh64_intdigest(key), key, verdict, rule) for key, verdict, rule in set(entries))
    packed, labels, lengths = _shard(rows)
    return (packed if rows else b"") + _foot([(rows[0][0], 0, len(rows))] if rows else [], labels, lengths)


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((digests ^ np.uint64(1 << 63)).view(np.int64))], names=[*batch.schema.names, "at"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a partition's entries, which come in order; equal digests stay in one."""

    def made(rows: list[tuple[int, str, str, bool]]) -> pa.RecordBatch:
        packed, labels, lengths = _shard(rows)
        return pa.RecordBatch.from_pylist([{"first": str(rows[0][0]), "n": len(rows), "labels": labels, "lengths": lengths, "packed": packed}], schema=_SHARD)

    held: list[tuple[int, str, str, bool]] = []
    for batch in batches:
        for key, verdict, rule, at in zip(*[c.to_pylist() for c in batch.columns]):
            digest = (at & (1 << 64) - 1) ^ 1 << 63
            if len(held) >= SHARD_ENTRIES and held[-1][0] != digest:
                yield made(held)
                held = []
            held.append((digest, key, verdict, rule))
    if held:
        yield made(held)


_SHARD = pa.schema([("first", pa.string()), ("n", pa.int64()), ("labels", pa.int32()), ("lengths", pa.list_(pa.int32())), ("packed", pa.binary())])


def write_index(entries: DataFrame, path: str) -> None:
    """Writes the index file of a table (key, verdict, rule) of any size: no entry passes through the driver by itself."""
    spark = entries.sparkSession
    arrow_batches(spark)
    own = entries.where("key is not null").distinct().mapInArrow(_with_digests, "key string, verdict string, rule boolean, at bigint")
    parts = max(1, -(-own.count() // SHARD_ENTRIES))
    ordered = own.repartitionByRange(parts, "at").sortWithinPartitions("at", "key", "verdict", "rule")
    made = written(ordered.mapInArrow(_shards, "first string, n bigint, labels int, lengths array<int>, packed binary"), "shards")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    shards, labels, lengths, offset = [], 0, set(), 0
    for r in made.toLocalIterator():
        out.write(r["packed"])
        shards.append((int(r["first"]), offset, r["n"]))
        labels, lengths, offset = max(labels, r["labels"]), lengths | set(r["lengths"]), offset + len(r["packed"])
    out.write(bytearray(_foot(shards, labels, lengths)))
    out.close()
    remove_at_end(spark, path)


class DigestArray:
    """A mapped index file: opening it reads its end alone."""

    def __init__(self, path: str):
        self.whole = np.memmap(path, "u1", "r")
        size = int.from_bytes(self.whole[-8:].tobytes(), "little")
        foot = json.loads(self.whole[-8 - size : -8].tobytes())
        self.labels, self.lengths, self.shards = foot["labels"], foot["lengths"], foot["shards"]
        self.firsts = np.array([s[0] for s in self.shards], np.uint64)

    def _at(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """A shard's digests, offsets, and where its strings begin."""
        _, begin, n = self.shards[k]
        digests = self.whole[begin : begin + 8 * n].view("<u8")
        offsets = self.whole[begin + 8 * n : begin + 16 * n + 8].view("<u8")
        return digests, offsets, begin + 16 * n + 8

    def probe(self, keys: list[str]) -> list[list[tuple[str, str, str]]]:
        """For each key the entries (kind, verdict, key) of that very string; equal digests of other strings are passed
        over. Each shard is searched once for all keys that may be in it."""
        own = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        of = np.searchsorted(self.firsts, own, "right") - 1
        out: list[list[tuple[str, str, str]]] = [[] for _ in keys]
        for k in np.unique(of[of >= 0]).tolist():
            digests, offsets, strings = self._at(k)
            some = np.flatnonzero(of == k)
            low, high = np.searchsorted(digests, own[some]), np.searchsorted(digests, own[some], "right")
            for j in np.flatnonzero(high > low).tolist():
                i = int(some[j])
                for e in range(low[j], high[j]):
                    kind, verdict, key = self.whole[strings + int(offsets[e]) : strings + int(offsets[e + 1])].tobytes().decode().split("\t", 2)
                    if key == keys[i]:
                        out[i].append((kind, verdict, key))
        return out


def _candidates(host: str, path: str, most: int, lengths: list[int]) -> Iterator[str]:
    """The host's suffixes of up to ``most`` labels, each with the path's prefixes of these lengths."""
    if not host:
        return
    end = len(host)
    for _ in range(most):
        end = host.rfind(".", 0, end)
        suffix = host[end + 1 :]
        for n in lengths:
            if n <= len(path):
                yield suffix + path[:n]
        if end < 0:
            return


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, blocked: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each row.

    ``blocked`` are hosts, as a list or as a table's first column, of any number; by default those of BLOCK_LIST. The
    longest rule that fits gives the verdict; without one, a host of the list is blocked and any other allowed. Rows
    without a url have an empty host and path, fit no rule and are allowed.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    kind = "key string, verdict string, rule boolean"
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in (listed_hosts() if blocked is None else blocked)], "key string")
    hosts = blocked.toDF(*[f"c{i}" for i in range(len(blocked.columns))]).select(F.nullif(F.lower(F.col("c0").cast("string")), F.lit("")).alias("key"), F.lit("block"), F.lit(False))
    path = new_path(spark, "urls")
    write_index(spark.createDataFrame([(k, v, True) for k, v in rules], kind).union(hosts), path)
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            keys = [list(_candidates(h, p, index.labels, index.lengths)) for h, p in parts]
            found, at = index.probe([k for own in keys for k in own]), 0
            rule, verdict, listed = [], [], []
            for own in keys:
                hits = [e for x in found[at : at + len(own)] for e in x]
                at += len(own)
                best = max((e for e in hits if e[0] == "rule"), key=lambda e: (len(e[2]), e[2]), default=None)
                listed.append(any(e[0] == "list" for e in hits))
                rule.append(best and best[2])
                verdict.append(best[1] if best else "block" if listed[-1] else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([p[i] for p in parts], pa.string()) for i in (0, 1)], pa.array(rule, pa.string()), pa.array(verdict), pa.array(listed)], names=["page_id", "host", "path", "rule", "verdict", "listed"])

    rows = pick(pages, "page_id", "url")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, listed boolean")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` judged; ``judge`` says how nulls count. Repeated rows stay, each by itself."""
    return judge(table(spark, sf_dir, "pages")).drop("listed")


def junk_hosts(pages: DataFrame) -> DataFrame:
    """Hosts half of whose pages or more hold junk marks (*** or %%%), from the pages themselves."""
    host = F.regexp_extract(F.col("url"), r"://([^/?#]*)", 1)
    rows = pages.select(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), (F.contains("html", F.lit("***")) | F.contains("html", F.lit("%%%"))).alias("junk"))
    return rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if("junk").alias("bad")).where("2 * bad >= n").select("host")


def pages_of_junk_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by a list of hosts that is itself computed from ``pages``, with the contract's rules before it."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, blocked=junk_hosts(pages)).select("page_id", "host", "rule", "verdict", "listed")


def _list(values: Iterable[str]) -> str:
    return ", ".join(f"('{v}')" for v in values)


OP9_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM cut),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  {", ".join(f"('{k}', '{k[:k.find('/')]}', '{k[k.find('/'):]}', '{v}')" for k, v in RULES)}),
listed(name) AS (VALUES {_list(listed_hosts())}),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
bad AS (
  SELECT DISTINCT page_id FROM parts JOIN listed ON host = name OR ends_with(host, '.' || name))
SELECT p.page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits ON p.page_id = fits.page_id LEFT JOIN bad ON p.page_id = bad.page_id
"""

JUNK_SQL = f"""
WITH {OP9_SQL[OP9_SQL.index("cut AS"):OP9_SQL.index("listed(name)")].rstrip().rstrip(",")},
listed AS (
  SELECT host AS name FROM parts p JOIN pages g ON p.page_id = g.page_id WHERE host <> ''
  GROUP BY host HAVING 2 * count(*) FILTER (WHERE contains(html, '***') OR contains(html, '%%%')) >= count(*)),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
bad AS (SELECT DISTINCT page_id FROM parts JOIN listed ON host = name OR ends_with(host, '.' || name))
SELECT p.page_id, host, rule, bad.page_id IS NOT NULL AS listed,
       coalesce(rule_verdict, CASE WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits ON p.page_id = fits.page_id LEFT JOIN bad ON p.page_id = bad.page_id
"""
