"""Spark data sources of the web: pages, a host's always in one task and with pauses, and a web archive's index, to
whose service filters are handed on. Failures are rows."""

from __future__ import annotations

import codecs
import json
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO
from urllib.parse import urlencode, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, IsNotNull, LessThanOrEqual, StringStartsWith

SCHEMA = "url string, status int, fetched_at timestamp, html string, error string"


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.timeout, self.pause = float(options.get("timeout", "30")), float(options.get("pause", "1.5"))
        self.each, self.agent = int(options.get("perpartition", "100")), options.get("agent", "inkspan")

    def partitions(self) -> list[_Urls]:
        """A host's urls stay together, so that its pauses hold; small hosts share a partition."""
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(_host(u), []).append(u)
        parts: list[list[str]] = []
        for own in hosts.values():
            if parts and len(parts[-1]) + len(own) <= self.each:
                parts[-1] += own
            else:
                parts.append(list(own))
        return [_Urls(p) for p in parts]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        from datetime import UTC, datetime

        last: dict[str, float] = {}
        for url in partition.urls:
            host = _host(url)
            if host in last:
                time.sleep(max(0.0, last[host] + self.pause - time.monotonic()))
            now = datetime.now(UTC)
            try:
                yield url, 200, now, _fetched(url, self.agent, self.timeout), None
            except (OSError, ValueError) as error:
                yield url, getattr(error, "code", None), now, None, str(error)[:500]
            last[host] = time.monotonic()


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _opened(url: str, agent: str, timeout: float) -> BinaryIO:
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout)


def _fetched(url: str, agent: str, timeout: float) -> str:
    with _opened(url, agent, timeout) as answer:
        return answer.read().decode("utf-8", "replace")


#: Bytes of an index that are read at a time, and characters that one row of it has at most.
READ_BYTES, ROW_CHARS = 1 << 18, 1 << 24


def matrix_rows(answer: BinaryIO, size: int = READ_BYTES) -> Iterator[list]:
    """Rows of a JSON array of arrays as they come in: what is held is ``size`` bytes and one row, however long the
    answer. An empty one has none; one that breaks off, or is no such array, is a ValueError."""
    text_of, scan = codecs.getincrementaldecoder("utf-8")("replace"), json.JSONDecoder().raw_decode
    text, at, ended = "", 0, False

    def more() -> None:
        nonlocal text, at, ended
        data = answer.read(size)
        ended = not data
        text, at = text[at:] + text_of.decode(data, ended), 0

    def mark() -> str:
        """The next character that isn't white space; none at the end."""
        nonlocal at
        while True:
            while at < len(text):
                if text[at] not in " \t\r\n":
                    return text[at]
                at += 1
            if ended:
                return ""
            more()

    first = mark()
    if first not in ("", "["):
        raise ValueError("an index is a JSON array of rows")
    while first:
        at += 1
        if (begin := mark()) == "]" and first == "[":
            break
        if begin != "[":
            raise ValueError("an index breaks off, or has something other than rows")
        while True:
            try:
                row, end = scan(text, at)
                break
            except ValueError:
                if ended or len(text) - at > ROW_CHARS:
                    raise
                more()
        at = end
        yield row
        first = mark()
        if first == "]":
            break
        if first != ",":
            raise ValueError("an index breaks off, or has something other than rows")
    at += 1
    if mark():
        raise ValueError("an index goes on after its end")


class _Index(InputPartition):
    def __init__(self, endpoint: str, pattern: str):
        self.endpoint, self.pattern = endpoint, pattern


#: Names in the service's answer by column.
_ANSWER = {"url": "original", "wayback_ts": "timestamp", "status": "statuscode", "mimetype": "mimetype", "digest": "digest"}


class _IndexReader(DataSourceReader):
    """Filters on status, time stamp and url's beginning go into the request; they are applied to the answer too, as an
    endpoint may be a stored file. An answer's rows are read one by one and never held together."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        split = lambda name: [x for x in options.get(name, "").split("\n") if x.strip()]
        self.indexes = [(e, p) for e in split("endpoint") for p in split("pattern") or [""]]
        self.timeout, self.agent, self.limit = float(options.get("timeout", "60")), options.get("agent", "inkspan"), options.get("limit")
        self.names, self.wanted, self.present = schema.names, {}, set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kind = {
                (EqualTo, "status"): "status", (GreaterThanOrEqual, "wayback_ts"): "from", (LessThanOrEqual, "wayback_ts"): "to", (StringStartsWith, "url"): "prefix",
            }.get((type(f), column))
            if isinstance(f, IsNotNull) and column in _ANSWER:
                self.present.add(column)
            elif kind and kind not in self.wanted:
                self.wanted[kind] = str(f.value)
            else:
                yield f

    def partitions(self) -> list[_Index]:
        return [_Index(e, p) for e, p in self.indexes]

    def request(self, index: _Index) -> str:
        own = {"url": index.pattern, "output": "json", "fl": ",".join(_ANSWER[n] for n in self.names), "collapse": "urlkey"}
        if "status" in self.wanted:
            own["filter"] = f"statuscode:{self.wanted['status']}"
        if self.limit:
            own["limit"] = self.limit
        own |= {k: self.wanted[k] for k in ("from", "to") if k in self.wanted}
        if "prefix" in self.wanted and not index.pattern:
            own |= {"url": self.wanted["prefix"], "matchType": "prefix"}
        return f"{index.endpoint}?{urlencode(own)}"

    def read(self, partition: _Index) -> Iterator[tuple]:
        stored = partition.endpoint.startswith("file:")
        with _opened(partition.endpoint if stored else self.request(partition), self.agent, self.timeout) as answer:
            yield from self.chosen(matrix_rows(answer))

    def chosen(self, rows: Iterator[list]) -> Iterator[tuple]:
        head = next(rows, [])
        at = {n: head.index(_ANSWER[n]) if _ANSWER[n] in head else None for n in _ANSWER}
        for row in rows:
            value = {n: None if k is None or k >= len(row) else row[k] for n, k in at.items()}
            if any(value[n] is None for n in self.present):
                continue
            stamp, url = value["wayback_ts"] or "", value["url"] or ""
            if "status" in self.wanted and at["status"] is not None and value["status"] != self.wanted["status"]:
                continue
            if stamp < self.wanted.get("from", "") or stamp > self.wanted.get("to", "~") or not url.startswith(self.wanted.get("prefix", "")):
                continue
            yield tuple(value[n] for n in self.names)


class ArchiveIndex(DataSource):
    """``spark.read.format("archiveindex")``: options ``endpoint`` and ``pattern``, newline-separated, make a partition for
    each pair; also limit, timeout, agent. Columns url, wayback_ts, status, mimetype, digest, or of these what
    ``.schema`` names: no others are asked for. An index that can't be read fails its task, so that no capture is
    missed unseen."""

    @classmethod
    def name(cls) -> str:
        return "archiveindex"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in _ANSWER])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _IndexReader(self.options, schema)


class WebPages(DataSource):
    """``spark.read.format("webpages").option("urls", newline-separated)``; also timeout, pause, perPartition."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known; filters reach sources in Python only where the session lets them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebPages)
    spark.dataSource.register(ArchiveIndex)


def captures(spark: SparkSession, endpoints: list[str], patterns: tuple[str, ...] = (), since: str | None = None, until: str | None = None, prefix: str | None = None, **options: str) -> DataFrame:
    """(url, wayback_ts, published_raw): each url's first good capture in the indexes, as ``readers.archive_index`` has it
    of a table of answers. Time stamps, status and the url's beginning are filtered where the index is read."""
    register(spark)
    rows = spark.read.format("archiveindex").options(endpoint="\n".join(endpoints), pattern="\n".join(patterns), **options).load().where(F.col("status") == "200")
    for condition in ((F.col("wayback_ts") >= since) if since else None, (F.col("wayback_ts") <= until) if until else None, F.col("url").startswith(prefix) if prefix else None):
        rows = rows if condition is None else rows.where(condition)
    first = rows.withColumn("url", F.rtrim("url", F.lit("/"))).groupBy("url").agg(F.min("wayback_ts").alias("wayback_ts"))
    day = F.concat_ws("-", F.substring("wayback_ts", 1, 4), F.substring("wayback_ts", 5, 2), F.substring("wayback_ts", 7, 2))
    return first.withColumn("published_raw", F.when(F.length("wayback_ts") >= 8, day).otherwise(F.lit("")))


def crawl(spark: SparkSession, page_url: Callable[[int], str], links: Callable[[DataFrame], DataFrame], pages: int = 50, first: int = 1, at_once: int = 1, stop_without_new: bool = False, **options: str) -> DataFrame:
    """Listing rows of a paginated listing: page after page, until one has no link, or (if wanted) no new one.

    ``links`` turns fetched pages (page_no, url, html) into rows with a ``url``; ``at_once`` pages are fetched
    together. Each url stays with the first page that had it, and pages beyond the one that ended the listing don't
    count. What is kept of a listing is bounded by its number of pages, not by a corpus.
    """
    register(spark)
    found: list[tuple] = []
    seen: set[str] = set()
    schema = None
    for begin in range(first, first + pages, at_once):
        numbers = range(begin, min(begin + at_once, first + pages))
        wanted = spark.createDataFrame([(page_url(n), n) for n in numbers], "url string, page_no int")
        fetched = spark.read.format("webpages").options(urls="\n".join(map(page_url, numbers)), **options).load()
        rows = links(fetched.join(F.broadcast(wanted), "url").select("page_no", "url", "html"))
        schema, own = rows.schema, rows.collect()
        for n in numbers:
            page = [r for r in own if r["page_no"] == n]
            news = [r for r in {r["url"]: r for r in reversed(page)}.values() if r["url"] not in seen]
            found += sorted(map(tuple, news), key=str)
            seen |= {r["url"] for r in news}
            if not page or stop_without_new and not news:
                return spark.createDataFrame(found, schema)
    return spark.createDataFrame(found, schema) if schema else spark.createDataFrame([], "page_no int, url string")


def last_page(html: Column | str) -> Column:
    """The largest page number that a listing's pagination links show, else 1."""
    numbers = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r'href="[^"]*/page/(\d+)'), F.lit(1))
    return F.coalesce(F.array_max(F.transform(numbers, lambda n: n.cast("int"))), F.lit(1))
