"""Articles, links and tables from stored pages. The parser is Python's own, run over Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import arrow_batches

NOISE = frozenset("script style nav footer header aside noscript".split())
NOISE_MARKS = frozenset("sidebar wm-ipp wm-ipp-base donato".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def squeezed(text: str) -> str:
    return " ".join(text.split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return squeezed(" ".join(out))

    def marks(self) -> set[str]:
        return {*self.attrs.get("class", "").split(), self.attrs.get("id", "")}


class _Builder(HTMLParser):
    """A tree; noise subtrees are kept out of it, however deep they nest."""

    def __init__(self, keep_noise: bool):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.keep, self.skipped, self.scripts = keep_noise, 0, []
        self.in_script = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "script":
            self.in_script = own.get("type", "")
        if self.skipped:
            self.skipped += tag not in VOID
            return
        node = Node(tag, own, self.at)
        if not self.keep and tag not in VOID and (tag in NOISE or node.marks() & NOISE_MARKS):
            self.skipped = 1
            return
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self.skipped:
            self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.in_script = None
        if self.skipped:
            self.skipped -= tag not in VOID
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.in_script == "application/ld+json":
            self.scripts.append(data)
        if not self.skipped:
            self.at.children.append(data)


#: What is no text, and an ampersand with the reference that it may begin.
_REFERENCE = re.compile(r"<!--.*?-->|<(script|style)\b.*?(?:</\1|\Z)|&(#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?", re.I | re.S)


def _ended(m: re.Match) -> str:
    known = m[0][0] != "&" or m[2] and (m[2][0] == "#" or m[2] in html5)
    return m[0] if known else f"&amp;{m[0][1:]}"


def parse(html: str | None, keep_noise: bool = False, ended_only: bool = False) -> tuple[Node, list[str]]:
    """The page's tree and its JSON-LD blocks; a page that can't be read to its end gives what came before.

    As in browsers, ``&amp`` is an ampersand without its semicolon too; with ``ended_only`` it stays as it is written,
    so a text that was cut inside a reference keeps what is left of it.
    """
    builder = _Builder(keep_noise)
    html = html or ""
    try:
        builder.feed(_REFERENCE.sub(_ended, html) if ended_only and "&" in html else html)
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.root, builder.scripts


def select(root: Node, selector: str) -> list[Node]:
    """Nodes by 'tag', '.class', '#id' or 'tag.class'."""
    m = re.fullmatch(r"([a-z0-9]*)(?:([.#])([\w-]+))?", selector)
    tag, kind, name = m[1], m[2], m[3]
    return [n for n in root.walk() if (not tag or n.tag == tag) and (not kind or (name in n.attrs.get("class", "").split() if kind == "." else n.attrs.get("id") == name)) and n.tag]


BODIES = ("article", "main", ".entry-content", ".article-body", "#content", ".content")


def title_of(root: Node) -> str:
    """The first heading that says something, else the page's title."""
    for node in select(root, "h1"):
        if len(t := node.text()) > 5:
            return t
    return next((t for n in select(root, "title") if (t := n.text())), "")


def body_of(root: Node, least: int = 50, paragraph: int = 40) -> str:
    """The first container with enough text, else all paragraphs of some length."""
    for selector in BODIES:
        for node in select(root, selector):
            if len(t := node.text()) > least:
                return t
    return " ".join(t for n in select(root, "p") if len(t := n.text()) > paragraph)


def linked_data_dates(scripts: list[str]) -> Iterator[str]:
    for text in scripts:
        try:
            todo = [json.loads(text)]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                yield from (x[k] for k in ("datePublished", "dateModified") if isinstance(x.get(k), str))
                todo += [x["@graph"]] if "@graph" in x else []


def published_of(root: Node, scripts: list[str]) -> str:
    """Linked data, then meta tags, then time elements, then a dated span or byline."""
    for d in linked_data_dates(scripts):
        return d
    for n in select(root, "meta"):
        if n.attrs.get("property", n.attrs.get("name", "")) in ("article:published_time", "date", "pubdate", "og:published_time"):
            return n.attrs.get("content", "")
    for n in select(root, "time"):
        if t := n.attrs.get("datetime") or n.text():
            return t
    for selector in (".date", ".published", ".byline"):
        for n in select(root, selector):
            if t := n.text():
                return t
    return ""


def topics_of(root: Node, pattern: str = r"/(topics?|tags?|categor)") -> list[str]:
    return sorted({t for n in select(root, "a") if re.search(pattern, n.attrs.get("href", "")) and 2 <= len(t := n.text()) <= 60})


_ARTICLE = "title string, published_raw string, body_raw string, topics array<string>"


def extract_articles(pages: DataFrame, key: str = "page_id", html: str = "html", ended_only: bool = False) -> DataFrame:
    """(key, title, published_raw, body_raw, topics) of each page; a null page has empty fields. ``ended_only`` as in
    ``parse``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(1).to_pylist():
                root, scripts = parse(page, ended_only=ended_only)
                heads = parse(page, keep_noise=True, ended_only=ended_only)[0] if not select(root, "title") else root
                rows.append((title_of(root) or title_of(heads), published_of(root, scripts), body_of(root), topics_of(root)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.string()))], names=[key, "title", "published_raw", "body_raw", "topics"])

    arrow_batches(pages.sparkSession)
    rows = pages.select(key, html)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {_ARTICLE}")


#: Links that lead nowhere.
NO_LINK = r"^(#|mailto:|javascript:)"


def links_of(page: str | None, base: str | None, include: str = "", exclude: str = NO_LINK, ended_only: bool = False) -> Iterator[tuple[str, str, int]]:
    """(url, title_hint, position) of a page's anchors that lead on, made absolute, the first of each url. ``ended_only``
    as in ``parse``."""
    seen: set[str] = set()
    for node in select(parse(page, keep_noise=True, ended_only=ended_only)[0], "a"):
        href = node.attrs.get("href", "").strip()
        if not href or re.search(exclude, href):
            continue
        try:
            whole = urljoin(base or "", href)
        except ValueError:
            continue
        if whole not in seen and re.search(include, whole):
            yield whole, node.text(), len(seen)
            seen.add(whole)


def tables_of(page: str | None) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """(table_no, row_no, cells, links) of every row of every HTML table."""
    for t, node in enumerate(select(parse(page)[0], "table")):
        for r, row in enumerate(select(node, "tr")):
            cells = [n for n in row.children if isinstance(n, Node) and n.tag in ("td", "th")]
            yield t, r, [c.text() for c in cells], [a.attrs.get("href", "") for a in select(row, "a")]


def extract_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", include: str = "", exclude: str = NO_LINK, ended_only: bool = False) -> DataFrame:
    """(key, url, title_hint, position): anchors that lead on, made absolute, first of each url in a page. ``ended_only``
    as in ``parse``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *link) for k, base, page in zip(*[batch.column(i).to_pylist() for i in range(3)]) for link in links_of(page, base, include, exclude, ended_only)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())], names=[key, "url", "title_hint", "position"])

    arrow_batches(pages.sparkSession)
    rows = pages.select(key, url, html)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, url string, title_hint string, position int")


def extract_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells, links): every row of every HTML table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *row) for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in tables_of(page)]
            columns = list(zip(*out)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "table_no", "row_no", "cells", "links"])

    arrow_batches(pages.sparkSession)
    rows = pages.select(key, html)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, table_no int, row_no int, cells array<string>, links array<string>")


def strip_tags(html: Column | str) -> Column:
    """Tags become spaces, white space collapses: for fragments without nesting noise."""
    x = F.col(html) if isinstance(html, str) else html
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"<[^>]+>", " "), r"(?U)\s+", " "))


def heading(html: Column | str) -> Column:
    """The first h1's text, else the title's: the native form, for pages of flat headings."""
    x = F.col(html) if isinstance(html, str) else html
    first = lambda tag: strip_tags(F.regexp_extract(x, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return F.coalesce(F.nullif(first("h1"), F.lit("")), first("title"))


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r'href="([^"]*)"'), F.lit(1))


def first_pdf(html: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.col(html) if isinstance(html, str) else html, r'(?i)href="([^"]*\.pdf[^"]*)"', 1), F.lit(""))
