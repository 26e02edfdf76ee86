"""Extraction rules by source, as data: what is a page's title, date, body and topics, in which order, from how much text on.

A selector is a chain of steps parted by spaces, each below the one before: a tag, ``.class``, ``#id``, and attribute
tests ``[a]``, ``[a=x]``, ``[a*=x]`` (holds) or ``[a~x]`` (matches the pattern, in any case). All selectors of a source
are compiled together and matched in one walk down the tree; fields are then read off what the walk has found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.batches import arrow_batches
from .html import Node, linked_data_dates, parse, squeezed

#: Text that is never read as a page's.
_SILENT = frozenset(("script", "style", "template"))
_STEP = re.compile(r"([a-z0-9]*)((?:[.#][\w-]+|\[[^\]]+\])*)$")


@dataclass(frozen=True)
class Take:
    """What to read of the nodes of a selector: the first of ``attributes`` that isn't empty, else the text, unless
    ``text`` is off. ``each`` joins the texts of all nodes of more than ``least`` letters instead of the first one's.
    ``glued`` joins a node's pieces of text without spaces."""

    selector: str
    attributes: tuple[str, ...] = ()
    text: bool = True
    each: bool = False
    least: int = 0
    glued: bool = False


@dataclass(frozen=True)
class Chain:
    """Takes in order. The first value that isn't empty, has more than ``least`` characters and none of the ``refused``
    parts is the field's; with ``by_node`` the first take that finds a node decides, whatever its value. Failing that
    it is what ``otherwise`` gives, or, with ``keep_last``, the last value that was looked at. With ``letters`` the
    length is that of the node's pieces of text, without what joins them, as it always is for takes of each node."""

    takes: tuple[Take, ...]
    least: int = 0
    refused: tuple[str, ...] = ()
    by_node: bool = False
    keep_last: bool = False
    letters: bool = False
    otherwise: Take | None = None


#: A take of this selector reads the dates of linked data.
LINKED_DATA = "@linked"


@dataclass(frozen=True)
class Rules:
    """Fields of one source. Nodes of ``noise`` are left out of the page, those of ``inner_noise`` out of bodies. With
    ``needs_body`` a page on which no node of the body's chain is found gives no article. Topics have lengths from the
    first to the second of ``topic_lengths``. A listing's date stands in where the
    page has none or, with ``listed_date_first``, goes before it."""

    title: Chain
    body: Chain
    published: Chain = Chain(())
    topics: tuple[Take, ...] = ()
    topic_lengths: tuple[int, int] = (1, 1 << 30)
    listed_date_first: bool = False
    noise: tuple[str, ...] = ()
    inner_noise: tuple[str, ...] = ()
    needs_body: bool = False


def _chain(*takes: str | Take, **how) -> Chain:
    return Chain(tuple(t if isinstance(t, Take) else Take(t) for t in takes), **how)


_FRAME = ("script", "style", "nav", "footer", "header", "aside")
_ARCHIVE_BAR = ("#wm-ipp-base", "#wm-ipp", "#donato")
_STAMP = Take("time", ("datetime",))
_PUBLISHED_TIME = Take("meta[property=article:published_time]", ("content",), text=False)

# The selectors, their order and the least lengths by source.
RULES = {
    "agency_blog": Rules(
        title=_chain("h1"), published=_chain(_STAMP), body=_chain("main"), noise=_FRAME,
        topics=(Take("a[href*=/topics/]", each=True), Take("a[href*=/scams/]", each=True)), topic_lengths=(2, 60)),
    "payments_news": Rules(
        title=_chain(Take("h1", glued=True)), body=_chain("div.post-content", "article", by_node=True), needs_body=True,
        published=_chain(Take("time", ("datetime",), text=False), _PUBLISHED_TIME, Take("[class~post-date|byline|author]", glued=True))),
    "vendor_blog": Rules(
        title=_chain("h1"), noise=(*_FRAME, ".sidebar"), listed_date_first=True,
        published=_chain(LINKED_DATA, _PUBLISHED_TIME, _STAMP, "span[class~date|published|post-date]"),
        body=_chain(".entry-content", ".post-content", "[class*=body_1]", "[class*=article]", "[class*=blog]", "article", "main",
                    by_node=True, least=50, letters=True, otherwise=Take("p", each=True, least=40))),
    "security_news": Rules(
        title=_chain("h1.article_section", "h1"), published=_chain(Take("li.cz-news-date", ("datetime",)), _STAMP, by_node=True),
        body=_chain("div.articleBody"), noise=_ARCHIVE_BAR, inner_noise=("div.cz-related-article-wrapp", ".ad")),
    "complaint_center": Rules(
        title=_chain("h1"), body=_chain("div[class~field.?body|article.?body|entry.?content]", "article", "main", by_node=True),
        published=_chain(_STAMP, "span[class~date|published]", Take("meta[name~date]", ("content",), text=False), by_node=True),
        topics=(Take("a[class~tag|topic|category|label]", each=True),), inner_noise=("nav", "header", "footer")),
    "bureau_news": Rules(
        title=_chain("h1.page-title", "h1.title", "h1", "title", least=5, refused=("fbi.gov",), keep_last=True),
        body=_chain("div.field-items", "div.field--name-body", "article", "div[role=main]", "div.region-content", "main", least=200, keep_last=True),
        noise=_ARCHIVE_BAR, inner_noise=("nav", "header", "footer", ".breadcrumb", ".social-share")),
}

_Test = Callable[[Node], bool]


def _tests(step: str) -> tuple[str, list[_Test]]:
    """(tag or '', the tests of attributes that a node of that tag has to pass)."""
    m = _STEP.match(step)
    if not m:
        raise ValueError(f"no selector: {step}")
    tests: list[_Test] = []
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
        if part[0] == ".":
            tests.append(lambda n, x=part[1:]: x in n.attrs.get("class", "").split())
        elif part[0] == "#":
            tests.append(lambda n, x=part[1:]: n.attrs.get("id") == x)
        else:
            name, kind, value = re.match(r"([\w-]+)(?:(\*=|=|~)(.*))?$", part[1:-1]).groups()
            if kind is None:
                tests.append(lambda n, a=name: a in n.attrs)
            elif kind == "=":
                tests.append(lambda n, a=name, x=value: n.attrs.get(a) == x)
            elif kind == "*=":
                tests.append(lambda n, a=name, x=value: a in n.attrs and x in n.attrs[a])
            else:
                tests.append(lambda n, a=name, x=re.compile(value, re.I): a in n.attrs and x.search(" ".join(n.attrs[a].split())) is not None)
    return m[1], tests


def _passes(node: Node, tests: list[_Test]) -> bool:
    for test in tests:
        if not test(node):
            return False
    return True


class _AnyOf:
    """Whether a node is of one of the selectors, each of one step. A node without attributes meets bare tags only."""

    def __init__(self, selectors: Iterable[str]):
        own = [_tests(s) for s in selectors]
        self.bare = {tag for tag, tests in own if not tests}
        self.tested = [(tag, tests) for tag, tests in own if tests]

    def __call__(self, node: Node) -> bool:
        if node.tag in self.bare:
            return True
        if node.attrs:
            for tag, tests in self.tested:
                if (not tag or tag == node.tag) and _passes(node, tests):
                    return True
        return False


class Compiled:
    """A source's selectors by the tag of each step, so that a node meets only steps that it may pass."""

    def __init__(self, rules: Rules):
        self.rules = rules
        takes = [*rules.title.takes, *rules.published.takes, *rules.body.takes, rules.body.otherwise, *rules.topics]
        self.selectors = list(dict.fromkeys(t.selector for t in takes if t and t.selector != LINKED_DATA))
        self.last = [len(s.split()) - 1 for s in self.selectors]
        steps = [(i, k, *_tests(step)) for i, selector in enumerate(self.selectors) for k, step in enumerate(selector.split())]
        # By tag, and by whether a node has attributes: the steps that it may pass.
        self.steps: dict[tuple[str, bool], list[tuple[int, int, list[_Test]]]] = {}
        for tag in {"", *(s[2] for s in steps)}:
            for attributes in (False, True):
                own = [(i, k, tests) for t, at in ((tag, True), ("", tag != "")) if at for i, k, name, tests in steps if name == t]
                self.steps[tag, attributes] = [s for s in own if attributes or not s[2]]
        self.all_of = {t.selector for t in takes if t and t.each}
        self.noise, self.inner = _AnyOf(rules.noise), _AnyOf((*rules.noise, *rules.inner_noise))

    def found(self, root: Node) -> dict[str, list[Node]]:
        """Nodes by selector, in the page's order, from one walk; but for takes of each node only the first."""
        out: dict[str, list[Node]] = {s: [] for s in self.selectors}
        steps, rest, noise = self.steps, {a: self.steps["", a] for a in (False, True)}, self.noise
        todo = [(root, (0,) * len(self.selectors))]
        while todo:
            node, passed = todo.pop()
            if node.tag:
                if noise(node):
                    continue
                now = None
                attributes = bool(node.attrs)
                for i, k, tests in steps.get((node.tag, attributes), rest[attributes]):
                    if k <= passed[i] and _passes(node, tests):
                        if k == self.last[i]:
                            own = out[self.selectors[i]]
                            if not own or self.selectors[i] in self.all_of:
                                own.append(node)
                        elif k == passed[i]:
                            now = now or list(passed)
                            now[i] = k + 1
                passed = tuple(now) if now else passed
            todo += [(c, passed) for c in reversed(node.children) if isinstance(c, Node)]
        return out

    def pieces(self, node: Node, inner: bool = False) -> list[str]:
        """The node's pieces of text without scripts, noise and, if asked for, inner noise."""
        left_out = self.inner if inner else self.noise
        out: list[str] = []
        todo: list[Node | str] = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x.strip())
            elif x is node or (x.tag not in _SILENT and not left_out(x)):
                todo += reversed(x.children)
        return out

    def text(self, node: Node, glued: bool = False, inner: bool = False) -> str:
        return squeezed(("" if glued else " ").join(self.pieces(node, inner)))

    def letters(self, node: Node, inner: bool = False) -> int:
        return sum(map(len, self.pieces(node, inner)))

    def _value(self, take: Take, nodes: list[Node], inner: bool) -> str:
        if take.each:
            each = [self.pieces(n, inner) for n in nodes]
            return squeezed(" ".join(("" if take.glued else " ").join(own) for own in each if sum(map(len, own)) > take.least))
        for node in nodes[:1]:
            for name in take.attributes:
                if value := squeezed(node.attrs.get(name, "")):
                    return value
            return self.text(node, take.glued, inner) if take.text else ""
        return ""

    def _field(self, chain: Chain, found: dict[str, list[Node]], scripts: list[str], inner: bool = False) -> str:
        last = ""
        for take in chain.takes:
            if take.selector == LINKED_DATA:
                value, there, size = squeezed(next(linked_data_dates(scripts), "")), False, chain.least + 1
            else:
                nodes = found[take.selector]
                value, there = self._value(take, nodes, inner), bool(nodes)
                size = self.letters(nodes[0], inner) if chain.letters and there else len(value)
            last = value if there or value else last
            if value and size > chain.least and not any(x in value.lower() for x in chain.refused):
                return value
            if chain.by_node and there:
                break
        if chain.otherwise:
            return self._value(chain.otherwise, found[chain.otherwise.selector], inner)
        return last if chain.keep_last or chain.by_node else ""

    def article(self, html: str | None) -> tuple[str, str, str | None, list[str]]:
        """(title, published_raw, body_raw, topics); the body is null where rules need one that isn't there."""
        return self.article_of(*parse(html, keep_noise=True))

    def article_of(self, root: Node, scripts: list[str]) -> tuple[str, str, str | None, list[str]]:
        """``article`` of a page that is parsed, noise and all; the tree stays as it is, so other rules may read it."""
        found, rules = self.found(root), self.rules
        body = self._field(rules.body, found, scripts, inner=True)
        if rules.needs_body and not any(found[t.selector] for t in rules.body.takes):
            body = None
        low, high = rules.topic_lengths
        topics = sorted({t for take in rules.topics for n in found[take.selector] if low <= len(t := self.text(n)) <= high})
        return self._field(rules.title, found, scripts), self._field(rules.published, found, scripts), body, topics


#: Pages whose articles are held at a time.
PAGES = 128
ARTICLE = "title string, published_raw string, body_raw string, topics array<string>"


def extract_by_source(pages: DataFrame, source: Column | str, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = (), rules: dict[str, Rules] | None = None) -> DataFrame:
    """(key, source, title, published_raw, body_raw, topics, ..) of each page by the rules of its source; columns to
    ``keep`` come along. Where ``source`` is an array, a page is parsed once and gives a row for each of its sources.

    Pages of a source without rules fall away, and so do those that have no body where rules need one. A null page has
    empty fields; a page that can't be read to its end gives what comes before.
    """
    arrow_batches(pages.sparkSession)
    known = RULES if rules is None else rules
    source = F.col(source) if isinstance(source, str) else source
    rows = pages.select(F.col(key), source.alias("source"), F.col(html), *keep)
    if isinstance(rows.schema["source"].dataType, T.ArrayType):
        rows = rows.withColumn("source", F.filter("source", lambda s: s.isin(*known))).where(F.size("source") > 0)
    else:
        rows = rows.where(F.col("source").isin(*known)).withColumn("source", F.array("source"))
    fields = T._parse_datatype_string(ARTICLE).fields
    schema = T.StructType([rows.schema[key], T.StructField("source", T.StringType()), *fields, *rows.schema.fields[3:]])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {name: Compiled(own) for name, own in known.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                some = batch.slice(start, PAGES)
                at, of, found = [], [], []
                for i, (sources, page) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist())):
                    parsed = parse(page, keep_noise=True)
                    for name in sources:
                        at.append(i)
                        of.append(name)
                        found.append(compiled[name].article_of(*parsed))
                columns = [pa.array(c, t) for c, t in zip(list(zip(*found)), kinds)]
                key_column, *kept = [some.column(i).take(pa.array(at)) for i in (0, *range(3, some.num_columns))]
                yield pa.RecordBatch.from_arrays([key_column, pa.array(of, pa.string()), *columns, *kept], names=schema.names).filter(pc.is_valid(columns[2]))

    return rows.mapInArrow(run, schema)
