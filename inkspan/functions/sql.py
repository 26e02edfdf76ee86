"""The library for those who write SQL: functions and table functions, registered in one call."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .signals import BTC, EMAIL, ETH, IP, PHONE, URL
from .tags import word_pattern
from .taxonomy import DEFAULT, OTHER, Taxonomy


def _constant(argument: AnalyzeArgument, name: str, kind: type):
    if argument.isTable or not argument.isConstantExpression or not isinstance(argument.value, kind):
        raise ValueError(f"{name} must be a constant")
    return argument.value


@udtf
class DocumentChunks:
    """document_chunks(text, size, overlap, longer_than): (chunk_id, chunk_text, chunk_length) of trimmed windows, those
    that aren't longer falling away before they are counted. A null or blank text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, longer_than: AnalyzeArgument) -> AnalyzeResult:
        if _constant(size, "size", int) <= _constant(overlap, "overlap", int):
            raise ValueError("the size must exceed the overlap")
        _constant(longer_than, "longer_than", int)
        return AnalyzeResult(T.StructType().add("chunk_id", T.IntegerType()).add("chunk_text", T.StringType()).add("chunk_length", T.IntegerType()))

    def eval(self, text: str | None, size: int, overlap: int, longer_than: int) -> Iterator[tuple]:
        if text and text.strip(" "):
            chunks = (text[i : i + size].strip(" ") for i in range(0, len(text), size - overlap))
            yield from ((k, c, len(c)) for k, c in enumerate(c for c in chunks if len(c) > longer_than))


@udtf(returnType="url string, title_hint string, position int")
class PageLinks:
    """page_links(html, base[, ended_only]): links that lead on, made absolute, the first of each url in a page."""

    def eval(self, html: str | None, base: str | None, ended_only: bool = False) -> Iterator[tuple]:
        from ..sources.html import links_of

        yield from links_of(html, base, ended_only=ended_only)


@udtf
class TableRows:
    """table_rows(html, 'a,b,..'): a row for each row of each HTML table, its cells in columns of these names, null where
    there are fewer; table_no and row_no before them."""

    def __init__(self) -> None:
        self.width = 0

    @staticmethod
    def analyze(html: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        names = [c.strip() for c in _constant(columns, "columns", str).split(",") if c.strip()]
        if len(set(names)) != len(names) or not names:
            raise ValueError("columns must be different names")
        schema = T.StructType().add("table_no", T.IntegerType()).add("row_no", T.IntegerType())
        for name in names:
            schema = schema.add(name, T.StringType())
        return AnalyzeResult(schema)

    def eval(self, html: str | None, columns: str) -> Iterator[tuple]:
        from ..sources.html import tables_of

        width = len([c for c in columns.split(",") if c.strip()])
        for table, row, cells, _ in tables_of(html):
            yield (table, row, *(cells + [None] * width)[:width])


def _quoted(x: str) -> str:
    return "r'" + x + "'" if "'" not in x else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tags(tests: list[tuple[str, str]]) -> str:
    found = "array_sort(filter(array(" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests) + "), t -> t IS NOT NULL))"
    return f"aggregate(array({found}), array('{OTHER}'), (a, t) -> CASE WHEN size(t) > 0 THEN t ELSE a END)"


def definitions(taxonomy: Taxonomy = DEFAULT) -> dict[str, str]:
    """SQL bodies of functions of one text ``x``, by name: families by whole words and by keywords, and each kind of
    indicator, as sorted lists."""
    low = "lower(coalesce(x, ''))"
    unique = lambda all_of: f"array_sort(array_distinct({all_of}))"
    every = lambda pattern, of="coalesce(x, '')", group=0: f"regexp_extract_all({of}, {_quoted(pattern)}, {group})"
    return {
        "fraud_tags": _tags([(f, f"{low} RLIKE {_quoted(word_pattern(w))}") for f, w in taxonomy.patterns.items()]),
        "keyword_tags": _tags([(f, " OR ".join(f"contains({low}, {_quoted(w.lower())})" for w in words)) for f, words in taxonomy.keywords.items()]),
        "urls_in": unique(every(URL)),
        "emails_in": unique(f"transform({every(EMAIL)}, e -> lower(e))"),
        "phones_in": unique(f"transform({every(PHONE)}, p -> trim(regexp_replace(p, {_quoted(chr(92) + 's+')}, ' ')))"),
        "ip_addresses_in": unique(every(IP)),
        "crypto_wallets_in": unique(f"concat({every(BTC, group=1)}, {every(ETH)})"),
    }


def register(spark: SparkSession, taxonomy: Taxonomy = DEFAULT, prefix: str = "") -> list[str]:
    """Makes the functions known to this session; returns their names. Tags are of ``taxonomy``."""
    tables = {"document_chunks": DocumentChunks, "page_links": PageLinks, "table_rows": TableRows}
    for name, function in tables.items():
        spark.udtf.register(prefix + name, function)
    own = definitions(taxonomy)
    if not re.fullmatch(r"\w*", prefix):
        raise ValueError("a prefix has letters, digits and underscores")
    for name, body in own.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS ARRAY<STRING> RETURN {body}")
    return [prefix + n for n in (*tables, *own)]
