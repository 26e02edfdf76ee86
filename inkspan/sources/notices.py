"""Publications of notices: rows of listing tables, detail pages, and the union of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import leading_year, page_date, us_date, year_in
from ..functions.text import absolute_url, first_of, looks_spanish, needs_ocr, normalize_space, notice_id
from ..operators.chunks import assemble_pages
from ..operators.dedup import prefer_language
from .html import extract_tables, first_pdf, heading, strip_tags

#: Years of each kind of notice that are wanted.
YEARS = {"Advisory": range(2020, 2027), "Alert": range(2022, 2027), "Notice": range(2022, 2027)}


def from_tables(pages: DataFrame, doc_type: str, base: str, key: str = "page_id") -> DataFrame:
    """Rows of listing tables that name a notice of a wanted year: notice_id, title, doc_type, date, pdf_url.

    The id is sought in the row's text, then in its links; of one notice's rows the English, earliest one stays.
    """
    rows = extract_tables(pages, key)
    text, links = F.array_join("cells", " "), F.array_join("links", " ")
    out = rows.withColumns({"text": normalize_space(text), "notice_id": notice_id(text, links), "link": F.get(F.filter("links", lambda x: x != ""), F.lit(0))})
    out = out.where("notice_id is not null").withColumn("year", year_in("notice_id")).where(F.col("year").isin(list(YEARS[doc_type])))
    out = out.select("notice_id", F.get("cells", F.size("cells") - 1).alias("title"), F.lit(doc_type).alias("doc_type"), us_date(page_date("text")).alias("date"), absolute_url("link", base).alias("pdf_url"), looks_spanish("text").alias("_es"))
    return prefer_language(out.distinct(), "notice_id", "_es", "date").drop("_es")


def from_details(pages: DataFrame, anchors: DataFrame | None = None, doc_type: str = "Advisory", key: str = "page_id") -> DataFrame:
    """A notice of each detail page: id from its text, its anchor or its url; year, first date, first PDF.

    ``anchors`` may give (url, title_hint) of the links that led there.
    """
    hints = pages.select(key, "url", "html", F.lit("").alias("hint")) if anchors is None else pages.select(key, "url", "html").join(anchors.select("url", F.col("title_hint").alias("hint")).dropDuplicates(["url"]), "url", "left")
    text = strip_tags("html")
    number = notice_id(text, F.coalesce("hint", F.lit("")), F.col("url"))
    out = hints.withColumns({"notice_id": number, "title": first_of(heading("html"), F.coalesce("hint", F.lit(""))), "date": us_date(page_date(text)), "pdf_url": first_pdf("html")})
    out = out.withColumn("year", F.coalesce(leading_year(F.regexp_extract("notice_id", r"(\d{4})", 1)), year_in("date")))
    return out.where(F.col("year").isin(list(YEARS[doc_type]))).select("notice_id", "title", F.lit(doc_type).alias("doc_type"), "date", F.col("url").alias("source_page"), "pdf_url")


def with_page_decisions(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """Documents of page texts with ocr_wanted: the numbers of pages whose own text is too thin, and the full text."""
    wanted = F.transform(F.filter(pages, lambda p: needs_ocr(p["text"])), lambda p: p["page_num"])
    return assemble_pages(documents, pages).withColumn("ocr_wanted", wanted)
