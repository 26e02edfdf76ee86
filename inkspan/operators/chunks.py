"""Chunking of long texts, and the forms that chunks take: rows, summaries, wide documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import keyword_signals, keyword_tags
from ..functions.taxonomy import DEFAULT, OTHER, Taxonomy
from ..functions.text import drop_reference_numbers

SIZE, OVERLAP, LEAST = 1200, 200, 150


def chunk_array(text: Column | str, size: int = SIZE, overlap: int = OVERLAP, longer_than: int = LEAST) -> Column:
    """Trimmed windows of ``size`` code points that overlap; those not longer than ``longer_than`` fall away."""
    if size <= overlap:
        raise ValueError("chunk size must exceed the overlap")
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda p: F.trim(F.substring(text, p + 1, F.lit(size)))), lambda c: F.length(c) > longer_than)


def chunk_rows(df: DataFrame, text: str, keep: Iterable[str], size: int = SIZE, overlap: int = OVERLAP, longer_than: int = LEAST, clean: bool = True) -> DataFrame:
    """One row a chunk: ``keep``, chunk_id counted after short ones fell away, chunk_text, chunk_length."""
    body = drop_reference_numbers(text) if clean else F.col(text)
    rows = df.select(*keep, body.alias("_body")).where(F.length(F.trim("_body")) > 0)
    out = rows.select(*keep, F.posexplode(chunk_array("_body", size, overlap, longer_than)).alias("chunk_id", "chunk_text"))
    return out.withColumn("chunk_length", F.length("chunk_text"))


def tag_chunks(chunks: DataFrame, taxonomy: Taxonomy = DEFAULT, fallback: bool = True) -> DataFrame:
    out = chunks.withColumns({"fraud_tags": keyword_tags("chunk_text", taxonomy, fallback), "fraud_signals": keyword_signals("chunk_text", taxonomy)})
    return out.withColumn("fraud_signal_count", F.size("fraud_signals"))


def chunk_summary(chunks: DataFrame, keys: Iterable[str]) -> DataFrame:
    n = F.col("chunk_length")
    return chunks.groupBy(*keys).agg(F.count("*").alias("total_chunks"), F.avg(n).alias("avg_chunk_length"), F.min(n).alias("min_chunk_length"), F.max(n).alias("max_chunk_length"))


def ordered_union(entries: Column, field: str) -> Column:
    """Union of the arrays in a sorted list of structs, in order of first sight."""
    return F.aggregate(entries, F.array().cast("array<string>"), lambda acc, x: F.array_union(acc, x[field]))


def documents_of_chunks(tagged: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row a document: ``chunks`` in order, num_chunks, tags and signals in order of first sight.

    A document's chunks are bounded by its text, so they may be gathered.
    """
    entry = F.struct("chunk_id", F.col("chunk_text").alias("text"), F.col("fraud_tags").alias("tags"), F.col("fraud_signals").alias("signals"))
    rows = tagged.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("chunks"))
    tags = ordered_union(F.col("chunks"), "tags")
    return rows.withColumns({"num_chunks": F.size("chunks"), "fraud_tags": F.when(F.size(tags) == 0, F.array(F.lit(OTHER))).otherwise(tags), "fraud_signals": ordered_union(F.col("chunks"), "signals")})


def wide(documents: DataFrame, columns: int) -> DataFrame:
    """body_1..N and fraud_tags_1..N beside the rest, for exports that need them; N is the caller's."""
    out = documents
    for k in range(columns):
        entry = F.get("chunks", F.lit(k))
        out = out.withColumns({f"body_{k + 1}": entry["text"], f"fraud_tags_{k + 1}": entry["tags"]})
    return out.drop("chunks")


def tag_distribution(tagged: DataFrame, by: Iterable[str] = (), top: int | None = None) -> DataFrame:
    """Chunks by tag, also by ``by``; most first, ties by name."""
    keys = [*by, "fraud_tag"]
    out = tagged.select(*by, F.explode("fraud_tags").alias("fraud_tag")).groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys)
    return out.limit(top) if top else out


def assemble_pages(df: DataFrame, pages: str = "pages") -> DataFrame:
    """full_text of non-empty pages in order, page_count and ocr_pages of array<struct<page_num, method, text>>."""
    ordered = F.sort_array(pages)
    texts = F.filter(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: F.length(F.trim(t)) > 0)
    return df.withColumns({"full_text": F.array_join(texts, "\n\n"), "page_count": F.size(pages), "ocr_pages": F.size(F.filter(pages, lambda p: p["method"] == "ocr"))})
