"""Text of printed files: pages by an extractor of the caller's, thin pages by another, both over Arrow batches.

Neither a PDF library nor OCR is assumed. An extractor takes a file's bytes and returns its pages' texts; an optical
one takes the bytes and a page's place and returns that page's text. What either raises is the file's error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_document, clean_page, needs_ocr, normalize_layout
from ..operators.chunks import assemble_pages

Extractor = Callable[[bytes], list[str]]
Optical = Callable[[bytes, int], str]

_PAGES = "array<struct<page_num:int,method:string,text:string>>"
_PAGES_TYPE = pa.list_(pa.struct([("page_num", pa.int32()), ("method", pa.string()), ("text", pa.string())]))
#: What a page is parted by in the files that ``form_feeds`` reads.
FORM_FEED = "\f"


def form_feeds(content: bytes) -> list[str]:
    """Pages of text files as print spoolers write them: parted by form feeds."""
    return content.decode("utf-8", "replace").split(FORM_FEED)


def thin(text: str) -> bool:
    """``functions.text.needs_ocr`` of one page, for use beside an extractor."""
    return len(text.strip()) < 80 or sum(c.isalpha() for c in text) / max(len(text), 1) < 0.45


def with_pages(files: DataFrame, extract: Extractor = form_feeds, optical: Optical | None = None, content: str = "content") -> DataFrame:
    """The files with ``pages`` and ``error`` in place of their content; a file that can't be read has no pages.

    Pages that are too thin to be their own text are read by ``optical``, where it is given, and marked 'ocr'.
    """
    others = [c for c in files.columns if c != content]

    def pages_of(data: bytes | None) -> tuple[list[dict] | None, str | None]:
        try:
            out = []
            for i, text in enumerate(extract(data or b"")):
                ocr = optical is not None and thin(text)
                out.append({"page_num": i + 1, "method": "ocr" if ocr else "native", "text": optical(data or b"", i) if ocr else text})
            return out, None
        except Exception as error:  # whatever a library raises belongs to its file
            return [], f"{type(error).__name__}: {error}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pages_of(x) for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], _PAGES_TYPE), pa.array([f[1] for f in found], pa.string())], names=[*others, "pages", "error"])

    rows = files.select(*others, content)
    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], f"pages {_PAGES}", "error string"]))


def full_text(files: DataFrame, pages: str = "pages") -> DataFrame:
    """Adds full_text, full_text_clean, page_count, ocr_pages, ocr_wanted and extraction_method of cleaned pages.

    Each page is cleaned by itself, empty ones fall away, and the whole is cleaned again from its title on.
    """
    cleaned = F.transform(pages, lambda p: F.struct(p["page_num"].alias("page_num"), p["method"].alias("method"), clean_page(p["text"]).alias("text")))
    thin_pages = F.transform(F.filter(pages, lambda p: needs_ocr(normalize_layout(p["text"]))), lambda p: p["page_num"])
    out = assemble_pages(files.withColumns({"ocr_wanted": thin_pages, pages: cleaned}), pages)
    whole = normalize_layout("full_text")
    out = out.withColumns({"full_text": whole, "full_text_clean": clean_document(whole)})
    return out.withColumn("extraction_method", _method(out))


def _method(out: DataFrame) -> Column:
    failed = F.col("error").isNotNull() if "error" in out.columns else F.lit(False)
    return F.when(failed, F.lit("failed")).otherwise(F.lit("native_plus_ocr_fallback"))


def text_summary(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Lengths, method and page counts by file."""
    return texts.select(*keys, F.length("full_text").alias("text_length_raw"), F.length("full_text_clean").alias("text_length_clean"), F.col("extraction_method").alias("method"), "ocr_pages", "page_count")
