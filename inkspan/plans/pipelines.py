"""From raw articles to tagged documents, source by source, and the runs that do it."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import to_utc
from ..functions.signals import indicators
from ..functions.tags import pattern_tags
from ..functions.taxonomy import DEFAULT, EARLIER, Taxonomy
from ..functions.text import joined, normalize_space, shortened, stable_id, strip_boilerplate
from ..operators.chunks import chunk_rows, chunk_summary, documents_of_chunks, tag_chunks
from ..operators.dedup import keep_first_chain
from ..sources import releases, writers
from ..sources.printed import Extractor, Optical, form_feeds, full_text, text_summary, with_pages
from ..sources.readers import exists, missing_files
from ..sources.rules import RULES, Rules, extract_by_source
from .analytics import analyses_of, tag_cube
from .views import documents, master


@dataclass(frozen=True)
class Source:
    """How one source's articles are treated. ``tag_text`` and ``signal_text`` name the columns that are looked at;
    ``unique`` are the keys that one row each is kept of, in turn; ``longer_than`` drops short bodies; ``rules`` say how
    a page is read."""

    name: str
    boilerplate: str | None = None
    tag_text: tuple[str, ...] = ("title", "body_1")
    signal_text: tuple[str, ...] = ("body_1",)
    unique: tuple[str, ...] = ("url",)
    longer_than: int = 0
    chunked: bool = False
    fallback: bool = True
    taxonomy: Taxonomy = DEFAULT
    ordered: bool = True
    rules: Rules | None = None


SOURCES = {s.name: replace(s, rules=RULES[s.name]) for s in (
    Source("agency_blog", "agency_blog"),
    Source("payments_news", signal_text=("title", "body_1"), unique=("url", "title"), longer_than=50),
    Source("vendor_blog", tag_text=("body_1",), longer_than=50),
    Source("security_news", "security_news"),
    Source("complaint_center", "complaint_center", chunked=True),
    # On the earlier edition, whose tags of a document stand in the taxonomy's order.
    Source("bureau_news", "bureau_news", chunked=True, fallback=False, taxonomy=EARLIER, ordered=False),
)}


def articles_of_pages(pages: DataFrame, source: Source) -> DataFrame:
    """(url, title, published_raw, body_raw, topics) of stored pages (url, html) by the source's rules. A listing's
    ``published_raw``, where the pages bring one along, goes before or after the page's own as the rules say."""
    listed = ("published_raw",) if "published_raw" in pages.columns else ()
    rows = pages.withColumnsRenamed({c: f"listed_{c}" for c in listed})
    out = extract_by_source(rows, F.lit(source.name), "url", keep=tuple(f"listed_{c}" for c in listed), rules={source.name: source.rules})
    dates = [F.nullif(F.trim(c), F.lit("")) for c in ("published_raw", *[f"listed_{c}" for c in listed])]
    if source.rules.listed_date_first:
        dates.reverse()
    return out.select("url", "title", F.coalesce(*dates, F.lit("")).alias("published_raw"), "body_raw", "topics")


def articles_to_documents(articles: DataFrame, source: Source) -> DataFrame:
    """Cleaned, dated, identified, deduplicated and tagged; the first of equals is the earliest published."""
    if articles.isEmpty():
        raise ValueError(f"{source.name}: no articles to work on")
    body = strip_boilerplate("body_raw", source.boilerplate) if source.boilerplate else normalize_space("body_raw")
    out = articles.withColumns({"title": normalize_space("title"), "body_1": body, "date": to_utc("published_raw"), "source": F.lit(source.name)})
    out = out.withColumn("doc_id", F.coalesce("doc_id", stable_id("url")) if "doc_id" in articles.columns else stable_id("url"))
    if source.longer_than:
        out = out.where(F.length(F.trim("body_1")) > source.longer_than)
    order = [F.col("date").isNull().cast("int"), F.coalesce(F.col("date").cast("string"), F.lit("")), F.xxhash64("title", "body_1")]
    out = keep_first_chain(out, [[k] for k in source.unique], order)
    out = out.withColumns({
        "published_year": F.year("date"), "published_month": F.month("date"), "body_short": shortened("body_1"), "body_length": F.length("body_1"),
        "fraud_tags": pattern_tags(joined(*source.tag_text), source.taxonomy, ordered=source.ordered), "fraud_signals": indicators(joined(*source.signal_text)),
    })
    return out.select("doc_id", "date", "published_year", "published_month", "source", "fraud_tags", "fraud_signals", "title", "body_1", "body_short", "body_length", "url")


def documents_to_chunked(documents: DataFrame, source: Source) -> DataFrame:
    """The chunked form: tags and keyword signals by chunk, joined up by document in order of first sight."""
    chunks = chunk_rows(documents, "body_1", ["doc_id", "title", "source", "date", "url"])
    tagged = tag_chunks(chunks, source.taxonomy, source.fallback)
    return documents_of_chunks(tagged, ["doc_id", "title", "source", "date", "url"])


def run_source(articles: DataFrame, source: Source) -> DataFrame:
    out = articles_to_documents(articles, source)
    return documents_to_chunked(out, source) if source.chunked else out


def notices(files: DataFrame, listing: DataFrame, extract: Extractor = form_feeds, optical: Optical | None = None, taxonomy: Taxonomy = DEFAULT) -> dict[str, DataFrame]:
    """The pipeline of printed notices, from downloaded files to tagged documents.

    ``listing`` are publications (notice_id, title, doc_type, date, local_pdf_path, ..), ``files`` what lies in the
    download folder (path, content). Tables: ``missing`` (listed, not downloaded), ``texts``, ``text_summary``,
    ``chunks``, ``chunk_summary``, ``tagged`` and ``documents``, whose id is the notice's own.
    """
    keys = ["notice_id", "title", "doc_type", "date"]
    here = files.select(F.regexp_replace("path", "^file:/+", "/").alias("local_pdf_path"), "content")
    texts = full_text(with_pages(listing.join(here, "local_pdf_path"), extract, optical))
    rows = texts.select(F.col("notice_id").alias("doc_id"), "title", "doc_type", F.lit("notices").alias("source"), "date", F.col("pdf_url").alias("url"), "full_text_clean")
    chunked = chunk_rows(rows, "full_text_clean", ["doc_id", "title", "doc_type", "source", "date", "url"])
    tagged = tag_chunks(chunked, taxonomy)
    return {
        "missing": missing_files(listing, here.select(F.col("local_pdf_path").alias("path"))), "texts": texts, "text_summary": text_summary(texts, keys), "chunks": chunked,
        "chunk_summary": chunk_summary(chunked, ["doc_id", "title", "doc_type", "date"]), "tagged": tagged, "documents": documents_of_chunks(tagged, ["doc_id", "title", "doc_type", "source", "date", "url"]),
    }


def export_run(rows: DataFrame, directory: str, taxonomy: Taxonomy = DEFAULT, include_body: bool = False) -> dict[str, DataFrame]:
    """Both views of normalised rows analysed and published together: for each its cube, the three exports and the
    primary tags, and the flat master. Returns the results by 'docs' and 'weighted' name.

    The master is written once and read once for each view's cube, from which all analyses come. ``releases.current``
    gives the path of what was published last; a run that fails changes nothing of it.
    """
    spark = rows.sparkSession
    results, outputs = {}, {"master": lambda path: master(rows, taxonomy).write.parquet(path)}

    def whole(path: str) -> DataFrame:
        return spark.read.parquet(f"{path.rsplit('/', 1)[0]}/master")

    def add(suffix: str, weight: str | None) -> None:
        def cube(path: str) -> None:
            view = documents(whole(path), taxonomy) if weight is None else whole(path)
            tag_cube(view, weight).write.parquet(path)
            results.update({f"{name}_{suffix}": df for name, df in analyses_of(spark.read.parquet(path)).items()})

        outputs[f"cube_{suffix}"] = cube
        for name in (*writers.VIEW_EXPORTS, "primary_tag_distribution"):
            outputs[f"{name}_{suffix}"] = lambda path, of=f"{name}_{suffix}": writers.csv(results[of], path)

    add("docs", None)
    add("weighted", "chunk_weight")
    outputs["master_docs"] = lambda path: writers.csv(writers.flat_master(documents(whole(path), taxonomy), include_body), path)
    releases.publish(spark, directory, outputs)
    return results


def publications(parts: list[DataFrame]) -> DataFrame:
    """Union of listings of notices without repeats, by real date, undated last."""
    from ..functions.dates import us_date
    from ..operators.joins import union_distinct

    out = union_distinct(parts)
    key = F.try_to_timestamp(us_date("date"), F.lit("MM/dd/yyyy"))
    return out.orderBy(key.desc_nulls_last(), *[F.col(c) for c in out.columns[:1]])


@dataclass
class Step:
    """One run of a pipeline: what it makes, where, whether it is on, and after how many seconds it counts as late."""

    name: str
    make: Callable[[SparkSession], DataFrame]
    output: str
    enabled: bool = True
    timeout: float = 1800.0
    after: tuple[str, ...] = field(default_factory=tuple)


STATUS = "name string, status string, seconds double, error string"


def run_steps(spark: SparkSession, steps: list[Step], force: bool = False) -> DataFrame:
    """Runs steps in order and returns their status: done, skipped (output there), off, failed, late or blocked.

    A step writes its output whole or not at all. One that is not done in its time is late: its jobs are cancelled.
    A step that fails or is late doesn't stop others, except those that come after it.
    """
    status, bad = [], set()
    for step in steps:
        began, error = time.time(), None
        if not step.enabled:
            state = "off"
        elif not force and exists(spark, f"{step.output}/_SUCCESS"):
            state = "skipped"
        elif bad & set(step.after):
            state = "blocked"
        else:
            state, error = _in_time(spark, step)
        if state in ("failed", "late", "blocked"):
            bad.add(step.name)
        status.append((step.name, state, round(time.time() - began, 3), error))
    return spark.createDataFrame(status, STATUS)


def _in_time(spark: SparkSession, step: Step) -> tuple[str, str | None]:
    tag, late = f"inkspan-{step.name}-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(step.timeout, stop)
    timer.daemon = True
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        rows = step.make(spark)
        if late.is_set():
            raise TimeoutError(f"late after {step.timeout} s")
        rows.write.mode("overwrite").parquet(step.output)
        return ("late", f"late after {step.timeout} s") if late.is_set() and not exists(spark, f"{step.output}/_SUCCESS") else ("done", None)
    except Exception as e:  # reported as the step's status
        return ("late", f"late after {step.timeout} s") if late.is_set() else ("failed", str(e)[-300:])
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def ready(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """(name, enabled, ready): which outputs are there."""
    return spark.createDataFrame([(s.name, s.enabled, exists(spark, f"{s.output}/_SUCCESS")) for s in steps], "name string, enabled boolean, ready boolean")
