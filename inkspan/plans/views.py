"""The master table and its views: by chunk, by document, and weighted so that each document counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions.dates import coerce_date, quarter_label
from ..functions.tags import normalize_tags, primary_tag
from ..functions.taxonomy import DEFAULT, Taxonomy
from ..functions.text import fallback_id
from ..operators.joins import union_all



def no_signals() -> Column:
    return F.struct(*[F.array().cast("array<string>").alias(f) for f in S.FIELDS])


def normalized(df: DataFrame, text: str, source: str | None = None, signals: str | None = "fraud_signals") -> DataFrame:
    """One source in the master's columns: doc_id, chunk_id, source, date, url, text, fraud_tags, signals, names.

    Signals are an object of lists, a list of names, text that holds either, or a VARIANT whose rows are any of these.
    """
    has = set(df.columns)
    own = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    kind = dict(df.dtypes).get(signals, "") if signals else ""
    if kind == "variant":
        df = df.withColumn(signals, S.opened(signals))
    return df.select(
        own("doc_id", "string").alias("doc_id"), own("chunk_id", "int").alias("chunk_id"), (F.lit(source) if source else own("source", "string")).alias("source"),
        coerce_date(F.coalesce(*[own(c, "string") for c in ("date", "published", "published_raw")])).alias("date"), own("url", "string").alias("url"), F.col(text).alias("text"),
        normalize_tags(own("fraud_tags", "array<string>")).alias("fraud_tags"),
        (F.col(signals) if kind.startswith("struct") else S.variant_signals(signals) if kind == "variant" else S.parse_signals(signals) if kind == "string" else no_signals()).alias("signals"),
        (F.col(signals) if kind.startswith("array") else S.variant_names(signals) if kind == "variant" else S.parse_names(signals) if kind == "string" else F.array().cast("array<string>")).alias("keyword_signals"),
    )


def master(rows: DataFrame, taxonomy: Taxonomy = DEFAULT, least: int = 20) -> DataFrame:
    """Adds year, month, quarter, flags, counts, chunk_weight and primary_tag to normalised rows.

    Texts of ``least`` characters or fewer fall away. Ids that are missing are made of what the row holds.
    """
    out = rows.where(F.length(F.trim("text")) > least)
    out = out.withColumns({"doc_id": F.coalesce("doc_id", fallback_id("source", "url", "text")), "chunk_id": F.coalesce("chunk_id", F.lit(0))})
    out = out.withColumns({
        "year": F.year("date"), "month": F.month("date"), "quarter": quarter_label("date"),
        **{flag: S.has("signals", f) for flag, f in S.FLAGS.items()},
        "signal_count": S.signal_count("signals") + F.size("keyword_signals"), "text_length": F.length("text"), "tag_count": F.size("fraud_tags"),
        "primary_tag": primary_tag("text", "fraud_tags", taxonomy),
    })
    return with_weights(out)


def with_weights(df: DataFrame) -> DataFrame:
    """chunk_weight: 1 / the number of the document's rows, so a document's weights sum to 1."""
    return df.withColumn("chunk_weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("doc_id")))


def documents(df: DataFrame, taxonomy: Taxonomy = DEFAULT, keep_undated: bool = True, first_chunk_only: bool = False) -> DataFrame:
    """One row a document, by one aggregation: lengths summed, flags joined by or, tags in order of first sight,
    signals united, text of all chunks in order (or of the first alone)."""
    rows = df if keep_undated else df.where("date is not null")
    entry = F.sort_array(F.collect_list(F.struct("chunk_id", "text", "fraud_tags", "signals", "keyword_signals")))
    out = rows.groupBy("doc_id", "source", "date", "year", "month", "quarter").agg(F.sum("text_length").cast("long").alias("text_length"), *[F.bool_or(f).alias(f) for f in S.FLAGS], entry.alias("_chunks"), F.min("url").alias("url"))
    empty = F.array().cast("array<string>")
    tags = F.aggregate("_chunks", empty, lambda acc, x: F.array_union(acc, x["fraud_tags"]))
    texts = F.transform("_chunks", lambda c: c["text"])

    def united_field(name: str) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(F.transform("_chunks", lambda c: F.coalesce(c["signals"][name], empty)))))

    united = F.struct(*[united_field(f).alias(f) for f in S.FIELDS])
    names = F.sort_array(F.array_distinct(F.flatten(F.transform("_chunks", lambda c: F.coalesce(c["keyword_signals"], empty)))))
    out = out.withColumns({"fraud_tags": tags, "signals": united, "keyword_signals": names, "num_chunks": F.size("_chunks"), "text": F.get(texts, F.lit(0)) if first_chunk_only else F.array_join(texts, " ")}).drop("_chunks")
    return out.withColumns({"tag_count": F.size("fraud_tags"), "signal_count": S.signal_count("signals") + F.size("keyword_signals"), "primary_tag": primary_tag("text", "fraud_tags", taxonomy)})


def with_bodies(df: DataFrame, wide: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Adds body_1..N of all sources' wide tables by ``key``. Tables are united by name, so none loses a column to
    another, and a key that two have keeps the first that isn't null of each column."""
    bodies = [w.select(key, *[c for c in w.columns if c.startswith("body_") and c[5:].isdigit()]) for w in wide]
    every = union_all(bodies)
    names = sorted((c for c in every.columns if c != key), key=lambda c: int(c[5:]))
    once = every.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    return df.join(once, key, "left")


def tag_rows(view: DataFrame, others: bool = False) -> DataFrame:
    """A row for each tag; null, blank and (unless wanted) 'other' tags fall away."""
    out = view.withColumn("fraud_tag", F.explode("fraud_tags")).where("fraud_tag is not null and fraud_tag <> ''")
    return out if others else out.where("fraud_tag <> 'other'")
