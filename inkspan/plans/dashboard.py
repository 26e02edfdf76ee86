"""Period-over-period analyses behind a dashboard. ``as_of`` stands for now, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import period_end
from ..functions.text import title_case
from .analytics import _amount

SHOWN = {"W": 10, "M": 12, "Q": 8, "Y": 999}


def loaded(df: DataFrame, as_of: Column, date: str = "date") -> DataFrame:
    """Rows up to ``as_of``; tags titled, 'Uncategorized' if there is none; sources in capitals."""
    return df.withColumn("date", F.to_timestamp(date)).where(F.col("date") <= as_of).withColumns({"primary_tag": title_case(F.coalesce("primary_tag", F.lit("Uncategorized"))), "source": F.upper(F.trim("source"))})


def chosen(df: DataFrame, sources: list | None = None, tags: list | None = None, source: str = "source", tag: str = "primary_tag") -> DataFrame:
    """Only these sources and tags; without tags all but 'Other'."""
    out = df.where(F.col(source).isin(sources)) if sources is not None else df
    return out.where(F.col(tag).isin(tags)) if tags is not None else out.where(F.lower(tag) != "other")


def periods(df: DataFrame, interval: str, date: str = "date") -> DataFrame:
    return df.where(F.col(date).isNotNull()).withColumn("period", period_end(date, interval))


def volume_trend(df: DataFrame, interval: str, as_of: Column, tag: str = "primary_tag", date: str = "date", shown: int | None = None, compat: bool = False, weight: str | None = None) -> DataFrame:
    """(period, tag, count) of the last periods that are over and not empty.

    ``compat`` keeps only rows dated from the first period's last day to the last one's, as dashboards that compare
    dates with period ends do; else whole periods count.
    """
    rows = periods(df, interval, date).where(F.col("period") <= F.to_date(as_of))
    last = rows.select("period").distinct().orderBy(F.desc("period")).limit(shown or SHOWN[interval])
    if compat:
        ends = last.agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
        kept = rows.join(F.broadcast(ends), F.to_date(date).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    else:
        kept = rows.join(F.broadcast(last), "period", "left_semi")
    return kept.groupBy("period", tag).agg(_amount(weight).alias("count")).orderBy("period", tag)


def filled_trend(df: DataFrame, interval: str, date: str = "date", weight: str | None = None) -> DataFrame:
    """(period, count) from the first period to the last, empty ones 0."""
    counts = periods(df, interval, date).groupBy("period").agg(_amount(weight).alias("count"))
    step = {"W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}[interval]
    ends = counts.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null")
    months = ends.select(F.explode(F.sequence(F.col("a") if interval == "W" else F.trunc("a", "month"), "b", F.expr(step))).alias("d"))
    spine = months.select(period_end("d", interval).alias("period"))
    return spine.join(counts, "period", "left").na.fill(0, ["count"]).orderBy("period")


def period_change(df: DataFrame, interval: str, tag: str = "primary_tag", date: str = "date", weight: str | None = None) -> DataFrame:
    """(tag, previous, current, delta, pct): the last full period against the one before; a previous 0 divides as 1.

    Of three periods or more the last is still open, so the second and third last are compared; of two, both. Periods
    are ranked in one task and broadcast: there are as many as weeks, months, quarters or years, whatever the rows.
    """
    counts = periods(df, interval, date).groupBy("period", tag).agg(_amount(weight).alias("n"))
    steps = counts.select("period").distinct().withColumns({"place": F.row_number().over(Window.orderBy(F.desc("period"))), "all": F.count("*").over(Window.partitionBy())})
    skip = F.when(F.col("all") >= 3, 1).otherwise(0)
    ranked = counts.join(F.broadcast(steps.select("period", (F.col("place") - skip).alias("rank"))), "period")
    out = ranked.groupBy(tag).agg(F.coalesce(F.sum(F.when(F.col("rank") == 2, F.col("n"))), F.lit(0)).alias("previous"), F.coalesce(F.sum(F.when(F.col("rank") == 1, F.col("n"))), F.lit(0)).alias("current"))
    return _with_change(out, tag)


def year_to_date(df: DataFrame, tag: str = "primary_tag", date: str = "date", weight: str | None = None) -> DataFrame:
    """(tag, previous, current, delta, pct): the latest date's year against the one before, both up to its day of the
    year; only tags that the current year has."""
    # Counts by tag and day first, so that days meet the latest one, not rows; that one is read of the dates alone.
    days = df.groupBy(tag, F.to_date(date).alias("_day")).agg(_amount(weight).alias("_n"))
    last = days.agg(F.max("_day").alias("_last"))
    rows = days.join(F.broadcast(last)).where(F.dayofyear("_day") <= F.dayofyear("_last"))
    back = F.year("_last") - F.year("_day")
    amount = lambda years: F.coalesce(F.sum(F.when(back == years, F.col("_n"))), F.lit(0)).alias("previous" if years else "current")
    return _with_change(rows.groupBy(tag).agg(amount(1), amount(0)).where("current > 0"), tag)


def _with_change(df: DataFrame, tag: str) -> DataFrame:
    delta = F.col("current") - F.col("previous")
    return df.withColumns({"delta": delta, "pct": F.bround(delta.cast("double") / F.greatest("previous", F.when(F.col("previous") == 0, 1).otherwise(F.col("previous"))) * 100, 1)}).orderBy(tag)


def counts_of(df: DataFrame, column: str, top: int | None = None, weight: str | None = None) -> DataFrame:
    out = df.groupBy(column).agg(_amount(weight).alias("count")).orderBy(F.desc("count"), column)
    return out.limit(top) if top else out


def narrative_themes(df: DataFrame, text: str, stopwords: list[str], top: int = 50, fold_plurals: bool = False) -> DataFrame:
    """(word, count) of the commonest words of two letters or more outside the stopwords; possessives count as the
    word, figures don't. With ``fold_plurals`` a word with an s more than another of the vocabulary counts as that
    other: one more aggregate, over the vocabulary by stem."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"['’]s\b", ""), F.lit(r"[\p{L}]{2,}"), F.lit(0))
    rows = df.select(F.explode(words).alias("word"))
    counts = rows.where(~F.col("word").isin(stopwords)).groupBy("word").agg(F.count("*").alias("count"))
    if fold_plurals:
        plural = F.col("word").endswith("s") & ~F.col("word").endswith("ss")
        stems = counts.withColumn("stem", F.when(plural, F.expr("left(word, length(word) - 1)")).otherwise(F.col("word")))
        both = stems.groupBy("stem").agg(F.sum("count").alias("count"), F.min("word").alias("word"))  # the singular sorts first
        counts = both.select("word", "count")
    return counts.orderBy(F.desc("count"), "word").limit(top)


def matrix_with_total(df: DataFrame, row: str, column: str, values: list, weight: str | None = None) -> DataFrame:
    """Counts by row and column values with their total, largest first."""
    out = df.where(F.col(column).isin(values)).groupBy(row).pivot(column, values).agg(_amount(weight)).na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return out.withColumn("total", total).orderBy(F.desc("total"), row)


def source_audit(df: DataFrame, source: str = "source", date: str = "date", weight: str | None = None, last: str | None = None) -> DataFrame:
    """(source, records, first_seen, last_seen); of maintained counts ``date`` and ``last`` are the first and the last
    time of each."""
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return df.groupBy(source).agg(_amount(weight).alias("records"), day(F.min(date)).alias("first_seen"), day(F.max(last or date)).alias("last_seen")).orderBy(source)


def totals(df: DataFrame, source: str = "source", weight: str | None = None) -> DataFrame:
    return df.agg(_amount(weight).alias("leads"), F.countDistinct(source).alias("vendors"))


def of_maintained(counts: DataFrame, as_of: Column, interval: str, top: int | None = None) -> dict[str, DataFrame]:
    """Every panel of the dashboard from counts by day, source and tag (``streaming.aggregates``), none from rows."""
    by_day = counts.withColumnRenamed("day", "date")
    return {
        "volume_trend": volume_trend(by_day, interval, as_of, weight="records"), "filled_trend": filled_trend(by_day, interval, weight="records"),
        "period_change": period_change(by_day, interval, weight="records"), "year_to_date": year_to_date(by_day, weight="records"),
        "top_tags": counts_of(by_day, "primary_tag", top, "records"), "source_audit": source_audit(counts, date="first_seen", weight="records", last="last_seen"),
        "totals": totals(counts, weight="records"),
    }
