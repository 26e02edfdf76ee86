"""Analyses of a view: distributions, trends, sources, indicators, what rises and what is new.

Every function takes rows with a ``tag`` column (and optionally a weight) and returns a DataFrame in long form, ties
broken by name. Percentages are rounded half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import COMPOUNDS, FLAGS


def _amount(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def percent(part: Column | str, whole: Column, digits: int) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    return F.bround(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def distribution(rows: DataFrame, tag: str = "fraud_tag", weight: str | None = None, digits: int = 1) -> DataFrame:
    """(tag, count, pct), largest first. The total runs over the groups, which are few."""
    counts = rows.groupBy(tag).agg(_amount(weight).alias("count"))
    return counts.withColumn("pct", percent("count", F.sum("count").over(Window.partitionBy()), digits)).orderBy(F.desc("count"), tag)


def _largest(counts: DataFrame, tag: str, top: int | None) -> DataFrame:
    """Of counts by tag and something else those of the ``top`` tags by their sums, ties by name. Its windows run over
    counts, a row for each group, so the rows that were counted are read once."""
    if not top:
        return counts
    summed = counts.where(F.col(tag).isNotNull()).withColumn("_sum", F.sum("count").over(Window.partitionBy(tag)))
    return summed.withColumn("_rank", F.dense_rank().over(Window.orderBy(F.desc("_sum"), tag))).where(F.col("_rank") <= top).drop("_sum", "_rank")


def trend(rows: DataFrame, period: str, tag: str = "fraud_tag", weight: str | None = None, top: int | None = 8) -> DataFrame:
    """(period, tag, count) of the largest tags; rows without a period fall away."""
    counts = rows.where(F.col(period).isNotNull()).groupBy(period, tag).agg(_amount(weight).alias("count"))
    return _largest(counts, tag, top).orderBy(period, tag)


def by_source(rows: DataFrame, source: str = "source", tag: str = "fraud_tag", weight: str | None = None, top: int | None = 8) -> DataFrame:
    """(source, tag, count, share): counts of the largest tags, and their share of the source's row in percent."""
    counts = _largest(rows.groupBy(source, tag).agg(_amount(weight).alias("count")), tag, top)
    return counts.withColumn("share", percent("count", F.sum("count").over(Window.partitionBy(source)), 1)).orderBy(source, tag)


def pivoted(rows: DataFrame, index: str, column: str, values: list, weight: str | None = None) -> DataFrame:
    """Counts by index, a column for each of the given values, 0 where there are none."""
    counts = rows.groupBy(index).pivot(column, values).agg(_amount(weight))
    return counts.na.fill(0).orderBy(index)


def cooccurrence(view: DataFrame, flags: dict[str, str] | list[str] = FLAGS) -> DataFrame:
    """(flag_a, flag_b, count): how many rows have both, the diagonal how many have one. One aggregate, then long."""
    names = list(flags)
    sums = view.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a in names for b in names])
    pairs = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a in names for b in names)
    return sums.selectExpr(f"stack({len(names) ** 2}, {pairs}) as (flag_a, flag_b, count)").orderBy("flag_a", "flag_b")


def compound_patterns(view: DataFrame, combinations=COMPOUNDS) -> DataFrame:
    """(pattern, count, pct) of rows that have all indicators of a combination."""
    parts = []
    for names in combinations:
        both = F.lit(True)
        for n in names:
            both = both & F.col(f"has_{n}")
        parts.append((" + ".join(n.upper() if n == "url" else n.title() for n in names), both))
    sums = view.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(f"p{i}") for i, (_, c) in enumerate(parts)])
    long = ", ".join(f"'{name}', p{i}" for i, (name, _) in enumerate(parts))
    out = sums.selectExpr("_n", f"stack({len(parts)}, {long}) as (pattern, count)")
    return out.select("pattern", "count", percent("count", F.col("_n"), 2).alias("pct")).orderBy("count", "pattern")


def signal_summary(view: DataFrame, flags=FLAGS) -> DataFrame:
    """(signal, count, pct) over the whole view."""
    names = list(flags)
    sums = view.agg(F.count("*").alias("_n"), *[F.count_if(f).alias(f) for f in names])
    out = sums.selectExpr("_n", f"stack({len(names)}, " + ", ".join(f"'{f}', {f}" for f in names) + ") as (signal, count)")
    return out.select("signal", "count", percent("count", F.col("_n"), 1).alias("pct")).orderBy("signal")


def signal_rates(view: DataFrame, by: str, flags=FLAGS) -> DataFrame:
    """Percent of rows with each indicator by source or year; rows without one fall away."""
    return view.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.bround(F.avg(F.col(f).cast("int")) * 100, 1).alias(f) for f in flags]).orderBy(by)


def year_on_year(rows: DataFrame, period: str = "year", tag: str = "fraud_tag", weight: str | None = None) -> DataFrame:
    """(tag, previous, current, pct_change) of the last two periods that are present, adjacent or not; nothing if there
    are fewer. The change is (current - previous) / (previous + 1) in percent. Windows run over counts by period."""
    counts = rows.where(F.col(period).isNotNull()).groupBy(tag, period).agg(_amount(weight).alias("count"))
    ranked = counts.withColumn("_back", F.dense_rank().over(Window.orderBy(F.desc(period)))).where("_back <= 2")
    both = ranked.withColumn("_periods", F.max("_back").over(Window.partitionBy())).where("_periods = 2")
    sums = both.groupBy(tag).agg(*[F.coalesce(F.sum(F.when(F.col("_back") == n, F.col("count"))), F.lit(0)).alias(name) for n, name in ((2, "previous"), (1, "current"))])
    change = F.bround((F.col("current") - F.col("previous")).cast("double") / (F.col("previous") + 1) * 100, 1)
    return sums.withColumn("pct_change", change).orderBy(F.desc("pct_change"), tag)


def emerging(rows: DataFrame, period: str = "year", tag: str = "fraud_tag", weight: str | None = None, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """The k fastest rising and the k fastest falling tags."""
    change = year_on_year(rows, period, tag, weight)
    return change.where("pct_change > 0").orderBy(F.desc("pct_change"), tag).limit(k), change.where("pct_change < 0").orderBy("pct_change", tag).limit(k)


def new_categories(rows: DataFrame, period: str = "year", tag: str = "fraud_tag") -> DataFrame:
    """Tags whose first period is the last one present: one aggregate, no set difference over rows."""
    first = rows.where(F.col(period).isNotNull()).groupBy(tag).agg(F.min(period).alias("first"), F.max(period).alias("last"))
    return first.withColumn("end", F.max("last").over(Window.partitionBy())).where("first = end").select(tag).orderBy(tag)


def tag_multiplicity(view: DataFrame, tags: str = "fraud_tags") -> DataFrame:
    n = F.size(tags)
    return view.agg(F.count_if(n == 1).alias("single_tag"), F.count_if(n > 1).alias("multi_tag"), F.count("*").alias("documents"))


def view_summary(weighted: DataFrame) -> DataFrame:
    """By source: chunks, documents, average chunks of a document (1 / mean weight), first and last date."""
    return weighted.groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.bround(F.round(1 / F.avg("chunk_weight"), 9), 1).alias("avg_chunks"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date")).orderBy("source")


def null_counts(df: DataFrame) -> DataFrame:
    sums = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return sums.selectExpr(f"stack({len(df.columns)}, " + ", ".join(f"'{c}', `{c}`" for c in df.columns) + ") as (column_name, nulls)").orderBy("column_name")


#: What ``tag_cube`` counts by, each beside the tag; a row says by its ``kind`` which of them it is of.
CUBE = ("tag", "year", "quarter", "source")


def tag_cube(view: DataFrame, weight: str | None = None) -> DataFrame:
    """(kind, fraud_tag, year, quarter, source, count): all counts of a view's tags, by one pass over it.

    One Expand feeds one aggregate over GROUPING SETS: the tag alone, and with the year, the quarter and the source.
    ``kind`` is 'primary' for counts of primary tags, which rows bring along as a tag of another sort, and one of CUBE
    else. Columns that a set doesn't group by are null; a null inside a set is a group of its own. Null, blank and
    'other' tags fall away, but not as primary tags. Counts are weighted if a ``weight`` is named.
    """
    empty = F.array().cast("array<string>")
    named = F.filter(F.coalesce("fraud_tags", empty), lambda t: t.isNotNull() & ~t.isin("", "other"))
    sorts = [F.transform(named, lambda t: F.struct(F.lit(False).alias("primary"), t.alias("fraud_tag")))]
    if "primary_tag" in view.columns:
        sorts.append(F.array(F.struct(F.lit(True).alias("primary"), F.col("primary_tag").alias("fraud_tag"))))
    amount = [] if weight is None else [weight]
    rows = view.select("year", "quarter", "source", *amount, F.inline(F.concat(*sorts)))
    sets = [["primary", "fraud_tag"], *[["primary", "fraud_tag", c] for c in CUBE[1:]]]
    out = rows.groupingSets(sets, "primary", "fraud_tag", *CUBE[1:]).agg(F.grouping_id().alias("_set"), _amount(weight).alias("count"))
    # In a grouping id the bit of a column that isn't grouped by is 1, and the last column has the lowest bit.
    kinds = {7: "tag", 3: "year", 5: "quarter", 6: "source"}
    kind = F.coalesce(*[F.when(F.col("_set") == bits, F.lit(name)) for bits, name in kinds.items()])
    out = out.where(~F.col("primary") | (F.col("_set") == 7))
    return out.select(F.when(F.col("primary"), F.lit("primary")).otherwise(kind).alias("kind"), "fraud_tag", *CUBE[1:], "count")


def analyses_of(cube: DataFrame) -> dict[str, DataFrame]:
    """All tag analyses from a cube, which is read from a cache or a table: none goes back to the view."""
    rows = {kind: cube.where(F.col("kind") == kind) for kind in (*CUBE, "primary")}
    rising, falling = emerging(rows["year"], weight="count")
    return {
        "category_distribution": distribution(rows["tag"], weight="count"), "trend_by_year": trend(rows["year"], "year", weight="count"),
        "trend_by_quarter": trend(rows["quarter"], "quarter", weight="count"), "source_by_category": by_source(rows["source"], weight="count"),
        "rising": rising, "falling": falling, "new_categories": new_categories(rows["year"]),
        "primary_tag_distribution": distribution(rows["primary"].withColumnRenamed("fraud_tag", "primary_tag"), "primary_tag", "count", 2),
    }


def analyse(view: DataFrame, weight: str | None = None) -> dict[str, DataFrame]:
    """All tag analyses of one view. The view is read once: its cube, a few rows for each tag, is cached."""
    return analyses_of(tag_cube(view, weight).persist())
