"""Keeping one row of several, and keeping rows out: first, preferred or last of a key, unseen keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """The first row of each key in this order.

    One pre-aggregated minimum over the whole row: partial minima are taken before the shuffle, so a hot key costs one
    row a task, where a window would bring all its rows together.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    ranks = [(F.col(o) if isinstance(o, str) else o) for o in order]
    packed = F.struct(*others) if others else F.struct(F.lit(1))
    best = df.groupBy(*keys).agg(F.min_by(packed, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)])).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def keep_first_chain(df: DataFrame, chain: Iterable[Iterable[str]], order: Iterable[Column | str]) -> DataFrame:
    """One key after another: first by url, then by title, say."""
    for keys in chain:
        df = keep_first(df, keys, order)
    return df


def keep_last_value(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key, standing where its first stood, as a dictionary filled in order does."""
    others = [c for c in df.columns if c not in (key, order)]
    out = df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row"), F.min(order).alias(order))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) if c in others else F.col(c) for c in df.columns])


def prefer_language(df: DataFrame, key: str, spanish: str, date: str) -> DataFrame:
    """Of one id's notices, the one not in Spanish, then the earliest dated."""
    return keep_first(df, [key], [F.col(spanish).cast("int"), F.col(date).isNull().cast("int"), F.coalesce(F.col(date).cast("string"), F.lit(""))])


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the known: incremental loads."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def first_source_wins(sources: Iterable[DataFrame], key: str, seq: str) -> DataFrame:
    """Union of sources in order of precedence; a key comes from the first source that has it."""
    out = None
    for rank, df in enumerate(sources):
        part = df.withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return keep_first(out, [key], ["_rank", seq]).drop("_rank")


def numbered(df: DataFrame, order: Iterable[Column | str], by: Iterable[str], name: str = "seq") -> DataFrame:
    """Row numbers within each ``by``; keys must be small groups such as a document's chunks."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
