"""Writing results: JSON lines, JSON arrays, CSV, view exports, and tables for what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.taxonomy import Taxonomy

FIRST = ("doc_id", "source", "date", "year", "month", "quarter", "primary_tag", "fraud_tags", "text_length", "has_url", "has_email", "has_phone", "has_ip", "has_crypto")


def encoded(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, so that rows fit a flat file."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line; null fields are written too."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_array(df: DataFrame) -> DataFrame:
    """Rows ``value`` that make one JSON array when they are written as lines in their order: a bracket, an object a
    line with its comma, a bracket. No row holds the table, so it may be of any size."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"), F.monotonically_increasing_id().alias("i"))
    first = F.broadcast(rows.agg(F.min("i").alias("first")))
    lines = rows.join(first).select((F.col("i") + 1).alias("i"), F.concat(F.when(F.col("i") == F.col("first"), F.lit("  ")).otherwise(F.lit(", ")), "j").alias("value"))
    ends = df.sparkSession.createDataFrame([(0, "["), ((1 << 63) - 1, "]")], "i long, value string")
    return lines.union(ends).orderBy("i").select("value")


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    encoded(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


#: What is exported of each view.
VIEW_EXPORTS = ("category_distribution", "trend_by_year", "source_by_category")


def export_view(results: dict[str, DataFrame], directory: str, suffix: str) -> None:
    """category_distribution, trend_by_year and source_by_category of one view, each a CSV folder."""
    for name in VIEW_EXPORTS:
        csv(results[name], f"{directory}/{name}_{suffix}")


def flat_master(df: DataFrame, include_body: bool = False) -> DataFrame:
    """Columns in reading order: identity and tags, the rest, then bodies if wanted; nested ones as JSON text."""
    bodies = [c for c in df.columns if c == "body" or c.startswith("body_")]
    numbered = sorted((c for c in bodies if c[5:].isdigit()), key=lambda c: int(c[5:]))
    first = [c for c in FIRST if c in df.columns]
    middle = [c for c in df.columns if c not in first and c not in bodies]
    last = [c for c in bodies if c not in numbered] + numbered if include_body else []
    return encoded(df.select(*first, *middle, *last))


def dictionaries(spark, taxonomy: Taxonomy) -> tuple[DataFrame, DataFrame]:
    """(keyword, fraud_family) and (signal_keyword, signal_category)."""
    return spark.createDataFrame(taxonomy.keyword_rows(), "keyword string, fraud_family string"), spark.createDataFrame(taxonomy.signal_rows(), "signal_keyword string, signal_category string")


def split_failures(df: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are right, and those for a table of failures."""
    good = F.coalesce(F.expr(condition), F.lit(False))
    return df.where(good), df.where(~good)
