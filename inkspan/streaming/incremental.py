"""Incremental loads with Structured Streaming: resume, bounded work a run, deduplication, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.tags import pattern_tags
from ..functions.taxonomy import DEFAULT, Taxonomy


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_run: int | None = None, format: str = "json") -> DataFrame:
    """Files of a folder as a stream; with ``files_per_run`` so many a batch."""
    reader = spark.readStream.format(format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_run) if files_per_run else reader).load(path)


def once_per_id(stream: DataFrame, key: str = "doc_id", event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """First arrival of each id. With an event time, ids are forgotten after ``delay``, so state stays bounded."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def append(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Takes what is there, appends it exactly once, and stops; the next run goes on from the checkpoint."""
    return stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tagged(stream: DataFrame, text: str, taxonomy: Taxonomy = DEFAULT) -> DataFrame:
    return stream.withColumn("fraud_tags", pattern_tags(text, taxonomy))


def windowed_tag_counts(stream: DataFrame, time: str, window: str = "7 days", delay: str = "1 day", start: str | None = None) -> DataFrame:
    """(period_start, period_end, fraud_tag, count); rows later than ``delay`` are too late. Windows begin ``start``
    after the epoch's, which was a Thursday: '4 days' makes weeks begin on Mondays."""
    rows = stream.withWatermark(time, delay).select(time, F.explode("fraud_tags").alias("fraud_tag"))
    return rows.groupBy(F.window(time, window, None, start), "fraud_tag").agg(F.count("*").alias("count")).select(F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "fraud_tag", "count")


def run_batch(new: DataFrame, path: str, key: str = "doc_id", limit: int | None = None, order: str | None = None) -> DataFrame:
    """The batch form: rows whose key isn't in the table at ``path`` yet, at most ``limit`` of them, in order."""
    from ..operators.dedup import unseen
    from ..sources.readers import exists

    spark = new.sparkSession
    rows = unseen(new, spark.read.parquet(path), key) if exists(spark, path) else new
    return rows.orderBy(order or key).limit(limit) if limit else rows
