"""Counts by day, source and tag that are kept up as rows come, for dashboards that needn't read the rows.

Every micro-batch writes its counts to a folder of its own number, replacing what a first try may have left there: a
batch that is run again counts once. Old batches are folded into a base, which is published by one rename.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import releases
from ..sources.readers import exists

KEYS = ("day", "source", "primary_tag")
SCHEMA = "day date, source string, primary_tag string, records bigint, first_seen timestamp, last_seen timestamp"


def counted(rows: DataFrame, date: str = "date", source: str = "source", tag: str = "primary_tag") -> DataFrame:
    """(day, source, primary_tag, records, first_seen, last_seen): mergeable counts of rows; nulls are groups too."""
    stamp = F.col(date).cast("timestamp")
    own = rows.select(F.to_date(stamp).alias("day"), F.col(source).alias("source"), F.col(tag).alias("primary_tag"), stamp.alias("_at"))
    return own.groupBy(*KEYS).agg(F.count("*").alias("records"), F.min("_at").alias("first_seen"), F.max("_at").alias("last_seen"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS).agg(F.sum("records").alias("records"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def write_batch(rows: DataFrame, number: int, path: str, **columns: str) -> None:
    """Counts of one batch, under its number; once more, they replace themselves. A batch that the base has already is
    left alone."""
    if number > _folded(rows.sparkSession, path):
        counted(rows, **columns).write.mode("overwrite").parquet(f"{path}/parts/batch={number:012d}")


def maintain(stream: DataFrame, path: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """Takes what is there into the table at ``path`` and stops. A table has one checkpoint, whose numbers name its
    batches."""
    return stream.writeStream.foreachBatch(lambda rows, number: write_batch(rows, number, path, **columns)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folded(spark: SparkSession, path: str) -> int:
    """The last batch that the base has, or -1."""
    names = releases.outputs(spark, f"{path}/base")
    return int(names[0].removeprefix("upto=")) if names else -1


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole table: its base and the batches since, a row for each day, source and tag."""
    upto, out = _folded(spark, path), spark.createDataFrame([], SCHEMA)
    if upto >= 0:
        out = out.union(spark.read.schema(SCHEMA).parquet(f"{releases.current(spark, path + '/base')}/upto={upto}"))
    if exists(spark, f"{path}/parts"):
        since = spark.read.option("basePath", f"{path}/parts").schema(SCHEMA + ", batch long").parquet(f"{path}/parts")
        out = out.union(since.where(F.col("batch") > upto).drop("batch"))
    return merged(out)


def compact(spark: SparkSession, path: str) -> int:
    """Folds all batches into a new base and returns the last one's number; readers get the old base or the new one.
    Folders of folded batches may be removed afterwards; they are no longer read."""
    last = spark.read.option("basePath", f"{path}/parts").schema(SCHEMA + ", batch long").parquet(f"{path}/parts").agg(F.max("batch")).first()[0]
    upto = max(_folded(spark, path), -1 if last is None else last)
    if upto >= 0:
        releases.publish(spark, f"{path}/base", {f"upto={upto}": lambda at: read(spark, path).write.parquet(at)})
    return upto
