"""Reading what crawlers land: JSON lines, JSON arrays, CSV, feeds, archive indexes, stored pages and files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_of, normalize_space, stable_id


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


LISTING = _strings("title_hint url published_raw source_feed data_source wayback_ts")
TAG_LISTING = _strings("url title_hint date_hint tag data_source wayback_ts")
REPORT_LISTING = _strings("title_hint url published_raw source_year source_type")
PUBLICATION = _strings("notice_id title doc_type date source_page pdf_url")
ARTICLE = T.StructType([*_strings("doc_id title url published_raw body_raw source").fields, T.StructField("topics", T.ArrayType(T.StringType()))])
SIGNALS = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in "urls domains emails phones ip_addresses crypto_wallets".split()])
DOCUMENT = T.StructType([
    *_strings("doc_id date source").fields, T.StructField("fraud_tags", T.ArrayType(T.StringType())), T.StructField("fraud_signals", SIGNALS), *_strings("title body_1 url").fields,
])
CHUNK = T.StructType([*_strings("doc_id title source date url").fields, T.StructField("chunk_id", T.IntegerType()), T.StructField("chunk_text", T.StringType()), T.StructField("chunk_length", T.IntegerType())])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return bool(found)


def landing(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), removed when the driver ends.

    Where that is unset, a session that runs in one process (``local[...]``) takes a temporary folder, and any other is
    refused: executors of their own, be they on the driver's machine, don't see the driver's files.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.gettempdir()
    parent = context._jvm.org.apache.hadoop.fs.Path(f"{where.rstrip('/')}/inkspan-{uuid.uuid4().hex}")
    files = parent.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(parent)
    files.deleteOnExit(parent)
    return f"{parent.toString()}/{name}"


def json_lines(spark: SparkSession, path: str, schema: T.StructType, source: str | None = None) -> DataFrame:
    """JSON lines; blank lines are none. ``source`` names the rows, and what they said themselves becomes
    source_detail."""
    df = spark.read.schema(schema).json(path)
    if source is None:
        return df
    detail = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    return df.withColumn("source_detail", detail).withColumn("source", F.lit(source))


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, quoted line ends and doubled quotes; all columns text unless a schema says otherwise."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def optional(spark: SparkSession, path: str, schema: T.StructType, read=json_lines, **options) -> DataFrame:
    """The source if it is there, else an empty table of its schema."""
    if exists(spark, path):
        return read(spark, path, schema, **options)
    return spark.createDataFrame([], schema)


def feed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Items of an RSS feed as listing rows: the link, else the guid, if it is an http address."""
    schema = T.StructType([*_strings("title link guid pubDate description").fields, T.StructField("category", T.ArrayType(T.StringType()))])
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    out = items.select(F.trim("title").alias("title_hint"), F.trim(first_of(F.trim("link"), F.trim("guid"))).alias("url"), F.trim("pubDate").alias("published_raw"), F.lit(name).alias("source_feed"), F.lit("rss").alias("data_source"), F.lit("").alias("wayback_ts"), "description", F.sort_array(F.array_distinct(F.coalesce("category", F.array().cast("array<string>")))).alias("topics"))
    return out.where(F.col("url").startswith("http"))


def feed_articles(items: DataFrame, order: str | Column = "published_raw") -> DataFrame:
    """One article for each url of ``feed`` rows, the last in ``order`` winning: title, description as its body,
    topics. ``order`` tells which feed, or which item, came later."""
    body = normalize_space(F.regexp_replace(F.coalesce("description", F.lit("")), r"<[^>]+>", " "))
    rows = items.select("url", normalize_space("title_hint").alias("title"), body.alias("body_raw"), "published_raw", F.col("source_feed").alias("source"), F.transform("topics", normalize_space).alias("topics"), (F.col(order) if isinstance(order, str) else order).alias("_order"))
    rows = rows.withColumn("topics", F.sort_array(F.array_distinct(F.filter("topics", lambda t: t != ""))))
    best = rows.groupBy("url").agg(F.max_by(F.struct("title", "body_raw", "published_raw", "source", "topics"), "_order").alias("r"))
    return best.select(stable_id("url").alias("doc_id"), "url", "r.*")


def archive_index(df: DataFrame, body: str = "body", limit: int | None = None, since: str | None = None, until: str | None = None, source: str = "archive") -> DataFrame:
    """Rows of a web archive's index: a JSON matrix with its header first.

    What the service would do is done here: one capture a url (its first), status 200 only, a range of dates, a cap.
    """
    matrix = F.from_json(body, "array<array<string>>")
    rows = df.select(matrix.alias("m")).select(F.col("m")[0].alias("head"), F.explode(F.slice("m", 2, 1_000_000_000)).alias("row"))
    value = lambda name: F.try_element_at(F.map_from_arrays("head", "row"), F.lit(name))
    out = rows.select(value("original").alias("url"), value("timestamp").alias("wayback_ts"), F.coalesce(value("statuscode"), F.lit("200")).alias("status"))
    out = out.where("status = '200'")
    if since:
        out = out.where(F.col("wayback_ts") >= since)
    if until:
        out = out.where(F.col("wayback_ts") <= until)
    out = out.withColumn("url", F.rtrim("url", F.lit("/"))).groupBy("url").agg(F.min("wayback_ts").alias("wayback_ts"))
    out = out.withColumn("data_source", F.lit(source)).withColumn("published_raw", F.when(F.length("wayback_ts") >= 8, F.concat_ws("-", F.substring("wayback_ts", 1, 4), F.substring("wayback_ts", 5, 2), F.substring("wayback_ts", 7, 2))))
    return out.orderBy("url").limit(limit) if limit else out


def first_capture(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Adds the day on which an archive first saw each url."""
    first = index.groupBy("url").agg(F.min("wayback_ts").alias("_ts"))
    return listing.join(first, "url", "left").withColumn("first_capture", F.to_date(F.try_to_timestamp(F.substring("_ts", 1, 8), F.lit("yyyyMMdd")))).drop("_ts")


def stored_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Downloaded files as rows of path, modification time, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def local_path(directory: str, key: Column | str) -> Column:
    """Where a publication's file is kept."""
    return F.concat(F.lit(directory.rstrip("/") + "/"), F.col(key) if isinstance(key, str) else key, F.lit(".pdf"))


def missing_files(publications: DataFrame, files: DataFrame, column: str = "local_pdf_path") -> DataFrame:
    return publications.join(files.select(F.regexp_replace("path", "^file:/+", "/").alias(column)), column, "left_anti")
