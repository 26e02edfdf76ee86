"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import arrow_batches  # noqa: F401

#: Characters of whitespace in every contract of this subpackage.
BLANK = r"[\x20\x09-\x0D]"

_written: list[tuple[SparkSession, str]] = []


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, first of equals, whatever else the table has.

    Names that differ only in case, or occur twice, would be ambiguous in ``select``; positions aren't.
    """
    place = {}
    for i, name in enumerate(df.columns):
        place.setdefault(name, i)
    lower = {}
    for i, name in enumerate(df.columns):
        lower.setdefault(name.lower(), i)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{place.get(n, lower.get(n.lower(), -1))}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session that runs in one process (``local[...]``, as in tests) gets a folder of its own; any
    other is refused, as its executors would not see a folder of the driver's.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif context.master == "local" or context.master.startswith("local["):
            where = "file://" + tempfile.mkdtemp(prefix="inkspan-")
            context.setCheckpointDir(where)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/inkspan-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later reads don't depend on lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The driver's JVM removes it when it ends, whether or not the session is there still."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written_so_far() -> int:
    return len(_written)


def remove_since(mark: int, but: str) -> None:
    """Removes the tables that were written since ``mark``, one of them excepted, once nothing reads them any more."""
    for spark, path in _written[mark:]:
        if path != but:
            remove(spark, path)
    _written[mark:] = [x for x in _written[mark:] if x[1] == but]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session has ended before
            return


def remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def held_out(column: Column | str, modulus: int, rest: int) -> Column:
    """Whether a row is held out of training; a null id is not, but no label can name it."""
    return F.coalesce(remainder(column, modulus) == rest, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, rows: int, modulus: int = 5, rest: int = 0) -> DataFrame:
    """(doc_id, label) of about ``rows`` training rows at most, chosen by a hash of the id.

    ``rows`` bounds the sample whatever the table's size, so the result may be broadcast. Rows of a null id or
    label are left out; an id labelled twice counts once, by its larger label.
    """
    own = pick(labels, "doc_id", label).dropna()
    train = own.where(~held_out("doc_id", modulus, rest)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, rows / max(1, train.count()))
    return train.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def one_text_each(marked: DataFrame) -> DataFrame:
    """Of (doc_id, text, label) one row for each id, so that a bound on ids is one on rows: of its texts the one of the
    smallest hash."""
    return marked.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


#: Bits of the bitmap that ``bitmaps`` makes: 8 MB, whatever the rows.
MARKS = 1 << 26


def _mark(keys: Iterable[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(MARKS)) + 1


def bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """(bucket, bitmap): the hashes of the keys that ``rows`` have, MARKS bits in all, so they may be broadcast."""
    at = _mark(keys)
    marked = rows.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("position"))
    return marked.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bitmap"))


def with_mark(df: DataFrame, marks: DataFrame, *keys: str, name: str = "_marked") -> DataFrame:
    """Adds whether the row's hash is in ``bitmaps``: false says that no row had these keys, true that one may have.

    So only rows that may match need be shuffled for an exact join; the more keys there are, the less is saved.
    """
    at, bucket, bits = _mark(keys), f"{name}_bucket", f"{name}_bits"
    out = df.withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(marks.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bits))), bucket, "left")
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return out.withColumn(name, F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0, F.lit(False))).drop(bucket, bits)


def slices(batches: Iterable, size: int) -> Iterator[tuple[list, int]]:
    """Joins small Arrow batches until they hold ``size`` bytes, so work per call is even."""
    kept, total = [], 0
    for batch in batches:
        kept.append(batch)
        total += batch.nbytes
        if total >= size:
            yield kept, total
            kept, total = [], 0
    if kept:
        yield kept, total
