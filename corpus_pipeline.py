"""Five stages that prepare a corpus, each over all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the columns of documents, the last
one its encodings. run() writes each stage's rows as Parquet in the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import bpe, decontaminate, lines, rules, simhash
from inkspan.llm.common import new_path, pick, remove, remove_at_end, remove_since, table, written_so_far

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of the shingles by which near copies are told.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the learned decision list reject go, and with them null and empty texts, which
    have fewer words than the limit. Repeated rows are judged each by itself."""
    learned = rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.judge(pick(docs, *COLUMNS), learned).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the last of them only. Every document
    stays, if need be with an empty text; n_chars follows the text."""
    own = pick(docs, *COLUMNS)
    out = lines.with_kept_lines(own, lines.dropped_lines(own))
    same = F.col("n_dropped") == 0
    kept, n_chars = F.when(same, F.col("text")).otherwise(F.col("kept_text")), F.when(same, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return out.select("doc_id", kept.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies stays."""
    return simhash.one_of_each(pick(docs, *COLUMNS), SHINGLE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go. Null and empty texts
    hold none and stay; repeated rows go or stay together."""
    return decontaminate.without_matches(pick(docs, *COLUMNS), table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left. Null and empty texts have no tokens; repeated rows stay, each by itself."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_dedup), ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. When a stage's rows are written, the tables that it made on its way are removed,
    and so are the rows of the stage before."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        mark, path = written_so_far(), new_path(spark, "stage")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        remove_at_end(spark, path)
        docs = spark.read.schema(made.schema).parquet(path)
        remove_since(mark, path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
