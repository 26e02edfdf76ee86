import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
DATA = "/root/testdata"


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, ids counting from 0, or of (id, text) pairs."""

    def make(texts, partitions=3):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], DOCUMENTS).repartition(partitions)

    return make
