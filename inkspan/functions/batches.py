"""How much of a table goes to Python at a time."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch at most, but for a single larger row.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to a few MB, and so what Parquet's reader unpacks at a time, which is counted in rows too;
    smaller settings of the caller stay."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.parquet.columnarReaderBatchSize": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
    for key, limit in most.items():
        number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", spark.conf.get(key).lower()).groups()
        now = int(number) << 10 * " kmgtp".find(unit.replace("b", " ") or " ")
        if now <= 0 or now > limit:
            spark.conf.set(key, str(limit))
