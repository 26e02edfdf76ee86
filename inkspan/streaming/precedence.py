"""First source wins, across runs: of each key the row of the best-ranked source, whenever it comes.

A stateful operator keeps of each key the rank of what it has, not the row itself. A better row that comes later
replaces the worse one and is emitted as a change, so the table of changes, appended exactly once, tells at any time
what a batch over all rows so far would keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The state store that value state with timers and TTL needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = ("_rank", "_seq", "_tie")


def ranked(rows: DataFrame, source: str, sources: list[str], seq: str) -> DataFrame:
    """Adds what rows are ordered by: the source's place in the list (unlisted ones come last), the sequence number,
    and a hash of the whole row, so that the order is the same whichever comes first."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, sources)), F.col(source)).cast("int"), F.lit(0))
    rank = F.when(place > 0, place).otherwise(len(sources) + 1)
    return rows.withColumns({"_rank": rank, "_seq": F.col(seq).cast("long"), "_tie": F.xxhash64(*rows.columns)})


def _best_of_batches(key: str):
    """Of each Arrow batch the best row of each key: what a hot key costs in the shuffle is a row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = pa.array(batch.column(key).dictionary_encode(null_encoding="encode").indices)
                table = pa.table([codes, *[batch.column(c) for c in _ORDER]], names=["key", *_ORDER])
                order = pc.sort_indices(table, [("key", "ascending"), *[(c, "ascending") for c in _ORDER]], null_placement="at_end")
                own = codes.take(order).to_numpy()
                yield batch.take(order.filter(pa.array(np.concatenate([[True], own[1:] != own[:-1]]))))

    return run


class _Keeper(StatefulProcessor):
    """State of a key: the order of the row that is kept, and its version."""

    def __init__(self, columns: list[str], forget: int | None, settle: int | None):
        self.columns, self.forget, self.settle = columns, forget, settle

    def init(self, handle) -> None:
        self.handle = handle
        kept = "rank int, seq long, tie long, version int, settled boolean"
        self.kept = handle.getValueState("kept", kept, self.forget) if self.forget else handle.getValueState("kept", kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # A null sequence number comes last of its source.
        order = lambda r: (r["_rank"], r["_seq"] is None, r["_seq"] or 0, r["_tie"])
        best = min(rows, key=order)
        had = self.kept.get() if self.kept.exists() else None
        if had is not None and (had[4] or order(best) >= (had[0], had[1] is None, had[1] or 0, had[2])):
            return
        version = had[3] + 1 if had is not None else 1
        self.kept.update((best["_rank"], best["_seq"], best["_tie"], version, False))
        if self.settle and version == 1:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.settle)
        yield Row(**{c: best[c] for c in self.columns}, change="new" if version == 1 else "replaced", version=version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists():
            rank, seq, tie, version, _ = self.kept.get()
            self.kept.update((rank, seq, tie, version, True))
        return iter(())

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str, source: str, sources: list[str], seq: str, forget_days: float | None = None, settle_days: float | None = None) -> DataFrame:
    """The stream's rows that came to be kept, with ``change`` ('new' or 'replaced') and ``version``, by 1 up for each
    key.

    ``sources`` are in order of precedence; in one source the smaller ``seq`` wins, then a hash of the row. A null key
    is a key. With ``settle_days`` a key's choice is final so long after its first row (a timer ends it); with
    ``forget_days`` a key that has not changed for so long is forgotten, its next row being new again, so that state
    stays bounded. Without either, runs in any order give what ``first_source_wins`` gives of all rows.
    """
    rows = ranked(stream, source, sources, seq)
    fewer = rows.mapInArrow(_best_of_batches(key), rows.schema)
    schema = T.StructType([*stream.schema.fields, T.StructField("change", T.StringType()), T.StructField("version", T.IntegerType())])
    forget, settle = (days and math.ceil(days * 86_400_000) for days in (forget_days, settle_days))
    keeper = _Keeper(stream.columns, forget, settle)
    return fewer.groupBy(key).transformWithState(keeper, schema, "Append", "ProcessingTime" if forget_days or settle_days else "None")


def follow(spark: SparkSession, found: DataFrame, path: str, checkpoint: str) -> None:
    """One run: takes what is there, appends its changes to the table at ``path`` exactly once, and stops."""
    settings = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def current_of(found: DataFrame, key: str) -> DataFrame:
    """What is kept now: of each key the change of the highest version, by one pre-aggregated maximum."""
    others = [c for c in found.columns if c != key]
    last = found.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("_row"))
    return last.select(*[F.col(c) if c == key else F.col(f"_row.`{c}`").alias(c) for c in found.columns])
