"""First writer wins, by a keyed state store: each batch meets only the state of its own keys.

The state of a key is one mark, kept for ever by the RocksDB provider of the state store, which spills to disk; so
the work of a batch does not grow with what is stored, and a batch that runs again after a failure starts from the
state before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _First(StatefulProcessor):
    """Passes the first row of a key, least in order within its batch, unless the key was seen before."""

    def __init__(self, order: str, columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            for _ in rows:
                pass
            return
        best = None
        for part in rows:
            part = part if best is None else pd.concat([best, part])
            best = part.nsmallest(1, self.order) if part[self.order].notna().any() else part.head(1)
        self.seen.update((True,))
        if best is not None:
            yield best[self.columns]

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """A streaming DataFrame's rows that are the first of their key: of an earlier batch, or least in order (a number)
    within one. Rows with a null key go. Needs use_state_store on the session."""
    columns = stream.columns
    named = stream.where(F.col(key).isNotNull())
    return named.groupBy(key).transformWithStateInPandas(_First(order, columns), StructType(list(stream.schema.fields)), "Append", "None")


def use_state_store(spark: SparkSession) -> None:
    """Sets the provider that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_first(stream: DataFrame, key: str, order: str, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Appends the first row of each key to a Parquet folder, exactly once."""
    use_state_store(stream.sparkSession)
    out = first_of_key(stream, key, order).writeStream.format("parquet").outputMode("append").option("path", folder)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_totals(stream: DataFrame, by: str, value: str, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keeps n and total of each value of by as running sums in the state store; each batch replaces the table in
    folder, one row for each value seen so far."""
    use_state_store(stream.sparkSession)
    sums = stream.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))

    def step(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(folder)

    return sums.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
