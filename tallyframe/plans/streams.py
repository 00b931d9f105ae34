"""Queries that run a table through streams, in several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.storage import scratch
from tallyframe.streaming import first

#: Parts of a table that arrive one after the other.
PARTS = 4


def arriving(t, spark, table: str, key: str, columns: list[str]):
    """A stream of a table's rows in about PARTS batches: the parts, by order of the key, are written one after the
    other, and files are read in the order of their time."""
    rows = t(table).select(*columns)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    inbox, files = scratch(spark, "inbox"), spark.sparkContext.defaultParallelism
    part = F.least(F.floor((F.col(key) - F.lit(low or 0)) * PARTS / F.lit((high or 0) - (low or 0) + 1)), F.lit(PARTS - 1))
    for i in range(PARTS):
        rows.where(part == i).repartition(files).write.parquet(f"{inbox}/part={i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return stream.parquet(inbox)


@query("q_stream_first", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE user_id IS NOT NULL)
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM f WHERE rn = 1 GROUP BY event_type""")
def stream_first(t, spark):
    """The first event of each user, over several batches by a state store, and running totals of them."""
    stream = arriving(t, spark, "events", "event_id", ["event_id", "user_id", "event_type", "value"])
    kept, sums, state = (scratch(spark, x) for x in ("first", "totals", "checkpoints"))
    first.start_first(stream, "user_id", "event_id", kept, f"{state}/first").awaitTermination()
    again = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1000).parquet(kept)
    first.start_totals(again, "event_type", "value", sums, f"{state}/totals").awaitTermination()
    return spark.read.schema("event_type string, n long, total double").parquet(sums).select("event_type", "n", F.round("total", 4).alias("total"))
