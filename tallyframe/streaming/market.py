"""Event ingest and the maintained market snapshot, in Structured Streaming with foreachBatch.

Delivery is at least once, events may be late by any time, and the first event of an id wins for ever; so there is
no watermark. Tables are Parquet folders that hold one part for each batch id: a batch that is run again after a
failure overwrites its own part, so each event counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyframe.functions import events as E
from tallyframe.operators.relations import append_new

PREDICTIONS = "ingest_seq long, msg_id string, created_at string, status string, label string, confidence double, model string, result_json string, estimated int"
REJECTS = "payload string, reason string"
STATE = "light long, medium long, dark long, estimated long, visible_only long, results long, n_rows long"
TOP = "created_at string, ingest_seq long, light long, medium long, dark long, estimated boolean, visible_only boolean"
BEANS = "created_at string, ingest_seq long, index int, label string, confidence double"
OFFSETS = "next_seq long, n_rows long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of parts, or an empty one where nothing is written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", batch long").parquet(path)


def _part_before(spark: SparkSession, path: str, before: int) -> str | None:
    """The part of the last batch before the given one, by the names of the parts; no other part is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    found = [int(x.getPath().getName().split("=")[1]) for x in files.listStatus(where) if x.getPath().getName().startswith("batch=")]
    last = max((b for b in found if b < before), default=None)
    return None if last is None else f"{path}/batch={last}"


def project(valid: DataFrame) -> DataFrame:
    """The stored columns of valid events; needs ingest_seq and payload."""
    event, own = F.col("_e"), F.col("_m")
    told = valid.withColumn("_e", E.members(E.variant(F.col("payload")))).withColumn("_m", E.members(event["result"]))
    return told.select(
        "ingest_seq", F.try_variant_get(event["msg_id"], "$", "string").alias("msg_id"), E.text(event["created_at"], "$").alias("created_at"), E.text(own["status"], "$").alias("status"), E.text(own["label"], "$").alias("label"),
        F.try_variant_get(own["confidence"], "$", "double").alias("confidence"), E.text(own["model"], "$").alias("model"), F.to_json(event["result"]).alias("result_json"), E.estimated(own).cast("int").alias("estimated"),
    )


def _next_seq(spark: SparkSession, folder: str, batch_id: int) -> tuple[int, int]:
    """Where the numbers of a batch start, and how many predictions are stored, by what the batch before noted."""
    part = _part_before(spark, f"{folder}/offsets", batch_id)
    last = None if part is None else spark.read.schema(OFFSETS).parquet(part).first()
    return (last["next_seq"], last["n_rows"]) if last else (0, 0)


def ingest_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Validates a batch of texts (column value), appends new events to predictions and refused ones to rejects.

    ingest_seq goes on from the batch before without gaps: where each partition of the batch starts follows from the
    partitions' counts, so no rows are gathered. Only stored ids that occur in the batch are looked at.
    """
    spark = batch.sparkSession
    seq, stored = _next_seq(spark, folder, batch_id)
    rows = batch.select(F.col("value").alias("payload")).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist()
    try:
        starts, n = {}, 0
        for r in sorted(rows.groupBy("_p").count().collect()):  # a row for each partition
            starts[r["_p"]] = seq + n
            n += r["count"]
        start = F.coalesce(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("_p")], F.lit(0)) if starts else F.lit(0)
        told = E.validated(rows.select("payload", (start.cast("long") + F.col("_i")).alias("ingest_seq")), "payload").persist()
        told.where("error is not null").select("payload", F.col("error").alias("reason")).write.mode("overwrite").parquet(f"{folder}/rejects/batch={batch_id}")
        target = _table(spark, f"{folder}/predictions", PREDICTIONS)
        if "batch" in target.columns:
            target = target.where(F.col("batch") < batch_id)  # a repeated batch writes the same part again
        fresh = append_new(target.select("msg_id"), project(told.where("error is null")), "msg_id", [F.col("ingest_seq")])
        part = f"{folder}/predictions/batch={batch_id}"
        fresh.select(*[c.split()[0] for c in PREDICTIONS.split(", ")]).write.mode("overwrite").parquet(part)
        new = spark.read.parquet(part).count()
        spark.createDataFrame([(seq + n, stored + new)], OFFSETS).write.mode("overwrite").parquet(f"{folder}/offsets/batch={batch_id}")
        told.unpersist()
    finally:
        rows.unpersist()


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of the files that arrive in a folder; back-pressure by files in a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, rows_per_batch: int = 1_000_000) -> DataFrame:
    """Messages of a Kafka topic as column value (the connector must be on the class path); back-pressure by offsets in
    a batch."""
    read = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return read.option("maxOffsetsPerTrigger", rows_per_batch).load().select(F.col("value").cast("string").alias("value"))


def publishable(predictions: DataFrame, most: int, compact: bool = True) -> DataFrame:
    """(value): the messages of a batch as they are published, without beans; of more than `most` the first to arrive,
    as a full queue drops the newest."""
    v = F.to_json(F.struct("msg_id", "created_at", F.parse_json(E.published(F.col("result_json"), compact)).alias("result")))
    return predictions.orderBy("ingest_seq").limit(most).select(v.alias("value"))


def publish(predictions: DataFrame, folder: str, batch_id: int, most: int = 1000, compact: bool = True) -> None:
    """Writes a batch's messages as lines to the folder's part of that batch, so a batch run again replaces them."""
    publishable(predictions, most, compact).write.mode("overwrite").text(f"{folder}/batch={batch_id}")


def start_ingest(lines: DataFrame, folder: str, checkpoint: str, then: Callable[[SparkSession, int], None] | None = None, **trigger: object) -> StreamingQuery:
    """Starts ingest of a streaming DataFrame with a text column value (files, Kafka). `then` runs after each batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, folder)
        if then is not None:
            then(batch.sparkSession, batch_id)

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The stored predictions. Parts written before there was a column estimated count as exact."""
    return _table(spark, f"{folder}/predictions", PREDICTIONS).withColumn("estimated", F.coalesce("estimated", F.lit(0)))


def _usable(predictions: DataFrame) -> DataFrame:
    """Stored results with what they add, whether they count (usable status, adding counts), and whether only visible
    ones were counted."""
    told = E.contributions(predictions, "result_json")
    counts = F.coalesce(F.col("status").isin("ok", "low_confidence") & F.col("added").isNotNull(), F.lit(False))
    # not deterministic, so that a filter stays above the facts and does not work them out once more
    told = told.withColumn("_counts", F.when(F.monotonically_increasing_id() >= 0, counts))
    return told.withColumn("visible_only", F.array_contains(E.warnings(E.variant(F.col("result_json")), "$.warnings"), "count_visible_only"))


def counted(predictions: DataFrame) -> DataFrame:
    """Stored results of usable status that add counts, with what they add and whether only visible ones were counted."""
    return _usable(predictions).where("_counts").drop("_counts")


def totals(predictions: DataFrame) -> DataFrame:
    """One row: sums by class, estimated and visible-only results, results counted, rows seen. One pass over the rows."""
    some = lambda c: F.coalesce(F.sum(F.when(F.col("_counts"), c.cast("long"))), F.lit(0))
    sums = [some(F.col(f"added.{x}")).alias(x) for x in E.LABELS]
    return _usable(predictions).agg(*sums, some(F.col("estimated")).alias("estimated"), some(F.col("visible_only")).alias("visible_only"), F.count_if("_counts").alias("results"), F.count("*").alias("n_rows"))


def _newest_first() -> list:
    return [F.desc(c) for c in ("created_at", "ingest_seq")]


def newest(predictions: DataFrame, limit: int) -> DataFrame:
    """The results that come last by the text of created_at, ties by arrival."""
    own = [F.col(f"added.{x}").alias(x) for x in E.LABELS]
    return counted(predictions).select("created_at", "ingest_seq", *own, (F.col("estimated") == 1).alias("estimated"), "visible_only").orderBy(*_newest_first()).limit(limit)


def newest_beans(predictions: DataFrame, limit: int) -> DataFrame:
    """The first `limit` detections over the newest results, each with its place from 1 in its result."""
    v = E.variant(F.col("result_json"))
    rows = counted(predictions).select("created_at", "ingest_seq", E.labelled_beans(v, "$").alias("b")).where(F.size("b") > 0).orderBy(*_newest_first()).limit(limit)
    each = rows.select("created_at", "ingest_seq", F.posexplode(F.slice("b", 1, limit)).alias("i", "b"))
    told = each.select("created_at", "ingest_seq", (F.col("i") + 1).alias("index"), E.text(F.col("b"), "$.label").alias("label"), F.try_variant_get(F.col("b"), "$.conf", "double").alias("confidence"))
    return told.orderBy(*_newest_first(), "index").limit(limit)


class Snapshot:
    """Totals and newest results kept as tables and folded forward batch by batch; rebuilt when the predictions did
    not just grow."""

    def __init__(self, folder: str, limit: int = 50):
        self.folder, self.limit = folder, limit

    def _last(self, spark: SparkSession, before: int) -> list[DataFrame] | None:
        """State, newest results and newest beans after the last batch before the given one."""
        part = _part_before(spark, f"{self.folder}/beans", before)  # the last of the three to be written
        if part is None:
            return None
        batch = part.rsplit("/", 1)[1]
        return [spark.read.schema(schema).parquet(f"{self.folder}/{name}/{batch}") for name, schema in (("state", STATE), ("top", TOP), ("beans", BEANS))]

    def fold(self, spark: SparkSession, batch_id: int) -> None:
        """Adds what a batch appended; the new state goes to the batch's own part. Counts of rows come from the state
        and from what ingest noted, so only the batch's own rows are read unless a rebuild is due."""
        all_rows = read_predictions(spark, self.folder)
        last = self._last(spark, batch_id)
        new = all_rows.where(F.col("batch") == batch_id) if "batch" in all_rows.columns else all_rows
        stored = _next_seq(spark, self.folder, batch_id + 1)[1]
        first = _newest_first()
        if last is not None and last[0].first()["n_rows"] + new.count() == stored:
            both = last[0].unionByName(totals(new))
            state = both.agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in STATE.split(", ")])
            top = last[1].unionByName(newest(new, self.limit)).orderBy(*first).limit(self.limit)
            beans = last[2].unionByName(newest_beans(new, self.limit)).orderBy(*first, "index").limit(self.limit)
        else:
            state, top, beans = totals(all_rows), newest(all_rows, self.limit), newest_beans(all_rows, self.limit)
        for name, table in (("state", state), ("top", top), ("beans", beans)):
            table.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(totals, newest results, newest beans) after the last batch."""
        found = self._last(spark, 1 << 62)
        if found is None:
            raise ValueError("no batch was folded yet")
        return found[0], found[1].orderBy(*_newest_first()), found[2].orderBy(*_newest_first(), "index")


def bounded_dedup(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The opt-in variant with bounded state: repeats of a key within the watermark delay go, later ones do not.
    A timestamp without zone is taken as UTC, as watermarks need one."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str, delay: str) -> DataFrame:
    """Tumbling counts by class: an extension for streams whose lateness is bounded."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return stamped.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
