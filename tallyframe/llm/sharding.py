"""Sharding by jump consistent hashing: no ring table, and adding a shard moves rows only into it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import documents

#: Rows of a shard are numbered in so many independent chunks; the table of chunk offsets has shards * CHUNKS rows.
CHUNKS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of unsigned 64-bit keys, all keys at once."""
    key = keys.astype(np.uint64)
    bucket = np.full(len(key), -1, np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[live] = np.minimum((bucket[live] + 1) * step, 2.0**62).astype(np.int64)
        live = live[jump[live] < shards]
    return bucket


def shard_column(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key column."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(key)


def shard_documents(docs: DataFrame, shards: int = 8, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, size, text_crc32, law ("key"), shard, slot, grown_shard (the shard with one shard more).

    The stable key is doc_id alone: equal texts under different ids may part, a repeated doc_id stays in one
    shard. Null doc_id hashes as a key of its own. Null text has size 1 and the checksum of nothing, 0. Slots
    number a shard's rows without gaps by (chunk, doc_id, checksum), a chunk being a hash of the row; ties are
    equal rows, so either order gives the same result. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.lit("shard"), F.col("doc_id"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_column(key, shards).alias("shard"),
        shard_column(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(chunks)).cast("int").alias("chunk"),
    )
    per = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_r", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "chunk"])  # at most shards * chunks rows
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("_r")).cast("long").alias("slot"), "grown_shard")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of eight, slot and the shard it has among nine: nulls and repeats as in
    shard_documents."""
    return shard_documents(documents(spark, sf_dir, "doc_id", "text"))
