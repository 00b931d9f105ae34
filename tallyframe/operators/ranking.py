"""Top-k, deduplication by priority, caps, samples and splits. Pseudo-random choices rank by a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.storage import materialize


def shuffled(seed: int, *keys: str) -> Column:
    """An order that looks random and depends on seed and keys alone."""
    return F.xxhash64(F.lit(seed), *keys)


def first_per_group(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group. A group of one key is cut down in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def priority_dedup(df: DataFrame, key: str, label: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with a reason): of rows with equal key the first in order; all of them where labels conflict.
    A null key is a key like others.

    Rows of equal order go by a hash of all their columns; of rows equal in all columns one is kept. One aggregation
    finds the first row's order and the number of labels of each key; it is joined back, so a hot key's rows are never
    gathered.
    """
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(*df.columns).alias("h"), F.monotonically_increasing_id().alias("row"))
    ranked = materialize(df.withColumn("_o", rank), "priority-ranked")  # row numbers must not change between the two reads
    k = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    per = ranked.groupBy(k.alias("_k")).agg(F.min("_o").alias("_first"), F.min(F.struct(label)).alias("_lo"), F.max(F.struct(label)).alias("_hi"))
    both = ranked.withColumn("_k", k).join(per, "_k")
    conflict, first = F.col("_lo") != F.col("_hi"), F.col("_o") == F.col("_first")
    rest = ["_o", "_k", "_first", "_lo", "_hi"]
    kept = both.where(~conflict & first).drop(*rest)
    dropped = both.where(conflict | ~first).withColumn("reason", F.when(conflict, "label_conflict").otherwise("duplicate")).drop(*rest)
    return kept, dropped


def cap_groups(df: DataFrame, group: str, capped: Column, cap: int, order: list[Column]) -> DataFrame:
    """At most cap rows, first in order, of each group where `capped` holds; all others."""
    some = first_per_group(df.where(capped), [group], order, cap)
    return some.unionByName(df.where(~F.coalesce(capped, F.lit(False))))


def round_robin(df: DataFrame, strata: list[str], order: list[Column], most: int) -> DataFrame:
    """most rows, taken one from each stratum in turn. Only the first `most` rows of a stratum can be chosen."""
    w = Window.partitionBy(*strata).orderBy(*order)
    turns = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return turns.orderBy("_r", *strata).limit(most).drop("_r")


def spaced(df: DataFrame, by: list[str], order: list[Column], k: int, offset: int = 0) -> DataFrame:
    """k rows of each group at equal distances from offset on (modulo the distance); all rows of a smaller group."""
    w = Window.partitionBy(*by)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    at = F.col("_r") - 1 - F.pmod(F.lit(offset), step)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return rows.where((at >= 0) & (F.pmod(at, step) == 0) & (at < step * k)).drop("_r", "_n")


def hashed(seed: int, group: str) -> Column:
    """The hexadecimal md5 of seed and group: an order that other engines can compute too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))


def half_split(df: DataFrame, group: str, seed: int) -> DataFrame:
    """group, half: half of the distinct groups (the larger one, if they are odd) "dev", the others "frozen", by hash
    order. Null groups are left out. Groups are counted by ranges of hashes (65,536 counts come to the driver), and only
    the range that holds the middle is ordered, so groups are not gathered in one task."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_h", hashed(seed, group))
    groups = materialize(groups, "half-groups")
    counts = {r["b"]: r["count"] for r in groups.groupBy(F.substring("_h", 1, 4).alias("b")).count().collect()}
    left, cut = (sum(counts.values()) + 1) // 2, ""
    for b in sorted(counts):
        if left <= counts[b]:
            cut = groups.where(F.col("_h").startswith(b)).orderBy("_h").limit(left).agg(F.max("_h")).first()[0]
            break
        left -= counts[b]
    return groups.select(group, F.when(F.col("_h") <= cut, "dev").otherwise("frozen").alias("half"))


def holdout(df: DataFrame, group: str, seed: int, k: int) -> DataFrame:
    """The k distinct groups that come first in hash order."""
    return df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(hashed(seed, group), group).limit(k)


def relabel(df: DataFrame, value: str) -> DataFrame:
    """value, new: the distinct values numbered from 0 in order. For class and region labels, which are few."""
    return df.select(value).distinct().withColumn("new", F.dense_rank().over(Window.orderBy(value)) - 1)
