"""Grouped statistics: exact percentiles, feature vectors, histograms, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.selection import with_percentiles


def histogram_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value, from 0; the last is closed, values outside go to the end bins."""
    return F.greatest(F.lit(0), F.least(F.floor((x - F.lit(float(low))) * bins / (high - low)), F.lit(bins - 1))).cast("int")


def feature_vector(df: DataFrame, by: list[str], l: str, a: str, b: str, bins: int = 8) -> DataFrame:
    """20 features of each group: five percentiles, mean, population deviation and interquartile range of l, the
    medians of a, b and chroma, the hue of the medians, and the normalized histogram of l over 0..100."""
    hist = histogram_bin(F.col(l), 0, 100, bins)
    g = df.groupBy(*by).agg(F.avg(l).alias("mean"), F.stddev_pop(l).alias("std"), F.count(l).alias("n"), *[F.count_if(hist == k).alias(f"h{k}") for k in range(bins)])
    g = with_percentiles(g, df, by, {"_l": l, "_a": a, "_b": b, "_c": F.hypot(F.col(a), F.col(b))}, [0.05, 0.25, 0.5, 0.75, 0.95])
    q, a_med, b_med = F.col("_l"), F.col("_a")[2], F.col("_b")[2]
    return g.select(
        *by, *[q[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], "mean", "std", (q[3] - q[1]).alias("iqr"),
        a_med.alias("a_med"), b_med.alias("b_med"), F.col("_c")[2].alias("c_med"), F.degrees(F.atan2(b_med, a_med)).alias("hue"), *[(F.col(f"h{k}") / F.col("n")).alias(f"h{k}") for k in range(bins)],
    )


def latency(df: DataFrame, by: list[str], ms: str) -> DataFrame:
    """n, p50, p95, max, mean of each key; nulls where nothing was measured."""
    g = df.groupBy(*by).agg(F.count(ms).alias("n"), F.max(ms).alias("max"), F.avg(ms).alias("mean"))
    q = F.col("_q")
    return with_percentiles(g, df, by, {"_q": ms}, [0.5, 0.95]).select(*by, "n", q[0].alias("p50"), q[1].alias("p95"), "max", "mean")


def latency_rollup(df: DataFrame, by: str, stages: list[str]) -> DataFrame:
    """Latency by key and stage, and over all keys ("ALL")."""
    long = df.select(by, F.explode(F.map_from_arrays(F.array(*map(F.lit, stages)), F.array(*stages))).alias("stage", "ms"))
    # each row counts for its own key and for all: told apart by a flag, as a key may be null or named ALL
    both = long.select(F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col(by).alias(by)), F.struct(F.lit(True).alias("all"), F.lit(None).alias(by)))).alias("k"), "stage", "ms").select("k.*", "stage", "ms")
    return latency(both, ["all", by, "stage"], "ms").select(F.when(F.col("all"), "ALL").otherwise(F.col(by)).alias(by), "stage", "n", "p50", "p95", "max")


def set_digest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sha256 of each group's distinct values, sorted and joined by newlines. Values are first reduced to the
    distinct ones in each task; a group's own must fit in one."""
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), "\n"), 256).alias("digest"))
