"""Classification and count metrics as aggregations: confusion, per-class scores, folds, calibration, intervals.

All of them reduce to one partial aggregation by (key, truth, prediction); what follows runs on a table of
keys x classes x classes rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, pred: str, classes: list[str], by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """by.., truth, pred, n (count, or sum of weight) for every pair of classes, absent pairs with 0. Rows with
    another class on either side are ignored. Keys in `by` are those of df."""
    n = F.count("*") if weight is None else F.sum(weight)
    known = df.where(F.col(truth).isin(classes) & F.col(pred).isin(classes))
    cells = [F.struct(F.lit(a).alias("truth"), F.lit(b).alias("pred")) for a in classes for b in classes]
    counted = known.groupBy(*by, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(n.alias("_n"))
    per = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x00", "_t", "_p"), "_n"))).alias("_m"))  # at most one entry a cell
    cell = F.explode(F.array(*cells)).alias("_c")
    zero = F.lit(0).cast("long") if weight is None else F.lit(0.0)
    return per.select(*by, "_m", cell).select(*by, "_c.truth", "_c.pred", F.coalesce(F.try_element_at("_m", F.concat_ws("\x00", "_c.truth", "_c.pred")), zero).alias("n"))


def class_scores(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by.., class, precision, recall, f1, support from a confusion table; undefined scores are 0."""
    both = matrix.select(*by, "n", F.explode(F.array_distinct(F.array("truth", "pred"))).alias("class"), "truth", "pred")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, p = F.col("truth") == F.col("class"), F.col("pred") == F.col("class")
    sums = both.groupBy(*by, "class").agg(s(t & p).alias("tp"), s(t).alias("support"), s(p).alias("predicted"))
    return sums.select(
        *by, "class", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "support",
    )


def summary(matrix: DataFrame, extremes: tuple[str, str], by: tuple[str, ...] = (), all_classes: bool = False) -> DataFrame:
    """by.., n, acc, macro_f1, cross_step, cross_step_rate. The macro F1 is over classes that occur in the truth,
    or over all classes; crossing is a prediction at the other end of the order, per row of any class."""
    n = F.col("n")
    a, b = extremes
    crossing = ((F.col("truth") == a) & (F.col("pred") == b)) | ((F.col("truth") == b) & (F.col("pred") == a))
    totals = matrix.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("truth") == F.col("pred"), n).otherwise(0)).alias("hit"), F.sum(F.when(crossing, n).otherwise(0)).alias("cross_step"))
    per = class_scores(matrix, by)
    mean = F.avg("f1") if all_classes else F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0))
    macro = per.groupBy(*by).agg(mean.alias("macro_f1"))
    both = totals.join(macro, list(by)) if by else totals.join(F.broadcast(macro))  # one row
    return both.select(*by, "n", ratio(F.col("hit"), n).alias("acc"), "macro_f1", "cross_step", ratio(F.col("cross_step"), n).alias("cross_step_rate"))


def calibration_bins(df: DataFrame, correct: Column, confidence: Column, bins: int = 10) -> DataFrame:
    """bin, lower, upper, n, accuracy, confidence for every bin; empty bins keep null means. A confidence lies in
    bin floor(confidence * bins), the last one closed."""
    b = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    per = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(per, "bin", "left").select(
        "bin", (F.col("bin") / F.lit(float(bins))).alias("lower"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "confidence"
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return bins.agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def half_open_error(df: DataFrame, correct: Column, confidence: Column, bins: int = 10) -> DataFrame:
    """ece over bins [i / bins, (i + 1) / bins), the last closed. A confidence is compared with the borders; its bin is
    not computed from it, as a product can round across a border. Confidences outside 0 to 1 lie in no bin."""
    b = F.lit(None).cast("int")
    for i in range(bins):
        b = F.when((confidence >= i / bins) & ((confidence <= 1) if i == bins - 1 else (confidence < (i + 1) / bins)), i).otherwise(b)
    per = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf")))
    return per.agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"))


def log_loss(p: Column) -> Column:
    return F.avg(-F.ln(F.greatest(p, F.lit(1e-15))))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of k successes of n; 0 and 0 where n is 0."""
    none, n = n == 0, F.when(n > 0, n.cast("double"))
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(none, 0.0).otherwise(mid - half), F.when(none, 0.0).otherwise(mid + half)


#: Resamples drawn at once.
AT_ONCE = 16


def bootstrap_mean(df: DataFrame, value: str, key: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """n, mean, low, high: the 95 % interval of the mean by Poisson resampling, each row's weight in each resample
    drawn from a hash of (seed, key, value, resample), so the interval does not hang on the files' layout; rows that
    agree in key and value are drawn alike. Each task sums its rows' weights by resample, so two
    sums a resample leave it; no rows are collected. An empty table is unmeasured: n 0 and nulls."""
    cuts, p, c = [], math.exp(-1), 0.0
    for k in range(12):
        c += p
        cuts.append(np.uint32(min(round(c * 2**32), 2**32 - 1)))
        p /= k + 1
    odd, mul = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights, any_ = np.zeros(resamples), np.zeros(resamples), False
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 14):
                any_ = True
                part = batch.slice(lo, 1 << 14)
                v, key = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)
                for r in range(0, resamples, AT_ONCE):
                    h = key[None] + np.arange(r + 1, min(r + AT_ONCE, resamples) + 1, dtype=np.uint64)[:, None] * odd
                    h = (h ^ (h >> np.uint64(32))) * mul
                    h = (h ^ (h >> np.uint64(29))) * odd
                    u = (h >> np.uint64(32)).astype(np.uint32)
                    w = np.zeros(u.shape, np.uint8)
                    for cut in cuts:
                        w += u >= cut
                    sums[r : r + AT_ONCE] += w.astype(np.float64) @ v
                    weights[r : r + AT_ONCE] += w.sum(1, dtype=np.int64)
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums), pa.array(weights)], ["r", "s", "w"])

    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(key).alias("k"))
    keyed = rows.select("v", F.xxhash64(F.lit(seed), "k", "v").alias("key"))
    means = keyed.mapInArrow(run, "r long, s double, w double").groupBy("r").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    total = rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return total.join(F.broadcast(means.agg(q[0].alias("low"), q[1].alias("high"))))  # one row each
