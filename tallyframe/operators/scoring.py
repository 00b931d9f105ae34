"""Scoring with fitted parameters as column arithmetic; the parameters are literals."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.selection import percentiles

SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_scorer(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """Makes a scorer, a function of DataFrames, available by name; a name can be taken once."""
    if name in SCORERS:
        raise ValueError(f"scorer {name!r} is registered already")
    SCORERS[name] = f


def scorer(name: str) -> Callable[[DataFrame], DataFrame]:
    try:
        return SCORERS[name]
    except KeyError:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(SCORERS)}") from None


def ordinal(x: Column, low: float, high: float, classes: tuple[str, str, str]) -> Column:
    """The class of a value by two thresholds."""
    return F.when(x < low, classes[0]).when(x < high, classes[1]).otherwise(classes[2])


def argmax(values: list[Column], names: list[str]) -> Column:
    """The name of the largest value; the first of ties."""
    best = F.greatest(*values)
    out = F.lit(names[-1])
    for v, n in list(zip(values, names, strict=True))[-2::-1]:
        out = F.when(v == best, n).otherwise(out)
    return out


def dot(x: list[Column], w: list[float]) -> Column:
    total = F.lit(0.0)
    for c, k in zip(x, w, strict=True):
        total = total + c * F.lit(float(k))
    return total


def dot_array(x: Column, w: list[float]) -> Column:
    """The product of an array of numbers with as many weights, added in their order."""
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(k)) for k in w]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, y: s + y)


def softmax(logits: list[Column], temperature: float = 1.0) -> list[Column]:
    scaled = [z / F.lit(float(temperature)) for z in logits]
    top = F.greatest(*scaled)
    e = [F.exp(z - top) for z in scaled]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def standardized(x: Column, mean: float, scale: float) -> Column:
    return (x - F.lit(float(mean))) / F.lit(float(scale) if scale else 1.0)


def prior_fusion(p: list[Column], prior: list[Column], weight: float) -> list[Column]:
    """p * prior ** weight, made to sum to one; a prior below 1e-9 counts as that. The weight must be finite and not
    negative."""
    if not (math.isfinite(weight) and weight >= 0):
        raise ValueError("the prior's weight must be finite and not negative")
    raw = [a * F.power(F.greatest(b, F.lit(1e-9)), F.lit(float(weight))) for a, b in zip(p, prior, strict=True)]
    total = sum(raw[1:], raw[0])
    return [r / total for r in raw]


def geometric_pool(df: DataFrame, by: list[str], probs: list[str], weight: str) -> DataFrame:
    """by.., probs: the weighted mean of log-probabilities of each key's views, each view made to sum to one first, and
    the result too. Probabilities must be finite, not negative and not all 0, weights finite, not negative and not all
    0 in a key: anything else is an error."""
    w = F.col(weight).cast("double")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))
    own = sum((F.col(c) for c in probs[1:]), F.col(probs[0]))
    good = fine(w) & (own > 0)
    for c in probs:
        good = good & fine(F.col(c).cast("double"))
    stop = F.raise_error(F.lit("a view's probabilities or weight cannot be pooled")).cast("double")
    views = df.select(*by, w.alias("_w"), *[F.when(good, F.ln(F.greatest(F.col(c) / own, F.lit(1e-12)))).otherwise(stop).alias(c) for c in probs])
    total = F.when(F.sum("_w") > 0, F.sum("_w")).otherwise(stop)
    pooled = views.groupBy(*by).agg(*[(F.sum(F.col("_w") * F.col(c)) / total).alias(c) for c in probs])
    top = F.greatest(*probs)
    e = [F.exp(F.col(c) - top) for c in probs]
    return pooled.select(*by, *[(x / sum(e[1:], e[0])).alias(c) for x, c in zip(e, probs, strict=True)])


def choose_temperature(df: DataFrame, logits: list[str], truth: str, classes: list[str], grid: list[float]) -> DataFrame:
    """The temperature of the grid with the least log loss, of equals the one nearest 1. Every row is scored at
    each grid point in one projection; sums are pre-aggregated."""
    z = [F.col(c) for c in logits]

    def loss(t: float) -> Column:
        p = softmax(z, t)
        own = F.lit(None).cast("double")
        for c, q in zip(classes, p, strict=True):
            own = F.when(F.col(truth) == c, q).otherwise(own)
        return F.avg(-F.ln(F.greatest(own, F.lit(1e-15))))

    losses = df.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.round(f"t{i}", 9).alias("nll"), F.abs(F.lit(float(t)) - 1).alias("d"), F.lit(float(t)).alias("temperature")) for i, t in enumerate(grid)])
    return losses.select(F.array_min(rows).alias("b")).select("b.temperature", "b.nll")


def fit_thresholds(df: DataFrame, x: str, truth: str, classes: tuple[str, str, str]) -> DataFrame:
    """low, high, macro_f1: the pair of percentiles 1..99 of x with the best macro F1 of the ordinal rule; the
    first best in order of (low, high).

    Rows are reduced to counts per (percentile interval, class) first, so the pairs are judged on a table of 300
    rows at most, not on the rows.
    """
    found = percentiles(df, [], {"q": x}, [i / 100 for i in range(1, 100)]).first()  # 99 numbers
    if found is None:
        raise ValueError("no values to fit on")
    cuts = sorted(set(found["q"]))
    bin_ = sum((F.col(x) >= F.lit(c)).cast("int") for c in cuts)
    table = df.groupBy(bin_.alias("b"), truth).count().collect()  # at most 100 x classes rows
    count = {(r["b"], r[truth]): r["count"] for r in table}
    below = {c: [0] for c in classes}
    for c in classes:
        for b in range(len(cuts) + 1):
            below[c].append(below[c][-1] + count.get((b, c), 0))
    total = {c: below[c][-1] for c in classes}
    best = (-1.0, 0.0, 0.0)
    for i in range(len(cuts)):
        for j in range(i, len(cuts)):  # equal thresholds leave out the middle class
            f1 = 0.0
            spans = ((0, i + 1), (i + 1, j + 1), (j + 1, len(cuts) + 1))
            for c, (a, b) in zip(classes, spans, strict=True):
                hit = below[c][b] - below[c][a]
                said = sum(below[k][b] - below[k][a] for k in classes)
                f1 += 2 * hit / (said + total[c]) if said + total[c] else 0.0
            if f1 / 3 > best[0] + 1e-15:
                best = (f1 / 3, cuts[i], cuts[j])
    return df.sparkSession.createDataFrame([(float(best[1]), float(best[2]), best[0])], "low double, high double, macro_f1 double")
