"""Scoring of fitted models held as plain JSON values, and fitting of the softmax model with pyspark.ml.

A spec has kind, features, classes, mean, scale, temperature (1 if absent) and its kind's arrays:
mlp: layers, each W and b, with max(x, 0) between them; forest: trees, each children_left, children_right (-1 at
leaves), feature, threshold and value; svm_rbf: support_vectors, n_support, dual_coef, intercept, gamma and
estimator_classes, one decision for each pair of classes. The arrays travel with the function; they are of the
model's fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[np.ndarray], np.ndarray]


def _normalized(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _mlp(spec: dict, width: int, n: int) -> Scorer:
    layers = [(np.array(x["W"], float), np.array(x["b"], float)) for x in spec["layers"]]
    for w, b in layers:
        if w.shape != (width, len(b)) or not (np.isfinite(w).all() and np.isfinite(b).all()):
            raise ValueError("a layer does not fit")
        width = len(b)
    if width != n:
        raise ValueError("the last layer must have an output for each class")

    def run(x: np.ndarray) -> np.ndarray:
        for w, b in layers[:-1]:
            x = np.clip(x @ w + b, 0, None)
        return _normalized(x @ layers[-1][0] + layers[-1][1])

    return run


def _forest(spec: dict, width: int, n: int) -> Scorer:
    trees = spec["trees"]
    most = max(len(t["feature"]) for t in trees)
    pad = lambda key, fill: np.array([list(t[key]) + [fill] * (most - len(t[key])) for t in trees])
    left, right, feature, cut = pad("children_left", -1), pad("children_right", -1), pad("feature", 0), pad("threshold", 0.0)
    value = np.zeros((len(trees), most, n))
    for i, t in enumerate(trees):
        v = np.array(t["value"], float).reshape(-1, n)
        if len(v) != len(t["feature"]) or (v < 0).any() or (v.sum(1) <= 0).any():
            raise ValueError("a tree's leaves do not fit")
        value[i, : len(v)] = v / v.sum(1, keepdims=True)
    node = np.arange(most)
    inner = left >= 0
    if ((right >= 0) != inner).any() or (inner & ((left <= node) | (right <= node) | (feature < 0) | (feature >= width))).any():
        raise ValueError("a tree's edges do not fit")
    every = np.arange(len(trees))

    def run(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)  # thresholds were fitted on this width
        at = np.zeros((len(x), len(trees)), int)  # all trees step down together
        while (walking := inner[every, at]).any():
            go_left = np.take_along_axis(x, np.where(walking, feature[every, at], 0), 1) <= cut[every, at]
            at = np.where(walking, np.where(go_left, left[every, at], right[every, at]), at)
        return value[every, at].mean(1)

    return run


def _svm(spec: dict, width: int, n: int) -> Scorer:
    support, gamma, own = np.array(spec["support_vectors"], float), float(spec["gamma"]), list(spec["estimator_classes"])
    if support.shape[1] != width or gamma <= 0 or sorted(own) != sorted(spec["classes"]):
        raise ValueError("support vectors do not fit")
    owner = np.repeat(np.arange(n), spec["n_support"])
    dual = np.array(spec["dual_coef"], float)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    # one column of coefficients for each pair of classes: zero but for the two classes' vectors
    weights = np.stack([np.where(owner == i, dual[j - 1], np.where(owner == j, dual[i], 0.0)) for i, j in pairs], 1)
    bias = np.array(spec["intercept"], float)
    sign = np.zeros((len(pairs), n))
    for k, (i, j) in enumerate(pairs):
        sign[k, i], sign[k, j] = 1, -1
    order = [own.index(c) for c in spec["classes"]]

    def run(x: np.ndarray) -> np.ndarray:
        apart = np.clip(((x[:, None] - support) ** 2).sum(2), 0, None) if len(support) * x.size < 1 << 24 else np.clip((x**2).sum(1)[:, None] + (support**2).sum(1) - 2 * x @ support.T, 0, None)
        decided = np.exp(-gamma * apart) @ weights + bias
        sure = decided @ sign
        votes = np.where(decided >= 0, 1.0, 0.0) @ (sign > 0) + np.where(decided < 0, 1.0, 0.0) @ (sign < 0)
        return _normalized((votes + sure / (3 * (np.abs(sure) + 1)))[:, order])

    return run


def _softmax(spec: dict, width: int, n: int) -> Scorer:
    w, b = np.array(spec["weights"], float).reshape(n, width), np.array(spec["bias"], float)
    return lambda x: _normalized(x @ w.T + b)


KINDS: dict[str, Callable[[dict, int, int], Scorer]] = {"softmax": _softmax, "mlp": _mlp, "forest": _forest, "svm_rbf": _svm}


def scorer_of(spec: dict) -> Scorer:
    """A function from rows of features to probabilities in the order of the spec's classes."""
    if spec["kind"] not in KINDS:
        raise ValueError(f"unknown kind of model {spec['kind']!r}")
    width, classes = len(spec["features"]), spec["classes"]
    mean, scale = np.array(spec["mean"], float), np.array(spec["scale"], float)
    if mean.shape != (width,) or scale.shape != (width,) or not (scale > 0).all():
        raise ValueError("mean and scale do not fit the features")
    raw, heat = KINDS[spec["kind"]](spec, width, len(classes)), float(spec.get("temperature", 1.0))

    def run(x: np.ndarray) -> np.ndarray:
        x = (x - mean) / scale
        if not np.isfinite(x).all():
            raise ValueError("a feature is not finite")
        return _normalized(np.log(np.clip(raw(x), 1e-15, None)) / heat)

    return run


def score_model(df: DataFrame, spec: dict, prefix: str = "prob_") -> DataFrame:
    """df with a probability column for each class and label, the likeliest (the first of ties)."""
    names, classes = list(spec["features"]), list(spec["classes"])
    run = scorer_of(spec)

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        return pd.Series(list(run(x))) if len(x) else pd.Series([], dtype=object)

    out = df.withColumn("_p", score(*names))
    label = F.element_at(F.array(*map(F.lit, classes)), F.array_position("_p", F.array_max("_p")).cast("int"))
    return out.select(*df.columns, *[F.col("_p")[i].alias(f"{prefix}{c}") for i, c in enumerate(classes)], label.alias("label_pred"))


def fit_softmax(df: DataFrame, features: list[str], label: str, classes: list[str], c: float = 1.0, weight: str | None = None) -> dict:
    """A multinomial softmax spec with balanced class weights and a squared penalty of strength 1 / c.

    weight: a column of row weights, 0 or more; they count in the features' means and deviations, in the classes' balance
    and in the fit, so that a row of weight 2 is as good as two rows. Rows of other classes, and those with a null or NaN
    in a feature or in the weight, are left out. The optimizer differs from other libraries', so predictions agree rather
    than weights.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(label).isin(classes)).select(F.col(label).alias("_l"), own.alias("_w"), *[F.col(x).cast("double").alias(x) for x in features])
    for x in ("_w", *features):
        rows = rows.where(F.col(x).isNotNull() & ~F.isnan(x))
    sums = [F.sum(F.col("_w") * F.col(x)).alias(f"_s{j}") for j, x in enumerate(features)]
    per = {r["_l"]: r for r in rows.groupBy("_l").agg(F.sum("_w").alias("_n"), *sums).collect()}  # a row a class
    if set(per) != set(classes) or not all(r["_n"] > 0 for r in per.values()):
        raise ValueError("a class is missing")
    total = sum(r["_n"] for r in per.values())
    mean = [sum(r[f"_s{j}"] for r in per.values()) / total for j in range(len(features))]
    # deviations are summed around the means in a second pass, as differences of squares would lose digits
    around = rows.agg(*[F.sum(F.col("_w") * (F.col(x) - m) * (F.col(x) - m)).alias(x) for x, m in zip(features, mean, strict=True)]).first()
    scale = [math.sqrt(around[x] / total) or 1.0 for x in features]
    balance, index = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, k in enumerate(classes):
        balance, index = F.when(F.col("_l") == k, total / (len(classes) * per[k]["_n"])).otherwise(balance), F.when(F.col("_l") == k, float(i)).otherwise(index)
    scaled = rows.select(*[((F.col(x) - m) / s).alias(x) for x, m, s in zip(features, mean, scale, strict=True)], index.alias("_y"), (F.col("_w") * balance).alias("_w"))
    scaled = VectorAssembler(inputCols=features, outputCol="_x").transform(scaled.where("_w > 0"))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=1 / (c * total), standardization=False, maxIter=200, tol=1e-9).fit(scaled)
    w = fit.coefficientMatrix.toArray().tolist()
    return {"kind": "softmax", "features": features, "classes": classes, "mean": mean, "scale": scale, "weights": w, "bias": fit.interceptVector.toArray().tolist()}
