"""Model scoring against plain loops, and fitting on separable data."""

import math
import random

import numpy as np
import pytest

from tallyframe.operators import models

CLASSES = ["light", "medium", "dark"]
BASE = {"features": ["a", "b"], "classes": CLASSES, "mean": [0.5, -0.5], "scale": [2.0, 1.0]}


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def rows(spark, n=60):
    rnd = random.Random(1)
    data = [(i, rnd.gauss(0, 2), rnd.gauss(0, 1)) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, a double, b double")


def check(spark, spec, plain):
    data, df = rows(spark)
    got = {r.id: r for r in models.score_model(df, spec).collect()}
    for i, a, b in data:
        want = plain([(a - 0.5) / 2, b + 0.5])
        assert [got[i][f"prob_{c}"] for c in CLASSES] == pytest.approx(want, abs=1e-9)
        assert got[i].label_pred == CLASSES[want.index(max(want))]


def test_mlp(spark):
    spec = BASE | {"kind": "mlp", "layers": [{"W": [[1.0, -1.0], [0.5, 2.0]], "b": [0.1, -0.1]}, {"W": [[1.0, 0.0, -1.0], [0.5, 1.0, 0.0]], "b": [0.0, 0.2, 0.1]}]}

    def plain(x):
        h = [max(0.0, sum(x[i] * spec["layers"][0]["W"][i][j] for i in range(2)) + spec["layers"][0]["b"][j]) for j in range(2)]
        return softmax([sum(h[i] * spec["layers"][1]["W"][i][j] for i in range(2)) + spec["layers"][1]["b"][j] for j in range(3)])

    check(spark, spec, plain)
    with pytest.raises(ValueError):
        models.scorer_of(spec | {"layers": spec["layers"][:1]})


def test_forest(spark):
    trees = [
        {"children_left": [1, -1, 3, -1, -1], "children_right": [2, -1, 4, -1, -1], "feature": [0, -2, 1, -2, -2], "threshold": [0.0, 0, 0.25, 0, 0], "value": [[1, 1, 1], [4, 1, 0], [1, 1, 1], [0, 3, 1], [0, 1, 9]]},
        {"children_left": [-1], "children_right": [-1], "feature": [-2], "threshold": [0], "value": [[1, 2, 1]]},
    ]

    def plain(x):
        leaf = [4, 1, 0] if x[0] <= 0 else [0, 3, 1] if x[1] <= 0.25 else [0, 1, 9]
        p = [(u / sum(leaf) + v / 4) / 2 for u, v in zip(leaf, (1, 2, 1))]
        return softmax([math.log(max(q, 1e-15)) for q in p])

    check(spark, BASE | {"kind": "forest", "trees": trees}, plain)
    with pytest.raises(ValueError):
        models.scorer_of(BASE | {"kind": "forest", "trees": [trees[0] | {"children_left": [0, -1, 3, -1, -1]}]})


def test_svm(spark):
    vectors, dual = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], [[1.0, -0.5, 0.3, -0.8], [0.7, 0.2, -0.4, -0.6]]
    spec = BASE | {"kind": "svm_rbf", "support_vectors": vectors, "n_support": [1, 2, 1], "dual_coef": dual, "intercept": [0.1, -0.2, 0.05], "gamma": 0.5, "estimator_classes": ["dark", "light", "medium"], "temperature": 1.0}

    # one against one, from the definition: for each pair of classes the weight of every vector; a vector of the first
    # class has it in row (second - 1) of the dual coefficients, one of the second in row (first)
    pairs = {(0, 1): ([1.0, -0.5, 0.3, 0.0], 0.1), (0, 2): ([0.7, 0.0, 0.0, -0.8], -0.2), (1, 2): ([0.0, 0.2, -0.4, -0.6], 0.05)}

    def plain(x):
        near = [math.exp(-0.5 * math.dist(x, v) ** 2) for v in vectors]
        side = {p: sum(w * q for w, q in zip(weights, near)) + b for p, (weights, b) in pairs.items()}
        total = {c: sum(d if c == p[0] else -d for p, d in side.items() if c in p) for c in range(3)}
        won = {c: sum(c == (p[0] if d >= 0 else p[1]) for p, d in side.items()) for c in range(3)}
        return softmax([won[c] + total[c] / (3 * (abs(total[c]) + 1)) for c in (1, 2, 0)])

    check(spark, spec, plain)


def test_fit_softmax(spark):
    rnd = random.Random(2)
    data = [(x := rnd.uniform(-3, 3), rnd.gauss(0, 1), "dark" if x < -1 else "medium" if x < 1 else "light") for _ in range(300)]
    df = spark.createDataFrame(data, "a double, b double, y string")
    spec = models.fit_softmax(df, ["a", "b"], "y", CLASSES, c=100.0)
    out = models.score_model(df, spec)
    assert out.where("label_pred = y").count() > 280
    with pytest.raises(ValueError):
        models.fit_softmax(df.where("y <> 'dark'"), ["a", "b"], "y", CLASSES)
    with pytest.raises(ValueError):
        models.scorer_of(spec | {"kind": "oracle"})


def test_weighted_softmax_is_where_the_gradient_is_zero(spark):
    rng = np.random.default_rng(6)
    n, c = 240, 2.0
    y = rng.integers(0, 3, n)
    x = np.stack([y * 1.5 + rng.normal(0, 1, n), rng.normal(50, 9, n)], 1)
    w = rng.integers(0, 4, n).astype(float)
    names = [CLASSES[i] for i in y]
    rows = [(float(a), float(b), k, float(q)) for (a, b), k, q in zip(x, names, w)]
    odd = [(1.0, 2.0, "other", 1.0), (None, 2.0, CLASSES[0], 1.0), (1.0, float("nan"), CLASSES[0], 1.0), (1.0, 2.0, CLASSES[0], None), (1.0, 2.0, None, 1.0)]
    schema = "a double, b double, y string, w double"
    spec = models.fit_softmax(spark.createDataFrame(rows + odd, schema), ["a", "b"], "y", CLASSES, c=c, weight="w")
    mean = (w[:, None] * x).sum(0) / w.sum()
    scale = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
    assert spec["mean"] == pytest.approx(mean) and spec["scale"] == pytest.approx(scale)
    z, hot = (x - mean) / scale, np.eye(3)[y]
    per = np.array([w[y == k].sum() for k in range(3)])
    own = w * (w.sum() / (3 * per))[y]
    weights, bias = np.array(spec["weights"]), np.array(spec["bias"])
    logits = z @ weights.T + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.abs(c * ((p - hot) * own[:, None]).T @ z + weights).max() < 1e-2 and np.abs(((p - hot) * own[:, None]).sum(0)).max() < 1e-2
    twice = models.fit_softmax(spark.createDataFrame([r[:3] for r in rows for _ in range(int(r[3]))], "a double, b double, y string"), ["a", "b"], "y", CLASSES, c=c)
    assert np.array(twice["weights"]) == pytest.approx(weights, abs=1e-4) and twice["mean"] == pytest.approx(spec["mean"])
