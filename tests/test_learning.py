"""Forest fits and nested evaluation against plain loops; streams with a state store."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import folds, forest, models, network
from tallyframe.streaming import first

CLASSES = ["A", "N", "R"]


def table(n=260, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = np.stack([y + rng.normal(0, 0.8, n), rng.integers(0, 4, n) - y * 0.5, rng.normal(0, 1, n)], 1).round(3)
    return x, y


def plain_forest(x, y, keys, shape, edges):
    """Each tree on its own, by recursion over the drawn rows."""
    x = x.astype(np.float32).astype(float)
    n, m = len(y), 3
    weight = np.array([n / (m * (y == c).sum()) for c in range(m)])
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    drawn = forest.draws(keys, shape)

    def purity(w):
        return (w**2).sum() / w.sum() if w.sum() else 0.0

    def sums(rows, t):
        return np.array([sum(drawn[i, t] * weight[c] for i in rows if y[i] == c) for c in range(m)])

    def grow(rows, t, node, depth):
        value, best = sums(rows, t), (1e-12, None)
        if depth < shape.depth:
            for j in forest.tried_features(t, node, x.shape[1], shape):
                for b in range(shape.bins - 1):
                    left, right = [i for i in rows if bins[i, j] <= b], [i for i in rows if bins[i, j] > b]
                    if min(drawn[left, t].sum(), drawn[right, t].sum()) < shape.least:
                        continue
                    gain = purity(sums(left, t)) + purity(sums(right, t)) - purity(value)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (j, b, left, right))
        if best[1] is None:
            return {"value": value}
        j, b, left, right = best[1]
        return {"feature": j, "cut": edges[j][b], "left": grow(left, t, 2 * node, depth + 1), "right": grow(right, t, 2 * node + 1, depth + 1)}

    trees = [grow([i for i in range(n) if drawn[i, t] > 0], t, 1, 0) for t in range(shape.trees)]

    def said(row):
        out = np.zeros(m)
        for tree in trees:
            while "feature" in tree:
                tree = tree["left"] if row[tree["feature"]] <= tree["cut"] else tree["right"]
            out += tree["value"] / tree["value"].sum() / len(trees)
        return out

    return np.array([said(r) for r in x])


@pytest.mark.parametrize("shape", [forest.ForestShape(trees=3, depth=3, bins=8, tried=2), forest.ForestShape(trees=1, depth=4, bins=16, tried=0, least=9, bootstrap=False)])
def test_forest_equals_a_loop(spark, shape):
    x, y = table()
    keys = np.arange(len(y)) * 7 - 3
    rows = [(int(k), *map(float, r), CLASSES[c]) for k, r, c in zip(keys, x, y, strict=True)]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0, "A"), (2, 1.0, 1.0, 1.0, "odd"), (3, 1.0, 1.0, 1.0, None)], "k long, a double, b double, c double, label string").repartition(3)
    spec = forest.fit_forest(df, ["a", "b", "c"], "label", CLASSES, F.col("k"), shape)
    single = x.astype(np.float32).astype(float)
    edges = [np.unique([np.percentile(single[:, j], 100 * i / shape.bins) for i in range(1, shape.bins)]) for j in range(3)]
    want = plain_forest(x, y, keys, shape, edges)
    got = models.scorer_of(spec)(x)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)
    assert (got.argmax(1) == y).mean() > 0.6
    with pytest.raises(ValueError):
        forest.fit_forest(df.where("label = 'A'"), ["a"], "label", CLASSES, F.col("k"), shape)


def plain_nested(rows, grid, k):
    """rows: (source, group, class, features, may train)."""
    inner = lambda g: int(hashlib.md5(str(g).encode()).hexdigest()[:8], 16) % k

    def fit(train):
        out = []
        for c in CLASSES:
            v = np.array([r[3] for r in train if r[2] == c])
            out.append((len(v), v.mean(0), (v**2).mean(0) - v.mean(0) ** 2) if len(v) else None)
        return out

    def say(model, x, smooth):
        scores = [-math.inf if m is None else math.log(m[0]) - (np.log(np.maximum(m[2], 0) + smooth) + (x - m[1]) ** 2 / (np.maximum(m[2], 0) + smooth)).sum() / 2 for m in model]
        return CLASSES[int(np.argmax(scores))] if max(scores) > -math.inf else None

    def f1(pairs):
        f = []
        for c in CLASSES:
            true, said = sum(t == c for t, _ in pairs), sum(s == c for _, s in pairs)
            if true:
                f.append(2 * sum(t == s == c for t, s in pairs) / (true + said))
        return sum(f) / len(f)

    out = {}
    for held in {r[0] for r in rows}:
        train = [r for r in rows if r[4] and r[0] != held]
        best = None
        for g in grid:
            pairs = [(r[2], say(fit([q for q in train if inner(q[1]) != i]), np.array(r[3]), g)) for i in range(k) for r in train if inner(r[1]) == i]
            if pairs and (best is None or round(f1(pairs), 9) > round(best[0], 9)):
                best = (f1(pairs), g)
        own = [(r[2], say(fit(train), np.array(r[3]), best[1])) for r in rows if r[0] == held] if best else []
        out[held] = (len(train), best[1], best[0], sum(a == b for a, b in own) / len(own), f1(own)) if best else None
    return out


@pytest.mark.parametrize("most", [20_000, 0])
def test_nested_leave_one_out_equals_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(folds, "BROADCAST_MODELS", most)
    x, y = table(90, 5)
    rows = [("abc"[i % 3] if i % 7 else "d", i // 2, CLASSES[c], tuple(map(float, r)), i % 5 > 0) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([(s, g, c, *f, u) for s, g, c, f, u in rows] + [(None, 1, "A", 1.0, 1.0, 1.0, True), ("a", 1, "odd", 1.0, 1.0, 1.0, True), ("a", 1, "A", None, 1.0, 1.0, True)], "source string, g long, label string, p double, q double, r double, use boolean")
    grid = [10.0, 0.01, 1.0]
    out = folds.nested_leave_one_out(df, "source", F.col("g"), "label", CLASSES, ["p", "q", "r"], grid, 3, F.col("use")).collect()
    want = plain_nested(rows, grid, 3)
    assert {r.fold for r in out} == set(want)
    for r in out:
        assert (r.train, r.choice, r.inner_f1, r.acc, r.macro_f1) == (want[r.fold][0], want[r.fold][1], *[pytest.approx(v) for v in want[r.fold][2:]])
    assert folds.nested_leave_one_out(df.limit(0), "source", F.col("g"), "label", CLASSES, ["p"], grid).count() == 0


def test_first_of_key_over_batches_and_a_restart(spark, tmp_path):
    schema = "k string, i long, v double"
    inbox, out, sums = (str(tmp_path / x) for x in ("in", "out", "sums"))
    batches = [[("a", 2, 1.0), ("a", 1, 2.0), ("b", 3, 3.0), (None, 4, 9.0)], [("a", 0, 5.0), ("c", 5, 7.0), ("c", 6, 8.0)], [("b", -1, 1.0), ("d", 7, None)]]

    def arrive(i):
        spark.createDataFrame(batches[i], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        first.start_first(stream, "k", "i", out, str(tmp_path / "c1")).awaitTermination()
        first.start_totals(spark.readStream.schema(schema).parquet(out), "k", "v", sums, str(tmp_path / "c2")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(out).collect()), {r.k: (r.n, r.total) for r in spark.read.parquet(sums).collect()}

    assert arrive(0)[0] == [("a", 1, 2.0), ("b", 3, 3.0)]
    assert arrive(1)[0] == [("a", 1, 2.0), ("b", 3, 3.0), ("c", 5, 7.0)]
    rows, totals = arrive(2)
    assert rows == [("a", 1, 2.0), ("b", 3, 3.0), ("c", 5, 7.0), ("d", 7, None)]
    assert totals == {"a": (1, 2.0), "b": (1, 3.0), "c": (1, 7.0), "d": (1, None)}


def test_mlp_equals_a_plain_loop(spark):
    x, y = table(150, 9)
    rows = [(*map(float, r), CLASSES[c]) for r, c in zip(x, y, strict=True)]
    odd = [(None, 1.0, 1.0, "A"), (float("nan"), 1.0, 1.0, "A"), (1.0, 1.0, 1.0, "odd"), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "a double, b double, c double, label string").withColumn("k", F.lit(3.0)).repartition(3)
    spec, losses = network.fit_mlp(df, ["a", "b", "c", "k"], "label", CLASSES, hidden=5, alpha=0.1, epochs=25, rate=0.05)
    full = np.concatenate([x, np.full((len(x), 1), 3.0)], 1)
    z = (full - full.mean(0)) / np.where(full.std(0) > 0, full.std(0), 1)
    w = np.array([1 / (3 * (y == c).sum()) for c in range(3)])[y]
    layers = network.Layers(4, 5, 3)
    p = layers.start(7)
    square = np.concatenate([np.ones(20), np.zeros(5), np.ones(15), np.zeros(3)]) * 0.1 / len(y)

    def loss(q):
        w1, b1, w2, b2 = layers.parts(q)
        s = np.maximum(z @ w1 + b1, 0) @ w2 + b2
        return float((w * (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y])).sum() + (square * q * q).sum() / 2)

    m, v, want = 0.0, 0.0, []
    for step in range(1, 26):
        want.append(loss(p))
        g = np.array([(loss(p + 1e-6 * d) - loss(p - 1e-6 * d)) / 2e-6 for d in np.eye(len(p))])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert losses == pytest.approx(want, rel=1e-4) and losses[-1] < losses[0]
    assert (models.scorer_of(spec)(full).argmax(1) == y).mean() > 0.6
    with pytest.raises(ValueError):
        network.fit_mlp(df.where("label = 'A'"), ["a"], "label", CLASSES)


def test_sweep_extends_at_the_lower_end_and_refuses(spark):
    x, y = table(120, 6)
    rows = [("abcd"[i % 4], CLASSES[c], *map(float, r)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "source string, label string, p double, q double, r double")
    run = lambda grid, below, **more: {r.choice: r for r in folds.leave_one_out_sweep(df, "source", "label", CLASSES, ["p", "q", "r"], grid, below, **more).collect()}
    low, high = run([0.01, 1.0, 1e6], [1e-4]), run([0.01, 1.0, 1e6], [])
    best = [c for c, r in low.items() if r.best]
    assert len(best) == 1 and set(high) == {0.01, 1.0, 1e6} and (1e-4 in low) == low[0.01].extended
    forced = run([1e6, 1e7], [0.01])  # such smoothings say one class alike: the lower end wins
    assert forced[1e6].extended and forced[0.01].best
    assert set(run([0.01, 1e6], [1e-4], known={1e6: high[1e6].mean_f1})) >= {0.01, 1e6}
    with pytest.raises(ValueError, match="as before"):
        run([0.01, 1e6], [], known={1e6: high[1e6].mean_f1 + 0.01})
    for c in (0.01, 1e6):
        own = {s: folds.nested_leave_one_out(df, "source", F.lit(1), "label", CLASSES, ["p", "q", "r"], [c], 1).where(F.col("fold") == s) for s in "a"}
        assert high[c].worst_f1 <= high[c].mean_f1 <= 1 and own["a"].count() <= 1
    assert folds.leave_one_out_sweep(df.limit(0), "source", "label", CLASSES, ["p"], [1.0], []).count() == 0


def test_residual_pairs_and_the_guard(spark):
    from tallyframe.operators import relations as J

    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "k long, g string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (4, 4), (3, 9)], "a long, b long")
    got = sorted((r.a, r.b, r.group_a, r.group_b) for r in J.residual_pairs(pairs, groups, "k", "g").collect())
    assert got == [(1, 3, "x", "y"), (2, 4, "x", None), (3, 9, "y", None), (4, 4, None, None)]
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert sorted(tuple(r) for r in J.guarded(rows(1, 2), groups, pairs, "k", "g").collect()) == [(1, "x"), (2, "x")]
    for bad, why in (((1, 3), "different groups"), ((1, 4), "without a group"), ((1, 9), "without a group")):
        with pytest.raises(ValueError, match=why):
            J.guarded(rows(*bad), groups, pairs, "k", "g")


def test_shortcut_probe_against_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("told", 90), ("noise", 90), ("one class", 20), ("one group", 12)):
        for i in range(n):
            g = f"{s}{0 if s == 'one group' else i % 15}"
            y = "A" if s == "one class" else CLASSES[(i % 15) % 3]
            rows.append((s, g, y, round(CLASSES.index(y) * (3.0 if s == "told" else 0.0) + float(rng.normal()), 3)))
    df = spark.createDataFrame([*rows, ("told", None, "A", 0.0), ("told", "told1", "other", 1.0), (None, "g", "A", 1.0), ("told", "told1", "A", float("nan"))], "s string, g string, y string, x double")
    got = {r.source: r for r in folds.within_source_probe(df, "s", "g", "y", CLASSES, ["x"], smooth=0.1, folds=3, draws=12, seed=4).collect()}
    assert set(got) == {"told", "noise", "one class", "one group"}
    fold = lambda g: int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 3

    def judged(part):
        hits = {c: [0, 0, 0] for c in CLASSES}
        for _, g, y, x in part:
            best = None
            for c in CLASSES:
                train = [r[3] for r in part if r[2] == c and fold(r[1]) != fold(g)]
                if train:
                    var = max(np.mean(np.square(train)) - np.mean(train) ** 2, 0) + 0.1
                    score = math.log(len(train)) - (math.log(var) + (x - np.mean(train)) ** 2 / var) / 2
                    best = max(best or (-math.inf, ""), (score, c), key=lambda b: b[0])
            hits[y][0] += best is not None and best[1] == y
            hits[y][1] += 1
            if best:
                hits[best[1]][2] += 1
        return float(np.mean([2 * h / (t + p) for h, t, p in hits.values() if t]))

    for s in ("told", "noise"):
        part = [r for r in rows if r[0] == s]
        of = {}
        for g in sorted({r[1] for r in part}):
            ys = [r[2] for r in part if r[1] == g]
            of[g] = max(CLASSES, key=ys.count)
        null = []
        for d in range(1, 13):
            drawn = {}
            for g in of:
                u = int(hashlib.md5(f"4:{d}:{s}:{g}".encode()).hexdigest()[:8], 16) / 2**32 * len(of)
                cum = np.cumsum([list(of.values()).count(c) for c in CLASSES])
                drawn[g] = CLASSES[int(np.searchsorted(cum, u, side="right"))]
            null.append(judged([(s, g, drawn[g], x) for _, g, _, x in part]))
        real = judged(part)
        r = got[s]
        assert (r.rows, r.groups) == (90, 15) and r.macro_f1 == pytest.approx(real)
        assert (r.null_mean, r.null_low, r.null_high) == pytest.approx((np.mean(null), min(null), max(null)))
        assert r.p_value == pytest.approx((1 + sum(round(n, 9) >= round(real, 9) for n in null)) / 13)
    assert got["told"].p_value < 0.1 and got["told"].macro_f1 > 0.9 and got["noise"].macro_f1 < 0.7
    for s in ("one class", "one group"):
        assert (got[s].acc, got[s].macro_f1, got[s].null_mean, got[s].p_value) == (None,) * 4
    none = folds.within_source_probe(df.limit(0), "s", "g", "y", CLASSES, ["x"])
    assert none.count() == 0
