"""Fitting a network of one hidden layer by synchronous gradients; models.score_model scores the result.

In each epoch every task runs its rows forward and backward in matrices and sends one gradient, the sum over its rows;
the sums are added up and the parameters, whose size does not depend on the data, take one step of Adam.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose activations are held at once.
SLICE_ROWS = 1 << 14


class Layers:
    """Parameters as one vector: hidden weights (features x hidden), their biases, output weights and biases."""

    def __init__(self, width: int, hidden: int, classes: int):
        self.shapes = [(width, hidden), (hidden,), (hidden, classes), (classes,)]
        self.cuts = np.cumsum([0, *[int(np.prod(s)) for s in self.shapes]]).tolist()

    def start(self, seed: int) -> np.ndarray:
        """Weights drawn evenly within the bound that keeps the variance of activations; biases 0."""
        rng = np.random.default_rng(seed)
        bound = lambda s: np.sqrt(6.0 / sum(s))
        return np.concatenate([rng.uniform(-bound(s), bound(s), s).ravel() if len(s) == 2 else np.zeros(s) for s in self.shapes])

    def parts(self, p: np.ndarray) -> list[np.ndarray]:
        return [p[a:b].reshape(s) for a, b, s in zip(self.cuts, self.cuts[1:], self.shapes, strict=False)]

    def gradient(self, p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The weighted sum of log losses of rows, and its gradient."""
        w1, b1, w2, b2 = self.parts(p)
        a = x @ w1 + b1
        h = np.maximum(a, 0)
        z = h @ w2 + b2
        z -= z.max(1, keepdims=True)
        log_sum = np.log(np.exp(z).sum(1))
        loss = float((w * (log_sum - z[np.arange(len(y)), y])).sum())
        e = np.exp(z - log_sum[:, None])
        e[np.arange(len(y)), y] -= 1
        e *= w[:, None]
        back = (e @ w2.T) * (a > 0)
        return loss, np.concatenate([(x.T @ back).ravel(), back.sum(0), (h.T @ e).ravel(), e.sum(0)])


def fit_mlp(df: DataFrame, features: list[str], label: str, classes: list[str], hidden: int = 16, alpha: float = 1e-4, epochs: int = 100, rate: float = 0.02, seed: int = 7) -> tuple[dict, list[float]]:
    """(mlp spec, loss before each epoch). The loss is the balanced mean log loss plus alpha / 2 times the mean square of
    the weights' norm over the rows; every epoch takes all rows. Features are standardized, a constant one by 1.

    Rows with a null or NaN in a feature, a null label or another class are left out; a class without rows is an error.
    A task that is lost is run again from the parameters it was sent, so its gradient is the same. The driver holds the
    parameters and one gradient.
    """
    index = F.lit(-1)
    for i, c in enumerate(classes):
        index = F.when(F.col(label) == c, i).otherwise(index)
    rows = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], index.alias("y")).where("y >= 0").dropna()
    for i in range(len(features)):
        rows = rows.where(~F.isnan(f"x{i}"))
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # a row a class
    if len(count) != len(classes):
        raise ValueError("a class is missing")
    total = sum(count.values())
    weight = np.array([total / (len(classes) * count[i]) for i in range(len(classes))]) / total
    moments = rows.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(len(features)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, scale = np.array([moments[f"m{i}"] for i in range(len(features))]), np.array([moments[f"s{i}"] or 1.0 for i in range(len(features))])
    layers = Layers(len(features), hidden, len(classes))
    p = layers.start(seed)
    penalized = np.concatenate([np.full(int(np.prod(s)), float(len(s) == 2)) for s in layers.shapes])
    first, second, losses = np.zeros_like(p), np.zeros_like(p), []

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, g, some = 0.0, np.zeros_like(p), False
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part, some = batch.slice(lo, SLICE_ROWS), True
                x = np.stack([part.column(i).to_numpy() for i in range(len(features))], 1)
                y = part.column(len(features)).to_numpy()
                own = layers.gradient(p, (x - mean) / scale, y, weight[y])
                loss, g = loss + own[0], g + own[1]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([[loss, *g]])], ["g"])

    for step in range(1, epochs + 1):
        # added place by place, so no task or driver holds the gradients of many tasks
        added = rows.mapInArrow(sums, "g array<double>").select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        g = np.zeros(len(p) + 1)
        for r in added:
            g[r["i"]] = r["v"]
        losses.append(float(g[0] + alpha / 2 * (penalized * p * p).sum() / total))
        g = g[1:] + alpha * penalized * p / total
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        p = p - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = layers.parts(p)
    spec = {"kind": "mlp", "features": features, "classes": classes, "mean": mean.tolist(), "scale": scale.tolist(), "layers": [{"W": w1.tolist(), "b": b1.tolist()}, {"W": w2.tolist(), "b": b2.tolist()}]}
    return spec, losses
