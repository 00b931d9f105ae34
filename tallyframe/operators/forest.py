"""Fitting a random forest level by level from histograms; models.score_model scores the result.

Rows never move. In each pass a task walks its rows down the trees grown so far, whose size is bounded by the
parameters, and adds their weights to histograms by (tree, node, feature, bin, class); sums leave the tasks already
combined. Each node's best split is then found from its histograms alone, and the tree gets its next level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.selection import percentiles

_ODD, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class ForestShape:
    """Parameters of a forest: at most 2 ** depth leaves a tree, splits at up to bins - 1 quantiles of a feature, tried
    features drawn anew for each node (0: all of them), no leaf lighter than `least` (in drawn rows)."""

    trees: int = 50
    depth: int = 6
    bins: int = 32
    tried: int = 0
    least: float = 1.0
    bootstrap: bool = True
    seed: int = 7


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of whole numbers, elementwise."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * _ODD
            h = (h ^ (h >> np.uint64(32))) * _MUL
            h = h ^ (h >> np.uint64(29))
    return h


_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


def draws(keys: np.ndarray, shape: ForestShape) -> np.ndarray:
    """How often each row is in each tree's bootstrap (rows x trees): Poisson(1) from a hash of seed, tree and key."""
    if not shape.bootstrap:
        return np.ones((len(keys), shape.trees))
    u = (_mixed(shape.seed, np.arange(shape.trees)[None, :], keys[:, None]) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(_POISSON, u, side="right").astype(float)


def tried_features(tree: int, node: int, width: int, shape: ForestShape) -> list[int]:
    """The features that a node may split at: those of least hash."""
    if not 0 < shape.tried < width:
        return list(range(width))
    return sorted(np.argsort(_mixed(shape.seed + 1, tree, node, np.arange(width)), kind="stable")[: shape.tried].tolist())


class _Grown:
    """The trees grown so far in heap order (node 1 is the root): feature (-1: leaf so far) and bin of each split."""

    def __init__(self, trees: int, depth: int):
        self.feature = np.full((trees, 2 << depth), -1, np.int64)
        self.bin = np.zeros((trees, 2 << depth), np.int64)
        self.depth = 0

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row in each tree (rows x trees); 0 where it came to a leaf above the last level."""
        every = np.arange(len(self.feature))
        at = np.ones((len(bins), len(self.feature)), np.int64)
        for _ in range(self.depth):
            feature = self.feature[every, at]
            right = np.take_along_axis(bins, np.maximum(feature, 0), 1) > self.bin[every, at]
            at = np.where(feature >= 0, 2 * at + right, 0)
        return at


def best_split(hist: np.ndarray, least: float) -> tuple[float, int]:
    """(gain, bin) of the best split of one feature from weights by bin x class x (class weight, drawn rows): rows up to
    the bin go left. The gain is the fall of Gini impurity times weight; 0 where there is none."""
    left = hist.cumsum(0)[:-1]
    total = hist.sum(0)
    right = total - left
    purity = lambda w: (w[..., 0] ** 2).sum(-1) / np.maximum(w[..., 0].sum(-1), 1e-300)
    gain = purity(left) + purity(right) - purity(total)
    gain[(left[..., 1].sum(-1) < least) | (right[..., 1].sum(-1) < least)] = 0
    return (float(gain.max()), int(gain.argmax())) if len(gain) else (0.0, 0)


def fit_forest(df: DataFrame, features: list[str], label: str, classes: list[str], key: Column, shape: ForestShape | None = None) -> dict:
    """A forest spec (see models) with balanced class weights.

    key: a long that is a row's own, for its draws. Rows with a null in a feature, the label or the key, or of another
    class, are left out; a class without rows is an error. Features count in single precision, as in scoring. The
    driver holds the trees: of at most trees * 2 ** depth nodes.
    """
    shape = shape or ForestShape(tried=max(1, round(len(features) ** 0.5)))
    index = F.lit(-1)
    for i, c in enumerate(classes):
        index = F.when(F.col(label) == c, i).otherwise(index)
    rows = df.select(*[F.col(f).cast("float").cast("double").alias(f"x{i}") for i, f in enumerate(features)], index.alias("y"), key.cast("long").alias("k")).where("y >= 0").dropna()
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # a row a class
    if len(count) != len(classes):
        raise ValueError("a class is missing")
    weight = np.array([sum(count.values()) / (len(classes) * count[i]) for i in range(len(classes))])
    cuts = percentiles(rows, [], {f"x{i}": f"x{i}" for i in range(len(features))}, [i / shape.bins for i in range(1, shape.bins)]).first()
    edges = [np.unique(cuts[f"x{i}"]) for i in range(len(features))]
    grown, n, m = _Grown(shape.trees, shape.depth), shape.bins, len(classes)
    value: dict[tuple[int, int], np.ndarray] = {}

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 1 << grown.depth
        tried = [[tried_features(t, first + a, len(features), shape) for a in range(first)] for t in range(shape.trees)]
        width = len(tried[0][0])
        chosen = np.array(tried)  # tree x node x place
        size = shape.trees * first * width * n * m
        sums = np.zeros((2, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(lo, 1 << 12)
                bins = np.stack([np.searchsorted(e, part.column(i).to_numpy(), side="left") for i, e in enumerate(edges)], 1)
                y, drawn = part.column(len(features)).to_numpy(), draws(part.column(len(features) + 1).to_numpy(), shape)
                row, tree = np.nonzero((drawn > 0) & (grown.nodes(bins) > 0))
                node = grown.nodes(bins)[row, tree] - first
                for j in range(width):
                    f = chosen[tree, node, j]
                    at = ((((tree * first + node) * width + j) * n) + bins[row, f]) * m + y[row]
                    w = drawn[row, tree]
                    sums[0] += np.bincount(at, weights=w * weight[y[row]], minlength=size)
                    sums[1] += np.bincount(at, weights=w, minlength=size)
        at = np.flatnonzero(sums[1])
        slot, own = np.divmod(at, n * m)
        yield pa.RecordBatch.from_arrays([pa.array(slot // width), pa.array(chosen.reshape(-1)[slot]), pa.array(own), pa.array(sums[0, at]), pa.array(sums[1, at])], ["node", "feature", "cell", "w", "c"])

    def split(own: pd.DataFrame) -> pd.DataFrame:
        node, best = int(own["node"].iloc[0]), (1e-12, -1, 0)
        hist = None
        for f, cells in own.groupby("feature"):  # in order of features: the first of equal gains counts
            hist = np.zeros((n * m, 2))
            hist[cells["cell"]] = cells[["w", "c"]]
            hist = hist.reshape(n, m, 2)
            gain, at = best_split(hist, shape.least)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, int(f), at)
        return pd.DataFrame({"node": [node], "feature": [best[1]], "bin": [best[2]], "value": [hist.sum(0)[:, 0].tolist()]})

    for depth in range(shape.depth + 1):
        grown.depth = depth
        sums = rows.mapInArrow(level, "node long, feature long, cell long, w double, c double").groupBy("node", "feature", "cell").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
        found = sums.groupBy("node").applyInPandas(split, "node long, feature long, bin long, value array<double>").collect()  # a row a node
        for r in found:
            tree, node = divmod(r["node"], 1 << depth)
            node += 1 << depth
            value[tree, node] = np.array(r["value"])
            if depth < shape.depth:
                grown.feature[tree, node], grown.bin[tree, node] = r["feature"], r["bin"]
        if depth == shape.depth or not (grown.feature[:, 1 << depth : 2 << depth] >= 0).any():
            break
    trees = [_spec_tree(grown, value, t, edges) for t in range(shape.trees)]
    return {"kind": "forest", "features": features, "classes": classes, "mean": [0.0] * len(features), "scale": [1.0] * len(features), "trees": trees}


def _spec_tree(grown: _Grown, value: dict[tuple[int, int], np.ndarray], tree: int, edges: list[np.ndarray]) -> dict:
    """A tree as arrays, parents before children; leaves have -1 as children. A tree that drew no row is an even leaf."""
    out: dict[str, list] = {"children_left": [], "children_right": [], "feature": [], "threshold": [], "value": []}
    if (tree, 1) not in value:
        return {"children_left": [-1], "children_right": [-1], "feature": [0], "threshold": [0.0], "value": [[1.0] * len(next(iter(value.values())))] if value else []}
    order = [1]
    for node in order:
        f = int(grown.feature[tree, node])
        inner = f >= 0 and (tree, 2 * node) in value and (tree, 2 * node + 1) in value
        out["children_left"].append(len(order) if inner else -1)
        out["children_right"].append(len(order) + 1 if inner else -1)
        out["feature"].append(f if inner else 0)
        out["threshold"].append(float(edges[f][grown.bin[tree, node]]) if inner else 0.0)
        out["value"].append(value[tree, node].tolist())
        if inner:
            order += [2 * node, 2 * node + 1]
    return out
