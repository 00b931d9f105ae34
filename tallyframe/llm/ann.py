"""Approximate nearest neighbours by cosine: lists of an inverted file, scanned with early abandoning.

Every row goes into the list of its nearest centroid. A query probes its nearest lists. Vectors are made unit and
turned by a random rotation, and stand in blocks of columns: after each block the partial distance of a candidate is
held against the distance of the k-th best so far. Under a random rotation the share of a squared distance that lies
in d of D columns has a Beta(d / 2, (D - d) / 2) distribution, so "this candidate is no further than the k-th best" is
a hypothesis that can be tested at a chosen level; candidates that fail are abandoned. Those that pass all blocks are
scored exactly, on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import tidy_pair, tidy_stream
from tallyframe.llm.topk import usable
from tallyframe.storage import materialize

#: The centroids: at most so many, fitted on at most so many rows (and 40 a list), chosen by a hash of the id.
MOST_LISTS = 4096
SAMPLE_ROWS = 65_536
ROUNDS = 8
#: Columns of a block, and the level at which a candidate is abandoned wrongly in one test.
COLUMNS = 16
LEVEL = 1e-3
#: So many rows, chosen by a hash, are searched by brute force over all rows to choose the number of probed lists: the
#: least at which this share of their neighbours is in a probed list.
TUNE_ROWS = 256
TARGET = 0.97
#: Rows of a bin (some lists, or a part of a long one), and queries that meet it in one task.
BIN_ROWS = 16_384
QUERY_BLOCK = 16_384
_SLACK = 1e-9  # distances within this of the k-th best are scored exactly
_STEPS = float(1 << 52)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A list array as rows of doubles, padded with zeros."""
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; first by the largest component, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(1, initial=0, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows in double precision, components added in their order."""
    dot = aa = bb = np.zeros(len(a))
    for d in range(a.shape[1]):
        x, y = a[:, d], b[:, d]
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    with np.errstate(all="ignore"):
        out = dot / (np.sqrt(aa) * np.sqrt(bb))
    odd = ~((aa > 1e-200) & (bb > 1e-200) & (aa < 1e200) & (bb < 1e200))
    if odd.any():
        out[odd] = (unit(a[odd]) * unit(b[odd])).sum(1)
    return out


@lru_cache(maxsize=4)
def rotation(width: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=64)
def share_bound(d: int, width: int, level: float = LEVEL) -> float:
    """What the share of d of `width` rotated columns in a squared distance exceeds with probability `level`: a
    quantile of Beta(d / 2, (width - d) / 2), from its density on a grid."""
    x = (np.arange(1 << 16) + 0.5) / (1 << 16)
    log = (d / 2 - 1) * np.log(x) + ((width - d) / 2 - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(log - log.max()))
    return float(x[min(len(x) - 1, np.searchsorted(mass, (1 - level) * mass[-1]) + 1)])


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """k-means of unit vectors by cosine; starts from different rows. A list that loses all rows keeps its centroid."""
    different = np.unique(sample, axis=0)
    at = np.random.default_rng(seed).permutation(len(different))[:lists]
    out = different[at]
    for _ in range(rounds):
        nearest = nearest_lists(sample, out, 1)[:, 0]
        order = np.argsort(nearest, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(nearest[order]) != 0))
        sums = np.add.reduceat(sample[order], first, axis=0)
        size = np.sqrt((sums * sums).sum(1))
        some = size > 1e-12
        out[nearest[order[first]][some]] = sums[some] / size[some, None]
    return out


def nearest_lists(rows: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each unit row, nearest first, computed in slices of bounded size."""
    out = np.zeros((len(rows), min(n, len(centers))), np.int64)
    step = max(1, (1 << 21) // len(centers))
    for a in range(0, len(rows), step):
        like = rows[a : a + step] @ centers.T
        out[a : a + step] = like.argmax(1)[:, None] if n == 1 else np.argsort(-like, axis=1, kind="stable")[:, :n]
    return out


class Block:
    """The candidates of a bin, rotated, in blocks of columns, each list a range of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, k: int):
        # of equal vectors only the k + 1 smallest different ids can be among a query's k best (one may be its own)
        order = np.lexsort((ids, *rows.T[::-1], lists))
        ids, rows, lists = ids[order], rows[order], lists[order]
        new = np.ones(len(ids), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1) | (lists[1:] != lists[:-1])
        other = new.copy()
        other[1:] |= ids[1:] != ids[:-1]
        ids, rows, lists, new = ids[other], rows[other], lists[other], new[other]
        nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        self.ids, self.rows, lists = ids[nth <= k], rows[nth <= k], lists[nth <= k]
        turned = unit(self.rows) @ rotation(rows.shape[1])
        width = turned.shape[1]
        self.cuts = [*range(0, max(1, width - COLUMNS // 2), COLUMNS), width]
        self.blocks = [np.ascontiguousarray(turned[:, a:b].T) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.norms = np.cumsum([(b * b).sum(0) for b in self.blocks], axis=0)
        first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])[: len(lists)])
        self.range = {int(lists[a]): (int(a), int(b)) for a, b in zip(first, np.append(first[1:], len(lists)), strict=True)}

    def scan(self, query_id: int, query: np.ndarray, lists: list[int], limit: float, k: int) -> np.ndarray:
        """Rows that may be among the k nearest of a query (unit, rotated), from these lists in this order. limit: a
        squared distance that k other rows are known not to exceed."""
        parts = [query[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        own = np.cumsum([(p * p).sum() for p in parts])
        where, far = [], []
        best = np.zeros(0)
        for name in lists:
            if name not in self.range:
                continue
            a, b = self.range[name]
            live = np.arange(a, b)
            dot = np.zeros(b - a)
            for j, part in enumerate(parts):
                dot = dot + part @ (self.blocks[j][:, a:b] if len(live) == b - a else self.blocks[j][:, live])
                apart = self.norms[j][live] + own[j] - 2 * dot
                last = j + 1 == len(parts)
                bound = limit if last else limit * share_bound(self.cuts[j + 1], self.cuts[-1])
                stay = apart <= bound + _SLACK
                if last:
                    stay &= self.ids[live] != query_id
                live, dot = live[stay], dot[stay]
                if not len(live):
                    break
            if len(live):
                where.append(live)
                far.append(apart[stay])
                # rows of one id count once towards the limit
                ids = self.ids[np.concatenate(where)]
                best = np.concatenate(far)
                if len(best) >= k:
                    order = np.argsort(best, kind="stable")
                    _, at = np.unique(ids[order], return_index=True)
                    if len(at) >= k:
                        limit = min(limit, float(np.sort(best[order[at]])[k - 1]))
        if not where:
            return np.zeros(0, np.int64)
        return np.concatenate(where)[best <= limit + _SLACK]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(width: int, k: int):
    """The task of a bin: its queries against its candidates."""

    def best(query_ids: np.ndarray, queries: np.ndarray, block: Block, pairs: list[np.ndarray]) -> pa.Table:
        q = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        c = np.concatenate([*pairs, np.zeros(0, np.int64)])
        score = cosine(queries[q], block.rows[c])
        order = np.lexsort((block.ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        # the best k different ids of each query
        _, first = np.unique(np.stack([q, block.ids[c]], 1), axis=0, return_index=True)
        first = np.sort(first)
        q, c, score = q[first], c[first], score[first]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < k
        return pa.table([query_ids[q[keep]], block.ids[c[keep]], score[keep]], schema=_FOUND)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        rows = matrix(right["vector"].chunk(0), width)
        block = Block(right["vec_id"].to_numpy(), rows, right["list"].to_numpy(), k)
        queries, query_ids = matrix(left["vector"].chunk(0), width), left["vec_id"].to_numpy()
        turned, lists = unit(queries) @ rotation(width), left["lists"].chunk(0)
        limits = left["limit"].to_numpy()
        out, start, pairs, total = [], 0, [], 0
        for i in range(len(queries)):
            pairs.append(block.scan(int(query_ids[i]), turned[i], lists[i].as_py(), float(limits[i]), k))
            total += len(pairs[-1])
            if total > 1 << 16 or i + 1 == len(queries):
                out.append(best(query_ids[start : i + 1], queries[start : i + 1], block, pairs))
                start, pairs, total = i + 1, [], 0
        return pa.concat_tables(out)

    return tidy_pair(run)


def _bins(sizes: dict[int, int], lists: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bin of each list and its number of bins: short lists share a bin, long ones are cut."""
    first, parts = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    at, filled = 0, 0
    for i in range(lists):
        size = sizes.get(i, 0)
        if filled and filled + size > most:
            at, filled = at + 1, 0
        first[i], parts[i] = at, max(1, -(-size // most))
        at, filled = (at + int(parts[i]), 0) if parts[i] > 1 else (at, filled + size)
    return first, parts


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row about its k nearest rows by cosine, nearest first.

    vectors: vec_id long and embedding (array of float or double). A query's own vec_id is no candidate for it; ties
    go to the smaller vec_id; fewer candidates give fewer rows. Scores are exact, and of the true neighbours about
    `target` are found (the number of probed lists is chosen for that); where all lists are probed, all but what the
    tests abandon wrongly. Vectors that are null, empty, zero or hold a null, NaN or infinite component take no part;
    null ids neither. Vectors of unlike length meet as if padded with zeros. A repeated vec_id counts once, at its
    best score. An empty table gives an empty result; other columns are left behind.
    """
    spark = vectors.sparkSession
    ready = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = ready.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q"))
    kind = dict(rows.dtypes)["vector"]
    n, n_queries, width = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("vector"))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(max(1, min(MOST_LISTS, round(n**0.5))))
    u = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "vector"), F.lit(1 << 52))

    def chosen(table: DataFrame, salt: str, most: int) -> np.ndarray:
        """At most so many rows by order of a hash: those below a limit that few fall short of or exceed come here."""
        some = table.select(u(salt).alias("u"), "vector").where(F.col("u") < F.lit(int(min(1.0, (most + 4 * most**0.5) / n) * _STEPS))).limit(2 * most + 64).toArrow()
        order = np.argsort(some["u"].to_numpy(), kind="stable")[:most]
        return matrix(pa.array(some["vector"].take(order).to_pylist(), pa.list_(pa.float64())), width)

    sample = chosen(rows, "fit", min(SAMPLE_ROWS, 40 * lists))
    if not len(sample):
        sample = matrix(pa.array([rows.first()["vector"]]), width)
    centers = centroids(unit(sample), lists)
    lists = len(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nearest_lists(unit(matrix(batch.column(1), width)), centers, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "list"])

    index = materialize(rows.mapInArrow(tidy_stream(assign), f"vec_id long, vector {kind}, q boolean, list int"), "ann-index")
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    probes = _tuned(index, chosen(index, "tune", TUNE_ROWS), centers, width, k, target)
    most = min(BIN_ROWS, max(1000, n // (2 * spark.sparkContext.defaultParallelism)))
    first, parts = _bins(sizes, lists, most)
    blocks = -(-n_queries // QUERY_BLOCK)

    def visits(only_home: bool):
        """Each query once for every bin that it visits, with the lists to scan there, nearest first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = nearest_lists(unit(matrix(batch.column(1), width)), centers, 1 if only_home else probes)
                row, bins, told = [], [], []
                for i, own in enumerate(near.tolist()):
                    by: dict[int, list[int]] = {}
                    for x in own:
                        for part in range(1 if only_home else parts[x]):
                            by.setdefault(int(first[x]) + part, []).append(x)
                    row += [i] * len(by)
                    bins += by
                    told += by.values()
                taken = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bins, pa.int64()), pa.array(told, pa.list_(pa.int32()))], [*taken.schema.names, "bin", "lists"])

        return tidy_stream(run)

    place = f"vec_id long, vector {kind}, limit double, block int, bin long, lists array<int>"
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int").alias("block")
    home = F.element_at(F.array(*[F.lit(int(x)) for x in first]), F.col("list") + 1) + F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("list") + 1))
    candidates = index.select("vec_id", "vector", "list", home.alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    search = _search(width, k)

    def found(queries: DataFrame, only_home: bool) -> DataFrame:
        sent = queries.select("vec_id", "vector", "limit", block).mapInArrow(visits(only_home), place)
        near = sent.groupBy("bin", "block").cogroup(candidates.groupBy("bin", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
        best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = index.where("q").select("vec_id", "vector", F.lit(float("inf")).alias("limit"))
    # the k-th best of a query's own list (of one bin of it) is its first limit
    limits = materialize(found(queries, True).where(F.col("rank") == k).select("query_id", (2 - 2 * F.col("score") + _SLACK).alias("limit")), "ann-limits")
    limited = queries.drop("limit").join(limits.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    # a query id with different vectors has one limit, of its best ones: such queries start without
    unlike = queries.groupBy("vec_id").agg((F.count("*") > 1).alias("repeated"))
    limited = limited.join(unlike, "vec_id").withColumn("limit", F.when(F.col("repeated"), F.lit(float("inf"))).otherwise(F.col("limit")))
    return found(limited, False).select("query_id", "rank", "vec_id", "score")


def _tuned(index: DataFrame, queries: np.ndarray, centers: np.ndarray, width: int, k: int, target: float) -> int:
    """The number of lists to probe: the rank, among a query's lists, within which the target share of the exact k
    nearest rows of the tuning queries lies. Each task keeps the k best rows of each query."""
    if not len(queries):
        return len(centers)
    unit_queries = unit(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, own = np.full((len(unit_queries), 0), -2.0), np.zeros((len(unit_queries), 0), np.int64)
        for batch in batches:
            like = unit_queries @ unit(matrix(batch.column(0), width)).T
            like[like > 1 - 1e-12] = -2  # the query itself, and copies, which lie in its first list
            score = np.concatenate([score, like], 1)
            own = np.concatenate([own, np.broadcast_to(batch.column(1).to_numpy(), like.shape)], 1)
            if score.shape[1] > k:
                keep = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, own = np.take_along_axis(score, keep, 1), np.take_along_axis(own, keep, 1)
        at = np.repeat(np.arange(len(score)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score.ravel()), pa.array(own.ravel())], ["query", "score", "list"])

    per_task = index.select("vector", "list").mapInArrow(tidy_stream(run), "query long, score double, list long").where("score > -2")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    best = per_task.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query", "list").toArrow()  # at most k rows a query
    ranks = np.empty((len(queries), len(centers)), np.int64)
    np.put_along_axis(ranks, nearest_lists(unit_queries, centers, len(centers)), np.arange(len(centers))[None, :], 1)
    at = np.sort(ranks[best["query"].to_numpy(), best["list"].to_numpy()])
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))))]) + 1 if len(at) else len(centers)


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 5 nearest rows found for each row whose vec_id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
