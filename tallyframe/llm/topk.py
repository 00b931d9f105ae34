"""Exact top-k search: exhaustive term-at-a-time accumulation over integer vectors.

Queries and candidates are dealt into a grid of bounded blocks. In a block every dimension is a term with a
posting list (the rows where it is not zero and their weights); each query row scatters its weight times the
postings into a dense score array, term after term. A partition selection keeps the k best of each block, and the
blocks' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 16_384
_RESULT = "query_id long, vec_id long, score long"


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, taken as a double; beyond 64 bits, the nearest 64-bit number."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def block_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query; ids must be sorted, so that ties go to the smaller id. Rows of
    one id count once, at their best score."""
    # a score's bound decides the width of the accumulator; beyond 64 bits whole numbers of any size are added
    most = lambda m: max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))
    bound = most(queries) * most(rows) * max(1, rows.shape[1])
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    repeated, ids = len(first) < len(ids), ids[first]
    queries, rows = queries.astype(kind), rows.astype(kind)
    postings = []
    for t in range(rows.shape[1]):
        where = np.flatnonzero(rows[:, t])
        postings.append((slice(None) if len(where) == len(rows) else where, np.ascontiguousarray(rows[where, t])))
    found = []
    for q, query in zip(query_ids, queries, strict=True):
        score = np.zeros(len(rows), kind)
        for t in np.flatnonzero(query):
            where, weight = postings[t]
            score[where] += query[t] * weight
        if repeated:
            score = np.maximum.reduceat(score, first)
        keep = np.flatnonzero(ids != q)
        if len(keep) > k:
            own = score[keep]
            least = np.partition(own, len(own) - k)[len(own) - k]
            keep = keep[own >= least]
        if kind is object and any(abs(x) >= 2**63 for x in score[keep]):
            raise OverflowError("a score among the best does not fit 64 bits")
        keep = keep[np.lexsort((ids[keep], -score[keep].astype(np.int64)))][:k]
        found.append((np.full(len(keep), q), ids[keep], score[keep].astype(np.int64)))
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("query_id", "vec_id", "score"))})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k highest integer inner products.

    vectors: vec_id long and vector array<long>. A query's own vec_id is no candidate for it. Ties go to the
    smaller vec_id; fewer candidates give fewer rows. Vectors of unlike length meet as if padded with zeros. A
    repeated vec_id counts once, at its best score. Rows with a null vec_id or vector are left out. A score among
    the best that does not fit 64 bits is an error. An empty table gives an empty result.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select("vec_id", "vector", is_query.alias("q"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    if n > 2000:  # small enough blocks to use the cluster's cores
        c_blocks = max(c_blocks, min(n // 1000, 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    h = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(m)).cast("int")
    candidates = rows.select("vec_id", "vector", h("c", c_blocks).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("b"))
    queries = rows.where("q").select("vec_id", "vector", h("q", q_blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("vec_id", kind="stable")
        width = max([0, *(len(v) for v in left["vector"]), *(len(v) for v in right["vector"])])
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return block_top_k(left["vec_id"].to_numpy(np.int64), _matrix(left["vector"], width), right["vec_id"].to_numpy(np.int64), _matrix(right["vector"], width), k)

    scored = queries.groupBy("c", "b").cogroup(candidates.groupBy("c", "b")).applyInPandas(block, _RESULT)
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    ready = raw.where(usable(F.col("embedding"))).select("vec_id", quantized(F.col("embedding")).alias("vector"))
    return top_k(ready, F.col("vec_id") % 50 == 0)


ORACLE_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
