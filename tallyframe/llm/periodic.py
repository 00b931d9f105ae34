"""Periodic run detection by Main and Lorentz's divide and conquer on interned word ids.

A run is a stretch of words that repeats with a smallest period, goes on for at least two periods, and that no
neighbouring word extends. Texts are halved again and again. The least node (part of a text) that holds a run whole is
crossed by it in its middle, where two Z-functions find it: how far the words from the middle on agree with those from
each other place on, and how far the words before the middle agree with those before each other place, backwards. What
would extend beyond its node is left to the node above that holds it whole. One interval found with several periods
keeps the smallest.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import documents, in_small_batches, slices, tidy_stream

LEAST_LENGTH = 12
#: Agreement is counted word by word for all places at once up to here; beyond, place after place with Z's window.
SHORT = 16
#: Words of the texts that are searched together; a longer text stands alone.
SLICE_WORDS = 1 << 18
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def interned(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """The words of all texts as numbers, equal for equal words, the place where each text's words begin (and the end),
    and the words. A word is a run of bytes other than space and 9 to 13, which is what bytes.split parts at."""
    words = [t.split() for t in texts]
    table: dict[bytes, int] = defaultdict(itertools.count().__next__)
    flat = map(table.__getitem__, itertools.chain.from_iterable(words))
    size = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    ids = np.fromiter(flat, np.int32, int(size[-1]))
    return ids, size, words


def _agreement(x: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from a < b on agree, up to end, compared in blocks that double."""
    n, step = 0, 32
    while b + n < end:
        step = min(step, end - b - n)
        unlike = x[a + n : a + n + step] != x[b + n : b + n + step]
        at = int(unlike.argmax())
        if unlike[at]:
            return n + at
        n, step = n + step, 2 * step
    return n


def z_at_middles(x: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each place i of the disjoint nodes [lo, hi): how many words from mid on agree with those from i on, inside
    the node (0 at the middle itself and outside all nodes). The Z-function of the right half, and of the right half
    against the left one."""
    z = np.zeros(len(x), np.int64)
    size = hi - lo
    node = np.repeat(np.arange(len(lo)), size)
    at = np.arange(len(node)) + np.repeat(lo - (np.cumsum(size) - size), size)
    like = (x[at] == np.repeat(x[mid], size)) & (at != np.repeat(mid, size))
    at, node = at[like], node[like]
    z[at] = 1
    a, b, end, live = np.minimum(at, mid[node]), np.maximum(at, mid[node]), hi[node], at
    for k in range(1, SHORT):
        on = np.flatnonzero(b + k < end)
        on = on[x[a[on] + k] == x[b[on] + k]]
        a, b, end, live = a[on], b[on], end[on], live[on]
        z[live] += 1
        if not len(live):
            return z
    where = np.searchsorted(lo, live, side="right") - 1
    for n, group in itertools.groupby(zip(where.tolist(), live.tolist(), strict=True), key=lambda p: p[0]):
        m, end = int(mid[n]), int(hi[n])
        places = [i for _, i in group]
        # first the right half against itself, then it against the left half; both from left to right
        for own in ([i for i in places if i > m], [i for i in places if i < m]):
            left = right = 0  # the window: words left .. right agree with those from the middle on
            for i in own:
                known = 0
                if i < right:
                    known = int(z[m + i - left])
                    if known < right - i:
                        z[i] = known
                        continue
                    known = right - i
                known = max(known, SHORT)
                first, second = (m, i) if i > m else (i, m)
                known = min(known, end - second)
                z[i] = known + _agreement(x, first + known, second + known, end)
                left, right = i, i + int(z[i])
    return z


def find_runs(x: np.ndarray, ends: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """All runs of `least` words or more, as rows (start, end, period) over all texts, by start, then end.

    ends: where each text begins in x, and the end of x, as interned gives them."""
    lo, hi = ends[:-1], ends[1:]
    first, last = lo, hi  # of each node's text
    mirrored, n = np.ascontiguousarray(x[::-1]), len(x)
    found = []
    while True:
        big = hi - lo >= max(2, least)
        lo, hi, first, last = lo[big], hi[big], first[big], last[big]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        ahead = z_at_middles(x, lo, mid, hi)
        # in the mirror the word before the middle comes first: how far it and those before it agree, backwards
        back = z_at_middles(mirrored, n - hi[::-1], n - mid[::-1], n - lo[::-1])[::-1]
        at = np.flatnonzero(ahead)
        node = np.searchsorted(lo, at, side="right") - 1
        m = mid[node]
        period = np.abs(at - m)
        before = np.where(at > lo[node], back[np.maximum(at - 1, 0)], 0)
        start, end = np.minimum(at, m) - before, np.maximum(at, m) + ahead[at]
        keep = (end - start >= 2 * period) & (end - start >= least)
        node, start, end, period = node[keep], start[keep], end[keep], period[keep]
        over = (start == lo[node]) & (start > first[node])
        over[over] = x[start[over] - 1] == x[start[over] - 1 + period[over]]
        more = (end == hi[node]) & (end < last[node])
        more[more] = x[end[more]] == x[end[more] - period[more]]
        keep = ~(over | more)
        found.append(np.stack([start[keep], end[keep], period[keep]], 1))
        order = np.argsort(np.concatenate([lo, mid]), kind="stable")
        lo, hi, first, last = np.concatenate([lo, mid])[order], np.concatenate([mid, hi])[order], np.tile(first, 2)[order], np.tile(last, 2)[order]
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def runs_of_texts(texts: list[bytes], least: int = LEAST_LENGTH) -> tuple[list[np.ndarray], list[str]]:
    """Of each text its runs (start, length, period; by start, then period) and what is left of it, words joined by one
    space, when every run keeps its first period only. A word that some run drops goes."""
    x, ends, words = interned(texts)
    runs = find_runs(x, ends, least)
    drop = np.zeros(len(x) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    stays = np.cumsum(drop)[:-1] == 0
    bounds = np.searchsorted(runs[:, 0], ends)
    out, left = [], []
    for i, own in enumerate(words):
        r = runs[bounds[i] : bounds[i + 1]]
        r = np.stack([r[:, 0] - ends[i], r[:, 1] - r[:, 0], r[:, 2]], 1)
        out.append(r[np.lexsort((r[:, 2], r[:, 0]))])
        left.append(b" ".join(itertools.compress(own, stays[ends[i] : ends[i + 1]].tolist())).decode() if len(r) else b" ".join(own).decode())
    return out, left


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, runs (array of start, length, period in words; by start, then period) and collapsed (the text without
    the words that a run repeats, words joined by one space) for every row.

    A null text has no words; a text of fewer than `least` words no runs. Equal rows give equal rows, a null doc_id
    stays null, other columns are left behind, an empty table gives an empty one. Whole texts are searched, in
    n log n steps; a very long one is a batch of its own. Narrow: no shuffle.
    """
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) // 6 + 1 for t in texts], SLICE_WORDS):
                runs, left = runs_of_texts(texts[a:b], least)
                flat = np.concatenate(runs)
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    return in_small_batches(sent).mapInArrow(tidy_stream(run), f"doc_id long, runs {_RUNS}, collapsed string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32(doc_id as text) is divisible by 10, the words from a = g % n on repeat the
    p = 1 + (n - a) / (3 + g % 8) words from there, with g = h / 10 and n the number of words. A null doc_id or text
    stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_words"))
    n, g = F.size("_words"), F.col("_g")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    at = rows.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    own = F.slice("_words", F.lit(1), F.col("_a").cast("int"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.size("_words") - F.col("_a") - 1), lambda i: F.element_at("_words", (F.col("_a") + i % F.col("_p") + 1).cast("int")))
    return at.select("doc_id", F.when(F.col("_p").isNotNull(), F.array_join(F.concat(own, again), " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document with its planted repeats: their number, the longest one (ties: smallest start, then
    period; nulls if there is none) and digests of all of them and of the collapsed text."""
    found = periodic_runs(with_planted_repeats(documents(spark, sf_dir, "doc_id", "text")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("_best.less"), F.col("_best.period")
    return told.select("doc_id", "n_runs", F.col("_best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
