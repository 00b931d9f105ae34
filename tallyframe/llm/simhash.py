"""Document fingerprints: 64-bit SimHash over word shingles, and permuted block tables to search them.

A term is a run of five words (the whole sequence of a shorter text), weighted by how often it occurs. Each bit
of a term's hash votes its weight for or against the fingerprint's bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import documents, in_small_batches, lower_ascii, mix, pack_texts, shingle_table, slices, tidy_group, tidy_stream, word_table
from tallyframe.storage import materialize

SHINGLE_WORDS = 5
#: Bytes of text fingerprinted at once.
SLICE_BYTES = 1 << 20


def fingerprints(texts: list[bytes], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """A uint64 for each UTF-8 text. Texts without words have fingerprint 0. Letters A-Z count as a-z."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in slices([len(t) for t in texts], SLICE_BYTES):
        blob, ends = pack_texts(texts[lo:hi])
        words, doc = word_table(lower_ascii(blob), ends)
        terms, where = shingle_table(words, doc, hi - lo, shingle_words)
        if not len(terms):
            continue
        votes = np.zeros((hi - lo, 64), np.int64)
        for a in range(0, len(terms), 1 << 17):  # bounded, whatever the length of a text
            t, w = mix(terms[a : a + (1 << 17)]), where[a : a + (1 << 17)]
            bits = np.unpackbits(t.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            n = np.diff(np.append(first, len(w)))
            votes[w[first]] += 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32).astype(np.int64) - n[:, None]
        up = np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").ravel()
        has = np.bincount(where, minlength=hi - lo) > 0
        out[lo:hi] = np.where(has, up, np.uint64(0))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the share of bits in which two fingerprints differ."""
    return 1.0 - np.bitwise_count(a ^ b) / 64.0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (signed 64-bit) of each row's whole text. Null text counts as empty, with fingerprint 0;
    repeated rows stay. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return in_small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy_stream(run), "doc_id long, fingerprint long")


def _tables(radius: int, blocks: int) -> list[int]:
    """The masks of the block tables: each keeps blocks - radius of the blocks that the 64 bits are cut into."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64 is needed")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _meetings(values: np.ndarray, table: np.ndarray, masks: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (places i < j) of values that meet in a table within the radius, and their distances, part by part. A pair
    that meets in several tables is told by the first."""
    key = values & masks[table]
    order = np.lexsort((values, key, table))
    v, t, k = values[order], table[order], key[order]
    cut = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]), [True])))
    last = np.repeat(cut[1:], np.diff(cut))  # where the group of each place ends
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def told() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.concatenate(left), np.concatenate(right)
        apart = v[i] ^ v[j]
        near = np.bitwise_count(apart).astype(np.int64)
        ok = np.flatnonzero(near <= radius)
        i, j, apart, near = i[ok], j[ok], apart[ok], near[ok]
        first = ((apart[:, None] & masks) == 0).argmax(1) == t[i]
        left.clear()
        right.clear()
        return order[i[first]], order[j[first]], near[first]

    waiting, step, at = 0, 1, np.arange(len(v))
    while len(at := at[at + step < last[at]]):  # all pairs of neighbours at a distance in the groups' order
        for lo in range(0, len(at), 1 << 18):
            left.append(at[lo : lo + (1 << 18)])
            right.append(left[-1] + step)
            waiting += len(left[-1])
            if waiting >= 1 << 18:
                yield told()
                waiting = 0
        step += 1
    if left:
        yield told()


#: Rows of the block tables that are compared in one task, about.
TASK_ROWS = 250_000


def _dealt(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """task, t, fingerprint: the distinct values in each block table, dealt by table and key."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in _tables(radius, blocks)])
    values = prints.select("fingerprint").where("fingerprint is not null").distinct()
    keyed = values.select("fingerprint", F.posexplode(masks).alias("t", "m"))
    # a task holds its group whole: about TASK_ROWS of the rows, however many there are
    tasks = max(4 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() * len(_tables(radius, blocks)) // TASK_ROWS)
    return keyed.select(F.pmod(F.xxhash64("t", F.col("fingerprint").bitwiseAND(F.col("m"))), F.lit(tasks)).alias("task"), F.col("t").cast("short"), "fingerprint")


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance): every pair of distinct fingerprint values, a < b, at most radius bits apart.

    The 64 bits are cut into `blocks` blocks. Two values within the radius agree on at least blocks - radius
    blocks, so for each choice of that many blocks there is a table keyed by them; candidates meet in a table and
    are verified by their popcount. Values, not rows, are paired: equal fingerprints are one value, and rows join
    back by it. A pair is reported by the first table in which it meets. Nothing is capped.
    """
    masks = np.array(_tables(radius, blocks), np.uint64)

    def run(table: pa.Table) -> pa.Table:
        v = table.column("fingerprint").to_numpy()
        found = [(np.minimum(v[i], v[j]), np.maximum(v[i], v[j]), d) for i, j, d in _meetings(v.view(np.uint64), table.column("t").to_numpy(), masks, radius)]
        a, b, d = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        return pa.table({"a": a, "b": b, "distance": d.astype(np.int32)})

    return _dealt(prints, radius, blocks).groupBy("task").applyInArrow(tidy_group(run), "a long, b long, distance int")


def count_near(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fingerprint, n_near): how many other values lie within the radius of each that has any. The pairs of the block
    tables are counted where they meet; none leaves its task."""
    masks = np.array(_tables(radius, blocks), np.uint64)

    def run(table: pa.Table) -> pa.Table:
        v, n = table.column("fingerprint").to_numpy(), np.zeros(table.num_rows, np.int64)
        for i, j, _ in _meetings(v.view(np.uint64), table.column("t").to_numpy(), masks, radius):
            np.add.at(n, i, 1)
            np.add.at(n, j, 1)
        own, at = np.unique(v[n > 0], return_inverse=True)
        return pa.table({"fingerprint": own, "n": np.bincount(at, n[n > 0], len(own)).astype(np.int64)})

    counted = _dealt(prints, radius, blocks).groupBy("task").applyInArrow(tidy_group(run), "fingerprint long, n long")
    return counted.groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


# ---------------------------------------------------------------- edited texts

_TOLD = "doc_id long, n_chars long, edited_sha256 string, fingerprint long, edited_fingerprint long, near_edited double, near_next double"


def _told(ids: list, texts: list[bytes], nexts: list[bytes], prints: np.ndarray, next_prints: np.ndarray) -> list[pa.Array]:
    chars, edited = [], []
    for t, nx in zip(texts, nexts, strict=True):
        s = t.decode()
        k = len(s) // 3
        chars.append(len(s))
        # 4 k bytes hold at least k code points
        edited.append((s[: len(s) - k] + nx[: 4 * k].decode(errors="ignore")[:k]).encode())
    e = fingerprints(edited)
    sha = [hashlib.sha256(x).hexdigest() for x in edited]
    return [
        pa.array(ids, pa.int64()), pa.array(chars, pa.int64()), pa.array(sha, pa.string()), pa.array(prints.view(np.int64)), pa.array(e.view(np.int64)),
        pa.array(likeness(prints, e), pa.float64()), pa.array(likeness(prints, next_prints), pa.float64()),
    ]


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has the last floor(n_chars / 3) code points replaced by as many first ones (or all) of the
    next document in descending doc_id; the last takes the first. Rows with one doc_id stand in order of their
    text. A null doc_id stands after all others; null text counts as empty. A table of one row is its own next.

    Rows are ranged and sorted by doc_id (and text), and stream through one task for each range; only the first and
    the last row of each range are kept to be compared across ranges. Nothing is gathered, however many rows a range
    or a doc_id has.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.substring("text", 1, 32).desc()]
    sorted_ = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(order[0], F.col("text").desc())
    names = [c.split()[0] for c in _TOLD.split(", ")]
    none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    edge = [("part", pa.int32()), ("first", pa.string()), ("last", pa.string())]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: str | None = None
        ids: list = []
        texts: list[bytes] = []
        prints = np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [t.encode() for t in batch.column(1).to_pylist()]
            top = batch.column(1)[0].as_py() if top is None else top
            ids, texts, prints = ids[-1:] + batch.column(0).to_pylist(), texts[-1:] + new, np.concatenate((prints[-1:], fingerprints(new)))
            if len(ids) > 1:
                told = _told(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                yield pa.RecordBatch.from_arrays(told + [pa.nulls(len(ids) - 1, t) for _, t in edge], names + [n for n, _ in edge])
        if ids:
            part = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([top], pa.string()), pa.array([texts[-1].decode()], pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[-1:], pa.int64()), *none[1:], *part], names + [n for n, _ in edge])

    told = materialize(in_small_batches(sorted_).mapInArrow(tidy_stream(stream), _TOLD + ", part int, first string, last string"), "simhash-told")
    edges = told.where("part is not null")  # a row for each range
    w = Window.orderBy("part")
    across = edges.select("doc_id", "last", F.coalesce(F.lead("first").over(w), F.first("first").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nexts = ([t.encode() for t in batch.column(c).to_pylist()] for c in (1, 2))
            yield pa.RecordBatch.from_arrays(_told(batch.column(0).to_pylist(), texts, nexts, fingerprints(texts), fingerprints(nexts)), names)

    return told.where("part is null").select(*names).unionByName(in_small_batches(across).mapInArrow(tidy_stream(last), _TOLD))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_edited with fingerprints in hexadecimal, and n_near: how many other fingerprints of the table lie within
    three bits of a row's, found by the block tables."""
    told = materialize(compare_edited(documents(spark, sf_dir, "doc_id", "text")), "simhash-compared")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(c)
    return told.join(count_near(told), "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")
    )
