"""Shared by the operators of this folder: table access and byte-level word hashing in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("*",))


#: Bytes of the batches in which texts go to Python; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, once its session sends Python batches bounded by bytes and not by rows alone: texts vary in length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    size = df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if size > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


_LIBC = ctypes.CDLL(None)
#: Arrays of so many bytes get memory of their own, which goes back to the system when they do.
OWN_BYTES = 1 << 23
if hasattr(_LIBC, "mallopt"):
    _LIBC.mallopt(-3, OWN_BYTES)  # M_MMAP_THRESHOLD: else it rises with every large array that is freed
    _LIBC.mallopt(-1, 8 * OWN_BYTES)  # M_TRIM_THRESHOLD: smaller ones stay until _give_back


def _give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks and would hold their peak."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy_stream(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function for applyInArrow that gives memory back after each group."""

    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            _give_back()

    return tidied


def tidy_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for cogrouped tables."""

    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            _give_back()

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        size = 1 << max(16, (n - 1).bit_length())
        found = np.full(size, np.uint64(base))
        found[0] = 1
        found = np.multiply.accumulate(found)
        _POWERS[base] = found
    return found[:n]


#: Word hashes are polynomials modulo this prime, to two bases; a power of two as modulus would let patterned words agree.
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 1_566_083_941)
_PRIME_POWERS: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    p, s = np.uint64(_PRIME), np.uint64(31)
    x = (x & p) + (x >> s)
    x = (x & p) + (x >> s)
    return np.where(x >= p, x - p, x)


def _prime_powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime, by doubling."""
    found = _PRIME_POWERS.get(base)
    if found is None or len(found) < n:
        found = np.ones(1, np.uint64)
        while len(found) < max(n, 1 << 16):
            found = np.concatenate((found, _mod(found * np.uint64(pow(base, len(found), _PRIME)))))
        _PRIME_POWERS[base] = found
    return found[:n]


def word_table(blob: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts at once, and the text each word is in.

    blob: the UTF-8 bytes of the texts, each followed by one space (so no word spans two). doc_ends: where each
    text ends in it, the space included. A word is a run of bytes other than space and 9 to 13. Its hash joins its
    length and two polynomials over its bytes modulo a prime, from prefix sums, so equal words have equal hashes
    wherever they stand.
    """
    space = (blob == 32) | ((blob >= 9) & (blob <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(blob) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = (ends - starts).astype(np.uint64) * M1
    sums = np.zeros(len(blob) + 1, np.uint64)
    byte = blob.astype(np.uint64) + np.uint64(1)
    for shift, base in zip((31, 0), _BASES, strict=True):
        v = byte * _prime_powers(base, len(blob))
        np.cumsum((v & np.uint64(_PRIME)) + (v >> np.uint64(31)), out=sums[1:])
        own = _mod(_mod(sums[ends] - sums[starts]) * _prime_powers(pow(base, -1, _PRIME), len(blob))[starts])
        h = mix(h + (own << np.uint64(shift)))
    return h, np.searchsorted(doc_ends, starts, side="right")


def shingle_table(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words (a text with fewer words gives its whole sequence as one) and the
    text each is in, in text order; repeats stay."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    n = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    where = np.repeat(np.arange(n_docs), n)
    at = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n) + first[where]
    left = np.minimum(count[where], size)
    h = left.astype(np.uint64) * M1
    for k in range(size):
        inside = left > k
        h = np.where(inside, mix(h * M1 + words[np.minimum(at + k, max(0, len(words) - 1))]), h)
    return h, where


def pack_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    blob = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    return blob, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))


def lower_ascii(blob: np.ndarray) -> np.ndarray:
    return np.where((blob >= 65) & (blob <= 90), blob | np.uint8(32), blob)


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about `most` (a single larger one stands alone)."""
    out, start, total = [], 0, 0
    for i, x in enumerate(sizes):
        if i > start and total + x > most:
            out.append((start, i))
            start, total = i, 0
        total += x
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out
