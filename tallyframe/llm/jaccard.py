"""N-gram Jaccard self-join by PartEnum signatures, and its connected components.

Sets are the distinct word shingles of whole texts. Sizes are cut into bands, each reaching from the last one's top to
the largest size that can be similar to that top. Two similar sets of which the larger lies in a band with top r differ
in at most k = (1 - t) / (1 + t) * 2r elements. The feature domain is hashed into n1 first-level partitions of n2
second-level ones, so that in some first-level partition the sets differ in at most k2 of the second-level ones
(n1 * (k2 + 1) > k); every choice of n2 - k2 of these gives one signature, and sufficiently similar sets share one. A set
signs for its own band and, if it may have partners there, for the next.

n2 and k2 are chosen for each band by a cost formula: unrelated sets share a signature only where both are empty in all
chosen partitions, with odds exp(-2E) for E = size / n1 * (n2 - k2) / n2, so more choices of more partitions part
unrelated sets better and cost more signatures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import M1, M2, _give_back, documents, in_small_batches, lower_ascii, mix, pack_texts, shingle_table, slices, tidy_group, tidy_stream, word_table
from tallyframe.operators.graph import connected_components
from tallyframe.storage import discard, materialize

SLICE_BYTES = 1 << 19
#: Up to so many ids, a filter on the texts is a broadcast join; beyond, a shuffled one.
BROADCAST_IDS = 1_000_000
#: Sets of one band, for the cost formula at least: it weighs signatures against unrelated sets that share one.
PEERS = 1_000_000
#: What a signature costs, in comparisons of two sketches.
WEIGHT = 4
#: Signatures sorted and sent on at once, and those of one bucket on average.
BLOCK_SIGNATURES = 1 << 20
BUCKET_SIGNATURES = 1 << 21
MAX_BUCKETS = 1 << 16
#: Members of one row of a group, and of one of the parts into which a larger group is cut to be compared.
CHUNK = 1024
#: Parts in which the rows of one set meet their class.
SALTS = 16
#: Pairs whose sketches are compared at once.
PAIRS = 1 << 13
#: The largest count that a sketch holds.
MOST = 15


class PartEnum:
    """percent: the least similarity, in hundredths. second, differing: n2 and k2 of the second level for all bands; by
    default the cost formula chooses them, for `peers` sets in a band."""

    def __init__(self, percent: int, second: int | None = None, differing: int | None = None, peers: int = PEERS):
        if not 0 < percent <= 100 or (second is None) != (differing is None) or second is not None and not 0 <= differing < second:
            raise ValueError("0 < percent <= 100 and 0 <= differing < second are needed")
        self.percent, self.peers = percent, peers
        self.given = None if second is None else (second, differing)
        self.tops = [1]
        self._layouts: dict[int, tuple[int, int, int]] = {}

    def largest(self, size: int) -> int:
        """The largest size of a set that can be similar to one of this size."""
        return 100 * size // self.percent

    def band(self, size: int) -> int:
        """The band that a size lies in."""
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, self.largest(self.tops[-1])))
        return int(np.searchsorted(self.tops, size))

    def apart(self, band: int) -> int:
        """k: in how many elements similar sets can differ if the larger is in the band."""
        return 2 * self.tops[band] * (100 - self.percent) // (100 + self.percent)

    def layout(self, band: int) -> tuple[int, int, int]:
        """n1, n2 and k2 of a band."""
        if band not in self._layouts:
            self._layouts[band] = self._cheapest(band)
        return self._layouts[band]

    def _cheapest(self, band: int) -> tuple[int, int, int]:
        k = self.apart(band)
        if self.given is not None:
            n2, k2 = self.given
            return -(-(k + 1) // (k2 + 1)), n2, k2
        if not k:  # only equal sets are similar
            return 1, 1, 0
        least = self.tops[band - 1] + 1 if band else 1

        def cost(n2: int, k2: int) -> float:
            n1 = -(-(k + 1) // (k2 + 1))
            return n1 * math.comb(n2, k2) * (WEIGHT + self.peers * math.exp(-2 * least / n1 * (n2 - k2) / n2))

        n2, k2 = min(((n2, k2) for k2 in range(1, min(8, k) + 1) for n2 in range(k2 + 2, 13)), key=lambda c: (cost(*c), c))
        return -(-(k + 1) // (k2 + 1)), n2, k2

    def count(self, size: int) -> int:
        """Signatures of a set of a size."""
        if not size:
            return 0
        return sum(n1 * math.comb(n2, k2) for n1, n2, k2 in map(self.layout, self.bands(size)))

    def bands(self, size: int) -> list[int]:
        own = self.band(size)
        return [own] if self.largest(size) <= self.tops[own] else [own, self.band(self.tops[own] + 1)]

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of sets of distinct uint64 hashes, the set each is of, and whether that set lies in the
        signature's band (and is no visitor from the band below)."""
        by_band: dict[int, list[tuple[int, bool]]] = {}
        for i, s in enumerate(sets):
            if len(s):
                for n, b in enumerate(self.bands(len(s))):
                    by_band.setdefault(b, []).append((i, n == 0))
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for b, members in by_band.items():
            n1, n2, k2 = self.layout(b)
            step = max(1, (1 << 18) // (n1 * n2))
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                own = [sets[i] for i, _ in part]
                h = mix(np.concatenate(own) * M1 + np.uint64(b))
                place = ((h >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
                place += np.repeat(np.arange(len(part)) * (n1 * n2), [len(s) for s in own])
                # the sum of hashes is a set's hash that needs no sort
                cells = np.zeros(len(part) * n1 * n2, np.uint64)
                np.add.at(cells, place, mix(h + M1))
                cells = mix(cells.reshape(-1, n2) + np.arange(1, n2 + 1, dtype=np.uint64) * M2)
                chosen = np.array(list(combinations(range(n2), n2 - k2)))
                picks = np.zeros((n2, len(chosen)), np.uint64)
                picks[chosen.T, np.arange(len(chosen))] = 1
                tag = mix(np.arange(n1 * len(chosen), dtype=np.uint64) + np.uint64(b << 40)).reshape(n1, -1)
                sigs = mix((cells @ picks).reshape(len(part), n1, -1) * M1 + tag).reshape(len(part), -1)
                at = np.repeat(np.array([i for i, _ in part]), sigs.shape[1])
                out.append((mix(sigs.ravel() + M1), at, np.repeat(np.array([x for _, x in part]), sigs.shape[1])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        return self.sign([elements])[0]


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, 64 bits each."""
    for lo, hi in slices([len(t) for t in texts], SLICE_BYTES):
        blob, ends = pack_texts(texts[lo:hi])
        words, doc = word_table(lower_ascii(blob), ends)
        terms, where = shingle_table(words, doc, hi - lo, size)
        cut = np.searchsorted(where, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield np.unique(terms[cut[i] : cut[i + 1]])


def _sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The ids and sets of some rows at a time, whose texts have a bounded size."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]
        for lo, hi in slices([len(t) for t in texts], SLICE_BYTES):
            yield ids[lo:hi], list(shingle_sets(texts[lo:hi], words))


def _mapped(docs: DataFrame, words: int, row: object, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """row(doc_id, set) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets_of(batches, words):
            rows = [row(i, s) for i, s in zip(ids, sets, strict=True)]  # type: ignore[operator]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))

    return in_small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy_stream(run), schema)


def described_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, set_key (128 bits of the set), sketch for every row."""
    row = lambda i, s: (i, len(s), xxhash.xxh3_128_digest(s.tobytes()), _sketch(s))
    return _mapped(docs, words, row, {"doc_id": pa.int64(), "n": pa.int64(), "set_key": pa.binary(), "sketch": pa.binary()}, "doc_id long, n long, set_key binary, sketch binary")


def element_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, elements (the sorted hashes, eight bytes each) for every row."""
    return _mapped(docs, words, lambda i, s: (i, s.astype("<u8").tobytes()), {"doc_id": pa.int64(), "elements": pa.binary()}, "doc_id long, elements binary")


# ---------------------------------------------------------------- sketches


def _sketch(elements: np.ndarray) -> bytes:
    """How many elements fall in each of m buckets, m a power of two near a quarter of the set, MOST at most, two
    buckets a byte. The sum of differences of two sets' counts is at most the number of elements in which they
    differ, cut off or not."""
    m = 1 << max(4, (max(1, len(elements) // 4) - 1).bit_length())
    h = (mix(elements ^ M1) >> np.uint64(40)).astype(np.int64) & (m - 1)
    n = np.minimum(np.bincount(h, minlength=m), MOST).astype(np.uint8)
    return (n[: m // 2] | n[m // 2 :] << 4).tobytes()


def _spread(sketches: np.ndarray, m: int) -> np.ndarray:
    """The counts of sketches (rows of bytes), folded to m buckets; cut off again, as if counted in those."""
    both = np.concatenate((sketches & 15, sketches >> 4), axis=1).astype(np.int16)
    return np.minimum(both.reshape(len(both), -1, m).sum(1, dtype=np.int16), MOST) if both.shape[1] > m else both


class Sketches:
    """The sizes and sketches of some sets, by number."""

    def __init__(self, n: np.ndarray, sketches: list[bytes]):
        self.n, self.rows = n, {}
        self.width = np.array([len(s) for s in sketches], np.int64)
        self.at = np.zeros(len(sketches), np.int64)
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(len(own), w)

    def possible(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs (a[i], b[i]) can reach the similarity, judged by size and sketch; loses no pair."""
        x, y = self.n[a], self.n[b]
        out = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        left = np.flatnonzero(out)
        # at similarity p the sets differ in at most (100 - p) / (100 + p) of the sum of their sizes
        allowed = (x + y) * (100 - percent) // (100 + percent)
        wa, wb = self.width[a[left]], self.width[b[left]]
        for u, v in set(zip(wa.tolist(), wb.tolist(), strict=True)):
            own = left[(wa == u) & (wb == v)]
            m = 2 * min(u, v)
            step = max(1, PAIRS * 64 // max(u, v))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                apart = np.abs(_spread(self.rows[u][self.at[a[part]]], m) - _spread(self.rows[v][self.at[b[part]]], m))
                out[part] = apart.sum(1, dtype=np.int64) <= allowed[part]
        return out


# ---------------------------------------------------------------- signatures to groups


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of uint64 values, plane by plane."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(planes: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _signature_message(sigs: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted signatures (48 bits, as differences), with the place of each one's id among the ids, and those."""
    docs, at = np.unique(rows >> 1, return_inverse=True)
    parts = _planes(np.diff(sigs, prepend=np.uint64(0)), 6) + _planes((at << 1 | rows & 1).astype(np.uint64), 4) + ids[docs].astype("<i8").tobytes()
    return np.array([len(sigs), len(docs)], "<i8").tobytes() + pa.compress(parts, codec="zstd", asbytes=True)


def _open_message(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, ids, and whether the set lies in the signature's band."""
    n, m = np.frombuffer(raw[:16], "<i8").tolist()
    body = pa.decompress(raw[16:], decompressed_size=10 * n + 8 * m, codec="zstd", asbytes=True)
    at = _values(body[6 * n : 10 * n], n, 4)
    return np.cumsum(_values(body[: 6 * n], n, 6), dtype=np.uint64), np.frombuffer(body[10 * n :], "<i8")[(at >> np.uint64(1)).astype(np.int64)], (at & np.uint64(1)).astype(bool)


def _sent(docs: DataFrame, words: int, scheme: PartEnum, buckets: int) -> DataFrame:
    """bucket, message: all signatures, in one message for each bucket and block of texts."""

    def emit(sigs: list, rows: list, ids: list) -> pa.RecordBatch:
        s, r, doc = np.concatenate(sigs), np.concatenate(rows), np.concatenate(ids)
        order = np.argsort(s)
        s, r = s[order], r[order]
        where = (s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.searchsorted(where, np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        s = s >> np.uint64(16)
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_signature_message(s[cuts[b] : cuts[b + 1]], r[cuts[b] : cuts[b + 1]], doc) for b in full], pa.binary())], ["bucket", "message"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list = []
        rows: list = []
        ids: list = []
        n = first = 0
        for own, sets in _sets_of(batches, words):
            s, i, native = scheme.sign(sets)
            sigs.append(s)
            rows.append((i + first) << 1 | native)
            ids.append(np.array(own, np.int64))
            n, first = n + len(s), first + len(own)
            if n >= BLOCK_SIGNATURES:
                yield emit(sigs, rows, ids)
                sigs, rows, ids, n, first = [], [], [], 0, 0
                _give_back()
        if n:
            yield emit(sigs, rows, ids)

    return in_small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy_stream(run), "bucket int, message binary")


def _group(table: pa.Table) -> pa.Table:
    """Of one bucket: the groups of two and more ids with one signature, one of them at least in its band. g: the
    hash of the members; m: the least; parts: a power of two, for CHUNK members in each on average; members: CHUNK in a
    row at most. Groups of the same members are one."""
    parts = [_open_message(x.as_py()) for x in table.column("message")]
    # the signatures alone are sorted first: few occur again, and only these carry their ids on
    every = np.sort(np.concatenate([p[0] for p in parts]))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    kept = []
    for s, doc, native in parts:
        at = np.searchsorted(again, s)
        own = np.flatnonzero(again[np.minimum(at, max(0, len(again) - 1))] == s) if len(again) else np.zeros(0, int)
        kept.append((at[own], doc[own], native[own]))
    at, doc, native = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((doc, at))
    at, doc, native = at[order], doc[order], native[order]
    fresh = np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))[: len(at)]
    start = np.flatnonzero(fresh)  # rows that repeat a doc_id count once
    g, m, many, members = [], [], [], []
    if len(start):
        native = np.logical_or.reduceat(native, start)
        at, doc = at[start], doc[start]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        size = np.diff(np.append(first, len(at)))
        mine = np.add.reduceat(mix(doc.view(np.uint64) * M1 + M2), first) + size.astype(np.uint64)
        good = np.flatnonzero(np.logical_or.reduceat(native, first) & (size > 1))
        for j in good[np.unique(mine[good], return_index=True)[1]].tolist():
            own = doc[first[j] : first[j] + size[j]]
            for lo in range(0, len(own), CHUNK):
                g.append(int(mine[j].view(np.int64)))
                m.append(int(own[0]))
                many.append(1 << (-(-len(own) // CHUNK) - 1).bit_length())
                members.append(own[lo : lo + CHUNK])
    return pa.table({"g": pa.array(g, pa.int64()), "m": pa.array(m, pa.int64()), "parts": pa.array(many, pa.int32()), "members": pa.array(members, pa.list_(pa.int64()))})


def signature_groups(docs: DataFrame, words: int, scheme: PartEnum, buckets: int) -> DataFrame:
    """g, m, parts, members array<long>: the groups of ids that share a signature; some may come from several buckets."""
    return _sent(docs, words, scheme, buckets).groupBy("bucket").applyInArrow(tidy_group(_group), "g long, m long, parts int, members array<long>")


# ---------------------------------------------------------------- groups to links


def _filtered(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that size and sketch allow."""
    x = features.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = features.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            s = Sketches(np.concatenate((batch.column(2).to_numpy(), batch.column(4).to_numpy())), batch.column(3).to_pylist() + batch.column(5).to_pylist())
            yield batch.select([0, 1]).filter(pa.array(s.possible(np.arange(n), np.arange(n, 2 * n), percent), pa.bool_()))

    return in_small_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "sa", "nb", "sb")).mapInArrow(tidy_stream(run), "a long, b long").distinct()


def _candidates(group: np.ndarray, row: np.ndarray, comp: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The distinct pairs of rows (a < b, as a * rows + b) that share a group and lie in unlike components. group: of
    each membership, sorted; row: its row. own, other: a row's part, and that which the unit compares it with; where
    these differ, only rows of unlike parts meet."""
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    last = np.repeat(cut[1:], np.diff(cut))
    found, waiting, size = np.zeros(0, np.int64), [], 0
    step, at = 1, np.arange(len(group))
    while len(at := at[at + step < last[at]]):  # all pairs at a distance in the groups' order
        for lo in range(0, len(at), 1 << 18):
            x, y = row[at[lo : lo + (1 << 18)]], row[at[lo : lo + (1 << 18)] + step]
            ok = (comp[x] != comp[y]) & ((own[x] == other[x]) | (own[x] != own[y]))
            waiting.append(np.minimum(x, y)[ok] * len(comp) + np.maximum(x, y)[ok])
            size += len(waiting[-1])
            if size > 1 << 20:
                found, waiting, size = np.unique(np.concatenate([found, *waiting])), [], 0
        step += 1
    return np.unique(np.concatenate([found, *waiting]))


def _still_open(groups: DataFrame, features: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of unlike components within the groups, as far as size and sketch allow. Groups with the same least
    member are judged together, so a pair that shares many groups is compared once; groups of more than CHUNK members are
    cut into parts, and pairs of parts are compared apart."""
    members = groups.select("g", "m", "parts", F.explode("members").alias("doc_id")).join(components, F.col("doc_id") == F.col("node"), "left").select("g", "m", "parts", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    # where all members are in one component nothing is left to find
    open_ = members.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g")
    # the part of a group that each bucket found lists the same members, so its rows fall together
    left = members.join(open_, "g", "left_semi").groupBy("m", "parts", "doc_id").agg(F.first("comp").alias("comp"), F.collect_set("g").alias("gs"))
    left = materialize(left, "jaccard-open")
    dealt = (
        left.withColumn("own", F.expr("int(pmod(xxhash64(doc_id), parts))"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .withColumn("k", F.xxhash64("m", "parts", F.least("own", "other"), F.greatest("own", "other")))
        .join(features, "doc_id")
        .select("k", "own", "other", "doc_id", "comp", "gs", "n", "sketch")
    )
    tasks = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.count() // 5_000)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        k, own, other, ids, comp, n = (table.column(c).to_numpy() for c in ("k", "own", "other", "doc_id", "comp", "n"))
        gs = table.column("gs").combine_chunks()
        group, reach = gs.flatten().to_numpy(), np.append(0, np.cumsum(gs.value_lengths().to_numpy()))
        cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        sketches = table.column("sketch")
        out = [np.zeros((2, 0), np.int64)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            g, row = group[reach[lo] : reach[hi]], np.repeat(np.arange(hi - lo), np.diff(reach[lo : hi + 1]))
            order = np.argsort(g, kind="stable")
            pairs = _candidates(g[order], row[order], comp[lo:hi], own[lo:hi], other[lo:hi])
            if len(pairs):
                a, b = np.divmod(pairs, hi - lo)
                fits = Sketches(n[lo:hi], sketches.slice(lo, hi - lo).to_pylist()).possible(a, b, percent)
                x, y = ids[lo:hi][a[fits]], ids[lo:hi][b[fits]]
                out.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": a, "b": b})

    return dealt.groupBy(F.pmod("k", F.lit(tasks)).alias("task")).applyInArrow(tidy_group(run), "a long, b long").distinct()


def _verified(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar, by exact intersection."""
    a = elements.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea"))
    b = elements.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return in_small_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "ea", "eb")).mapInArrow(tidy_stream(run), "a long, b long")


def _only(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """df semi- or anti-joined with ids: broadcast while they are few, shuffled beyond."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _similar(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are similar by their whole sets, written."""
    pairs = materialize(pairs, "jaccard-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    elements = materialize(element_sets(_only(docs, ids, "left_semi"), words), "jaccard-elements")
    links = materialize(_verified(pairs, elements, percent), "jaccard-links")
    discard(pairs, elements)
    return links


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90, second: int | None = None, differing: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct word shingles
    (letters A-Z as a-z; words are runs of bytes other than space and 9 to 13; fewer words than a shingle has
    give the whole sequence as one). component_id is the smallest doc_id reachable by links. Texts that are null
    or have no words have an empty set and link with nothing. Rows with equal sets are one class from the start
    and are never paired; rows that share a doc_id count as one document. A row with a null doc_id takes part through
    rows of equal set alone, and has a null component if there are none. An empty table gives an empty one.

    Rows with equal signatures form groups. In a first round each member is paired with the least of its group; in a
    second all members that are not yet in one component. Size and sketch drop pairs that cannot be similar, and every
    pair left is verified on the whole sets, so the components are exact while a group of mutual copies costs pairs in
    proportion to its size. The signatures go to the groups' buckets as sorted differences of 48 bits, a fifth of what
    rows would take; that two signatures agree in these bits by chance costs one comparison.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = materialize(described_sets(docs, words), "jaccard-sets")
    filled = sets.where("n > 0")
    # a class of several rows is represented by its first; the others are not signed. Copies meet their class by parts
    classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").select("set_key", "rep")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("part")
    salted = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = filled.where("doc_id is not null").select("doc_id", "set_key", part).join(salted(classes), ["set_key", "part"], "left")
    ids = materialize(named.groupBy("doc_id").agg(F.min(F.coalesce(F.col("rep") != F.col("doc_id"), F.lit(False))).alias("copy"), F.count("*").alias("rows")), "jaccard-ids")
    copies = ids.where("copy").select("doc_id")
    signed = _only(docs.where("doc_id is not null"), copies, "left_anti")
    features = filled.select("doc_id", "n", "sketch")
    n_sets, shingles = filled.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    scheme = PartEnum(percent, second, differing, max(PEERS, n_sets // 8))
    each = max(scheme.count(n) / n for n in (50, 500, 5000))
    buckets = int(min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles * each // BUCKET_SIGNATURES)))
    groups = materialize(signature_groups(signed, words, scheme, buckets), "jaccard-groups")
    stars = groups.select(F.col("m").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct()
    links = _similar(_filtered(stars, features, percent), docs, words, percent)
    rest = _similar(_still_open(groups, features, connected_components(links), percent), docs, words, percent)
    # a doc_id of several rows links the classes of all of them
    repeated = named.where("rep <> doc_id").join(ids.where("rows > 1").select("doc_id"), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    components = connected_components(links.unionByName(rest).unionByName(repeated))
    discard(groups, links, rest, ids)
    shared = classes.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("shared"))
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"), "set_key", part)
        .join(salted(shared), ["set_key", "part"], "left")
        .join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("shared", "component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_shingles and component_id of every document by three-word shingles at 90 %: nulls, short and repeated texts as in
    jaccard_components."""
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"), 3, 90)
