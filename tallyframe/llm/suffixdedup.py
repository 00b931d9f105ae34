"""Suffix-array dedup: bytes covered by a string of MATCH bytes that also starts earlier in the collection.

Cutting into collections. Every window of MATCH bytes is led by an anchor, the ANCHOR-byte string in it whose hash
is least; neighbouring windows with one anchor make a piece. Equal windows have equal anchors at equal offsets, so
all that can match meets in the collection of its anchor's hash bucket. Hashes only choose what meets: pieces whose
anchor occurs once are left out, all others are compared. Within a block of texts, pieces that are equal byte for byte
are sent once.

Column-wise construction, in each collection. Pieces stand aligned at their anchors and are read from their last
column to their first. Each round inserts one symbol of every piece in front of its suffix: the symbols in the
order of the suffixes are that column of the Burrows-Wheeler transform, and a stable sort by symbol (the
LF-mapping, in each anchor's interval) gives the places of the longer suffixes. The common prefix of two
neighbours is one more than the least common prefix between their former places if their symbols agree, else
nothing. Windows of one column only ever match windows of that column, so columns are never merged into one list.
The symbols of a column, its transform, and the order and common prefixes of the suffixes are sequential files in the
task's temporary folder, read from front to end and written anew each round; they go when the collection is done (a
retried task builds its own). Neighbours with MATCH bytes in common are equal windows.

Texts lie in compressed blocks in a bucketed table in the warehouse, one bucket for each input partition, so three
passes read them where they are and only anchors, candidate pieces and verdicts are shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyframe.llm.common import _BASE, _INVERSE, M1, _give_back, _powers, documents, in_small_batches, mix, slices, tidy_group, tidy_pair, tidy_stream
from tallyframe.storage import bucketed, discard, materialize

MATCH = 100
ANCHOR = 32
#: Text of one block: numbers for each byte of it are held at once.
BLOCK_BYTES = 1 << 19
#: Text whose pieces meet in one collection, on average.
BUCKET_BYTES = 1 << 22
MAX_BUCKETS = 20_000
#: The blocks of one partition stand in so many groups: a group's blocks and verdicts are held at once.
SLOTS = 16
_LEFT = MATCH - ANCHOR  # an anchor starts at most so far behind its piece's start
_COLUMNS = _LEFT + MATCH


# ---------------------------------------------------------------- pieces


class Pieces:
    """The pieces of one block of texts: text of the block, and for each piece start, end, anchor and hashes."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
        n, empty = len(self.buf), np.zeros(0, np.int64)
        self.start = self.end = self.anchor = empty
        self.hash = self.content = np.zeros(0, np.uint64)
        if n < MATCH:
            return
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
        back = _powers(_INVERSE, n)
        h = sums[ANCHOR:] - sums[:-ANCHOR]
        h *= back[: n - ANCHOR + 1]
        h = mix(h + M1)
        lead = _window_min(h, MATCH - ANCHOR + 1)
        # windows inside one text
        doc_start = self.ends - np.diff(self.ends, prepend=0)
        inside = np.zeros(n - MATCH + 2, np.int32)
        long = self.ends - doc_start >= MATCH
        np.add.at(inside, doc_start[long], 1)
        np.add.at(inside, self.ends[long] - MATCH + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        if not len(at):
            return
        lead = lead[at]
        first = np.flatnonzero(np.diff(lead, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        self.start, self.end, self.anchor = at[first], at[last] + MATCH, lead[first]
        self.hash = h[self.anchor]
        self.content = mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64) * M1)

    def firsts(self) -> np.ndarray:
        """Which pieces have no equal one before them in the block. Hashes find the earlier one, bytes decide; a piece
        that only hashes alike counts as a first."""
        order = np.lexsort((np.arange(len(self.hash)), self.content, self.hash))
        h, c = self.hash[order], self.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        out = np.zeros(len(order), bool)
        out[order[new]] = True
        again = np.flatnonzero(~new)
        one, other = order[again], order[np.flatnonzero(new)[np.cumsum(new)[again] - 1]]
        size = self.end[one] - self.start[one]
        other, one, size = (x[size == self.end[other] - self.start[other]] for x in (other, one, size))
        same = np.zeros(len(self.hash), bool)
        for lo in range(0, len(one), 4096):
            x, y, n = one[lo : lo + 4096], other[lo : lo + 4096], size[lo : lo + 4096]
            at = np.arange(int(n.max()))
            inside = at < n[:, None]
            left, right = (self.buf[np.where(inside, self.start[k][:, None] + at, 0)] for k in (x, y))
            same[x] = ((left == right) | ~inside).all(1)
        return ~same

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Where the least (then leftmost) of every w neighbouring hashes stands, by block-wise running minima."""
    n = len(h)
    key = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    key[:n] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, w)
    ahead = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, 1).ravel()
    return (np.minimum(ahead[: n - w + 1], behind[w - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


# ---------------------------------------------------------------- column-wise construction


def _least_between(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(lcp[a + 1 .. b]) for each pair a < b."""
    out, far = lcp[b], np.flatnonzero(b - a > 1)
    if len(far):
        lo, hi = a[far] + 1, b[far]
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        table, least = lcp, np.empty(len(far), lcp.dtype)
        for k in range(int(level.max()) + 1):
            if k:
                half = 1 << (k - 1)
                table = np.minimum(table[:-half], table[half:])
            q = level == k
            least[q] = np.minimum(table[lo[q]], table[hi[q] - (1 << k) + 1])
        out = out.copy()
        out[far] = least
    return out


def repeated_windows(group: np.ndarray, rank: np.ndarray, left: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which windows of the pieces equal a window of a piece of lower rank.

    group: the anchor's hash; pieces of one anchor only can match. left: where in a piece its anchor starts. size:
    the pieces' lengths; text: their bytes, one after another. Returns pieces x (MATCH - ANCHOR + 1) booleans, by
    the window's start in the aligned columns: column c of a piece is its byte c - (_LEFT - left).
    """
    m = len(group)
    out = np.zeros((m, _LEFT + 1), bool)
    if not m:
        return out
    begin = _LEFT - left
    stop = begin + size
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as transform, tempfile.TemporaryFile() as suffixes:

        def put(file: IO[bytes], *arrays: np.ndarray) -> None:
            file.seek(0)
            for x in arrays:
                file.write(np.ascontiguousarray(x).data)
            file.seek(0)

        def get(file: IO[bytes], kind: type) -> np.ndarray:
            return np.frombuffer(file.read(m * np.dtype(kind).itemsize), kind)

        grid = np.zeros((_COLUMNS, m), np.uint8)  # the last column first, as they are read
        cut = np.append(0, np.cumsum(size))
        for lo in range(0, m, 4096):
            part = np.arange(lo, min(m, lo + 4096))
            own = np.repeat(part, size[part])
            grid[_COLUMNS - 1 - (np.arange(cut[lo], cut[part[-1] + 1]) - cut[own] + begin[own]), own] = text[cut[lo] : cut[part[-1] + 1]]
        put(columns, grid)
        del grid
        order = np.argsort(group, kind="stable")
        first = np.ones(m, bool)
        first[1:] = group[order][1:] != group[order][:-1]
        base = (np.cumsum(first, dtype=np.int64) - 1) * 257  # of the slots; stays, as sorting never leaves an interval
        put(suffixes, order.astype(np.int32), np.zeros(m, np.int16))
        for c in range(_COLUMNS - 1, -1, -1):
            order, lcp = get(suffixes, np.int32), get(suffixes, np.int16)
            live = (begin[order] <= c) & (c < stop[order])
            # the symbols that stand before the suffixes, in their order; 0 where a piece has none
            put(transform, np.where(live, get(columns, np.uint8)[order].astype(np.int16) + 1, np.int16(0)))
            key = base + get(transform, np.int16)
            places = np.argsort(key, kind="stable")
            order, key = order[places], key[places]
            same = np.zeros(m, bool)
            same[1:] = (key[1:] == key[:-1]) & live[places][1:]
            s = np.flatnonzero(same)
            longer = np.zeros(m, np.int16)
            longer[s] = np.minimum(_least_between(lcp, places[s - 1], places[s]) + 1, MATCH)
            put(suffixes, order, longer)
            if c <= _LEFT:
                equal = np.flatnonzero(longer >= MATCH)
                if len(equal):
                    run = np.cumsum(longer < MATCH) - 1
                    lowest = np.minimum.reduceat(rank[order], np.flatnonzero(longer < MATCH))
                    members = np.union1d(equal, equal - 1)
                    again = members[rank[order[members]] > lowest[run[members]]]
                    out[order[again], c] = True
    return out


# ---------------------------------------------------------------- messages


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message: its full length, then for each array its name and bytes."""
    parts = []
    for k, v in arrays.items():
        parts += [struct.pack("<B", len(k)), k.encode(), struct.pack("<Q", v.nbytes), v.tobytes()]
    raw = b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(message: bytes) -> dict[str, bytes]:
    raw = pa.decompress(message[8:], decompressed_size=struct.unpack_from("<Q", message)[0], codec="zstd", asbytes=True)
    out, at = {}, 0
    while at < len(raw):
        n = raw[at]
        k = raw[at + 1 : at + 1 + n].decode()
        size = struct.unpack_from("<Q", raw, at + 1 + n)[0]
        at += 9 + n
        out[k] = raw[at : at + size]
        at += size
    return out


def _messages(table: pa.Table) -> Iterator[tuple[int, int, dict[str, bytes]]]:
    for slot, seq, m in zip(table.column("slot").to_pylist(), table.column("seq").to_pylist(), table.column("message"), strict=True):
        yield slot, seq, _unpack(m.as_py())


_MESSAGE = "bucket int, slot int, seq int, message binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> dict[str, pa.Array]:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(("bucket", "slot", "seq", "message"), kinds, strict=True))}


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket (and hash), and where each bucket starts in it. Anchors have low hashes, so these are mixed."""
    b = ((mix(h + M1) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((h, b))
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


# ---------------------------------------------------------------- blocks


def _slot_keys(spark: SparkSession, buckets: int, each: int) -> list[list[int]]:
    """For each bucket so many ints that the engine's own bucket hash puts there: at most MAX_BUCKETS * SLOTS ints."""
    bucket, reach = F.pmod(F.hash("key"), F.lit(buckets)), 4
    while True:
        keys = spark.range(buckets * each * reach).select(F.col("id").cast("int").alias("key"))
        found = keys.groupBy(bucket.alias("bucket")).agg(F.slice(F.sort_array(F.collect_list("key")), 1, each).alias("keys")).orderBy("bucket").collect()
        if len(found) == buckets and all(len(r["keys"]) == each for r in found):
            return [r["keys"] for r in found]
        reach *= 2


def _store(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The texts in blocks (slot, seq, n_bytes, block), each sorted by doc_id, bucketed by slot. A partition fills a
    bucket; its blocks go by turns to the bucket's slots, the groups in which later passes read them."""
    buckets = max(1, min(MAX_BUCKETS, docs.rdd.getNumPartitions()))
    keys = _slot_keys(docs.sparkSession, buckets, SLOTS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, seq = keys[part % buckets], part // buckets << 20
        for batch in batches:
            sizes = [x or 0 for x in pc.binary_length(batch.column(1)).to_pylist()]
            for lo, hi in slices(sizes, BLOCK_BYTES):
                rows = batch.slice(lo, hi - lo)
                ids = pc.fill_null(rows.column(0), -(1 << 63))
                texts = pc.fill_null(rows.column(1), "").cast(pa.large_binary())
                block = pa.RecordBatch.from_arrays([ids, texts, *rows.columns[2:]], ["doc_id", "text", *keep])
                block = block.take(pa.array(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(block)
                out = [pa.array([own[seq % SLOTS]], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(sizes[lo:hi])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["slot", "seq", "n_bytes", "block"])
                seq += 1

    rows = in_small_batches(docs.select(F.col("doc_id").cast("long"), "text", *keep)).mapInArrow(tidy_stream(pack), "slot int, seq int, n_bytes long, block binary")
    return bucketed(rows, "suffix_blocks", buckets, "slot")


def _block(raw: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.BufferReader(raw)).read_next_batch()


def _texts(block: pa.Buffer) -> tuple[np.ndarray, list[bytes]]:
    batch = _block(block)
    return batch.column(0).to_numpy(), batch.column(1).to_pylist()


# ---------------------------------------------------------------- passes


def _fingerprints(blocks: DataFrame, buckets: int) -> DataFrame:
    """Messages with the anchor's hash and the index of each block's first pieces, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, seq, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                p = Pieces(_texts(block.as_buffer())[1])
                keep = np.flatnonzero(p.firsts())
                rows = []
                order, cuts = _by_bucket(p.hash[keep], buckets)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    at = keep[order[cuts[b] : cuts[b + 1]]]
                    rows.append((b, slot, seq, _pack(hash=p.hash[at], index=at.astype(np.uint32))))
                if rows:
                    yield pa.RecordBatch.from_pydict(_rows(rows))
                _give_back()

    return blocks.select("slot", "seq", "block").mapInArrow(tidy_stream(run), _MESSAGE)


def _judge(table: pa.Table) -> pa.Table:
    """Of one bucket: which pieces share their anchor with another, and must be compared."""
    where = [(slot, seq) for slot, seq, _ in _messages(table)]
    hashes = [np.frombuffer(m["hash"], np.uint64) for _, _, m in _messages(table)]  # sorted, each
    every = np.sort(np.concatenate(hashes))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    if len(again):
        for at, h, (_, _, m) in zip(where, hashes, _messages(table), strict=True):
            index = np.frombuffer(m["index"], np.uint32)[again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h]
            if len(index):
                out.append((0, *at, _pack(compare=np.sort(index))))
    return pa.table(_rows(out))


def _asked(buckets: int):
    def run(blocks: pa.Table, verdicts: pa.Table) -> pa.Table:
        """The bytes of the pieces to compare, by bucket."""
        asked: dict[tuple[int, int], list[np.ndarray]] = {}
        for slot, seq, m in _messages(verdicts):
            asked.setdefault((slot, seq), []).append(np.frombuffer(m["compare"], np.uint32))
        rows = []
        for slot, seq, block in zip(blocks.column("slot").to_pylist(), blocks.column("seq").to_pylist(), blocks.column("block"), strict=True):
            at = np.sort(np.concatenate(asked.get((slot, seq)) or [np.zeros(0, np.uint32)])).astype(np.int64)
            if not len(at):
                continue
            ids, texts = _texts(block.as_buffer())
            p = Pieces(texts)
            order, cuts = _by_bucket(p.hash[at], buckets)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = at[order[cuts[b] : cuts[b + 1]]]
                size = p.end[mine] - p.start[mine]
                take = np.repeat(p.start[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                rows.append(
                    (b, slot, seq, _pack(hash=p.hash[mine], doc=ids[p.doc_of(p.start[mine])], index=mine.astype(np.uint32), left=(p.anchor[mine] - p.start[mine]).astype(np.uint8), size=size.astype(np.uint16), text=p.buf[take]))
                )
        return pa.table(_rows(rows))

    return run


def _compare(table: pa.Table) -> pa.Table:
    """Column-wise construction over one bucket's collection; the repeated windows, by block."""
    kinds = {"hash": np.uint64, "doc": np.int64, "index": np.uint32, "left": np.uint8, "size": np.uint16, "text": np.uint8}
    parts, where = [], []
    for slot, seq, m in _messages(table):
        parts.append({k: np.frombuffer(m[k], t) for k, t in kinds.items()})
        where.append((slot, seq))
    source = np.repeat(np.arange(len(where)), [len(p["hash"]) for p in parts])
    a = {k: np.concatenate([p.pop(k) for p in parts]) for k in kinds}
    place = np.empty(len(where), np.int64)
    place[sorted(range(len(where)), key=where.__getitem__)] = np.arange(len(where))
    rank = np.empty(len(source), np.int64)
    rank[np.lexsort((a["index"], place[source], a["doc"]))] = np.arange(len(source))
    again = repeated_windows(a["hash"], rank, a["left"].astype(np.int64), a["size"].astype(np.int64), a["text"])
    hit = again.any(1)
    rows = []
    for s in np.unique(source[hit]).tolist():
        own = np.flatnonzero(hit & (source == s))
        rows.append((0, *where[s], _pack(index=a["index"][own], windows=np.packbits(again[own], axis=1))))
    return pa.table(_rows(rows))


def _removed(texts: list[bytes], index: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The bytes of a block to remove, given the repeated windows of its first pieces."""
    p = Pieces(texts)
    edge = np.zeros(len(p.buf) + 1, np.int32)
    again = ~p.firsts()
    np.add.at(edge, p.start[again], 1)
    np.add.at(edge, p.end[again], -1)
    row, column = np.nonzero(windows)
    at = p.anchor[index[row]] - _LEFT + column
    np.add.at(edge, at, 1)
    np.add.at(edge, at + MATCH, -1)
    return np.cumsum(edge[:-1]) > 0


def _finish(with_text: bool, keep: tuple[str, ...], kinds: list[pa.DataType]):
    mask = -(-(_LEFT + 1) // 8)

    def run(blocks: pa.Table, verdicts: pa.Table) -> pa.Table:
        said: dict[tuple[int, int], list[dict[str, bytes]]] = {}
        for slot, seq, m in _messages(verdicts):
            said.setdefault((slot, seq), []).append(m)
        out = []
        for slot, seq, raw in zip(blocks.column("slot").to_pylist(), blocks.column("seq").to_pylist(), blocks.column("block"), strict=True):
            block = _block(raw.as_buffer())
            ids, texts = block.column(0).to_pylist(), block.column(1).to_pylist()
            got = said.get((slot, seq), [])
            index = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(m["index"], np.uint32) for m in got)])
            bits = np.concatenate([np.zeros((0, mask), np.uint8), *(np.frombuffer(m["windows"], np.uint8).reshape(-1, mask) for m in got)])
            gone = _removed(texts, index, np.unpackbits(bits, axis=1, count=_LEFT + 1))
            n, spans, kept, at = [], [], [], 0
            for t in texts:
                g = gone[at : at + len(t)]
                at += len(t)
                n.append(int(g.sum()))
                spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + bool(len(g) and g[0]))
                kept.append(np.frombuffer(t, np.uint8)[~g].tobytes() if n[-1] else t)
            columns = {
                "doc_id": pa.array([None if i == -(1 << 63) else i for i in ids], pa.int64()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array(n, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
            if with_text:
                columns["kept_text"] = pa.array([k.decode("utf-8", errors="ignore") for k in kept], pa.string())
            out.append(pa.table(columns | {k: block.column(k) for k in keep}))
        if out:
            return pa.concat_tables(out)
        kinds_ = [pa.int64()] * 4 + [pa.string()] * (1 + with_text) + kinds
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text, *keep]
        return pa.table({k: pa.array([], t) for k, t in zip(names, kinds_, strict=True)})

    return run


def dedup_substrings(docs: DataFrame, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and kept_text: the bytes left, where a cut
    inside a character drops that character; and the columns named in keep).

    A byte goes if some string of MATCH bytes that covers it also starts earlier: in a document of smaller doc_id,
    or earlier in the same one; strings are judged on the input, overlaps count. Rows that share a doc_id are
    ordered by where they were read. A null doc_id stands before all others; null text counts as empty. Texts
    shorter than MATCH bytes stay whole. An empty table gives an empty one. Extra columns are left behind.
    """
    spark = docs.sparkSession
    blocks = _store(docs, keep)
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES, 1)
    prints = _fingerprints(blocks, buckets)
    judged = materialize(prints.groupBy("bucket").applyInArrow(tidy_group(_judge), _MESSAGE), "suffix-judged")
    pieces = blocks.groupBy("slot").cogroup(judged.groupBy("slot")).applyInArrow(tidy_pair(_asked(buckets)), _MESSAGE)
    compared = materialize(pieces.groupBy("bucket").applyInArrow(tidy_group(_compare), _MESSAGE), "suffix-compared")
    discard(judged)
    kinds = [to_arrow_type(docs.schema[k].dataType) for k in keep]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return blocks.groupBy("slot").cogroup(compared.groupBy("slot")).applyInArrow(tidy_pair(_finish(with_text, keep, kinds)), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_bytes, n_removed, n_spans and the digest of the bytes kept for every document: nulls, ties and repeats as in
    dedup_substrings."""
    return dedup_substrings(documents(spark, sf_dir, "doc_id", "text"))
