"""Byte-level BPE encoding and decoding over length-bucketed, padded numpy matrices.

Distinct pre-tokens of a slice of texts stand as rows of integer matrices, one matrix for each length class. In
each round every row that still can merges its leftmost pair of minimum rank: pairs are looked up in a hash table
held in arrays, the merged token replaces the left one, and the rest of the row closes up. Rows with no pair left
leave the matrix. A long pre-token is folded: its bytes fill a padded matrix row after row, a round merges the leftmost
minimum of the rows' minima, and only the row that holds it closes up, so its length costs no square.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.common import documents, in_small_batches, tidy_stream

#: Longer pre-tokens are folded into matrices of this width.
FOLD_BYTES = 256
#: Texts are taken in slices of about so many characters; the cache of encoded pre-tokens is emptied beyond so many.
SLICE_CHARS = 1 << 20
CACHE_ENTRIES = 300_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """rank of the token that a pair of tokens makes, by open addressing over one array of keys."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            mine = todo[free]
            self.keys[slot[mine]] = keys[mine]  # of several that want one slot, the last gets it
            won = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.arange(keys.size)
        flat, slots, res = keys.ravel(), slot.ravel(), out.ravel()
        while len(todo):
            seen = self.keys[slots[todo]]
            hit = seen == flat[todo]
            res[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (seen != np.uint64(2**64 - 1))]
            slots[todo] = (slots[todo] + 1) & self.mask
        return res.reshape(keys.shape)


class Codec:
    """ranks: the vocabulary, bytes to rank; every single byte must be in it. pattern: cuts a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.vocabulary = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[a], ranks[b], i) for t, i in ranks.items() for k in range(1, len(t)) if (a := t[:k]) in ranks and (b := t[k:]) in ranks]
        self.pairs = PairTable(*(np.array([p[k] for p in pairs], np.int64) for k in range(3)))
        self.cache: dict[str, bytes] = {}

    def merge_matrix(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of pre-tokens of like length."""
        size = np.array([len(t) for t in tokens])
        m = np.full((len(tokens), int(size.max())), -1, np.int32)
        inside = np.arange(m.shape[1]) < size[:, None]
        m[inside] = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        out: list[np.ndarray] = [None] * len(tokens)  # type: ignore[list-item]
        row = np.arange(len(tokens))
        # rank[:, i] is that of the pair (i, i + 1); one column more than pairs, never a minimum, keeps widths equal
        rank = np.full(m.shape, NONE, np.int32)
        valid = inside[:, 1:]
        rank[:, :-1][valid] = self.pairs.find(m[:, :-1][valid], m[:, 1:][valid])
        while len(row):
            at = rank.argmin(1)  # the leftmost of the least
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for r, ids in zip(row[done].tolist(), m[done], strict=True):
                    out[r] = ids[ids >= 0]
                keep = ~done
                row, m, rank, at, best = row[keep], m[keep], rank[keep], at[keep], best[keep]
                if not len(row):
                    break
            k, n = np.arange(len(row)), m.shape[1]
            # the merged token replaces the left one; each row closes up by the right one, and its pair goes
            m[k, at] = best
            left = np.ones(m.shape, bool)
            left[k, at + 1] = False
            m = m[left].reshape(len(row), n - 1)
            left[k, at + 1] = True
            left[k, at] = False
            rank = rank[left].reshape(len(row), n - 1)
            # the pairs left and right of the new token
            before = np.flatnonzero(at > 0)
            after = np.flatnonzero((at + 1 < n - 1) & (m[k, np.minimum(at + 1, n - 2)] >= 0))
            r, c = np.concatenate((before, after)), np.concatenate((at[before] - 1, at[after]))
            rank[k, at] = NONE
            rank[r, c] = self.pairs.find(m[r, c], m[r, c + 1])
        return out

    def merge_folded(self, token: bytes, width: int = FOLD_BYTES) -> np.ndarray:
        """Ids of one long pre-token. The pair of a row's last token is with the first one of the next row that is not
        empty; its rank stands at that last place."""
        n = len(token)
        m = np.full((-(-n // width), width), -1, np.int32)
        m.reshape(-1)[:n] = self.bytes[np.frombuffer(token, np.uint8)]
        rank = np.full(m.shape, NONE, np.int32)
        flat = m.reshape(-1)[:n]
        rank.reshape(-1)[: n - 1] = self.pairs.find(flat[:-1], flat[1:])
        least = rank.min(1)
        size = (m >= 0).sum(1).tolist()
        after, before = list(range(1, len(m))) + [-1], list(range(-1, len(m) - 1))
        known: dict[tuple[int, int], int] = {}

        def pair(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs.find(np.array([a]), np.array([b]))[0])
            return known[a, b]

        def close_up(r: int, at: int) -> None:
            """Takes out the token at a place of a row."""
            m[r, at:-1], m[r, -1] = m[r, at + 1 :].copy(), -1
            rank[r, at:-1], rank[r, -1] = rank[r, at + 1 :].copy(), NONE
            size[r] -= 1

        while True:
            r = int(least.argmin())  # the leftmost of the least
            best = int(least[r])
            if best == NONE:
                break
            at, touched = int(rank[r].argmin()), {r}
            if at + 1 < size[r]:
                close_up(r, at + 1)
            else:
                q = after[r]
                close_up(q, 0)
                touched.add(q)
                if not size[q]:
                    after[r] = after[q]
                    if after[q] >= 0:
                        before[after[q]] = r
            m[r, at] = best
            right = m[r, at + 1] if at + 1 < size[r] else m[after[r], 0] if after[r] >= 0 else -1
            rank[r, at] = pair(best, int(right)) if right >= 0 else NONE
            if at or before[r] >= 0:
                b, c = (r, at - 1) if at else (before[r], size[before[r]] - 1)
                rank[b, c] = pair(int(m[b, c]), best)
                touched.add(b)
            for x in touched:
                least[x] = rank[x].min()
        return m[m >= 0]

    def learn(self, tokens: set[str]) -> None:
        """Puts the ids of new pre-tokens in the cache, as little-endian 32-bit numbers."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for t in tokens:
            raw = t.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[t] = whole.to_bytes(4, "little")
            elif len(raw) > FOLD_BYTES:
                self.cache[t] = self.merge_folded(raw).astype("<u4").tobytes()
            else:
                n = len(raw)
                buckets.setdefault((n + 3) // 4 if n <= 32 else 8 + (n + 31) // 32, []).append((t, raw))
        for rows in buckets.values():
            for lo in range(0, len(rows), 20_000):
                part = rows[lo : lo + 20_000]
                for (t, _), ids in zip(part, self.merge_matrix([r for _, r in part]), strict=True):
                    self.cache[t] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [self.find(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        self.learn({t for x in cut for t in x}.difference(self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file's lines: base64 of the token, a space, its rank."""
    return {base64.b64decode(t): int(i) for t, i in (line.split() for line in raw.splitlines() if line.strip())}


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process: the vocabulary is read from an installed package, there on every node."""
    with open(path, "rb") as f:
        return Codec(parse_ranks(f.read()), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int> if asked) for every row of docs.

    path: a rank file at the same place on every node. Null text encodes as the empty one: no ids, both digests
    those of nothing. Special tokens are ordinary text. Repeated rows give repeated results. Other columns are
    left behind. Narrow: no shuffle, rows stream in slices of bounded size.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids, texts, total, start = batch.column(0).to_pylist(), [], 0, 0
            column = batch.column(1)
            for i in range(len(ids)):
                texts.append(column[i].as_py() or "")
                total += len(texts[-1])
                if total >= SLICE_CHARS or i + 1 == len(ids):
                    coded = c.encode(texts)
                    out = [ids[start : i + 1], [len(x) // 4 for x in coded], [hashlib.sha256(x).hexdigest() for x in coded], [hashlib.sha256(c.decode(x)).hexdigest() for x in coded]]
                    arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                    if with_ids:
                        arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])
                    texts, total, start = [], 0, i + 1

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(tidy_stream(run), schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and digests of the ids and of the decoded bytes of every document: nulls, empty and very long texts as in
    encode_documents."""
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
