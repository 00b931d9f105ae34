"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a slice of texts, sorted, are a trie: equal prefixes are neighbours. Level by level the
best score of each prefix is computed once from those of its ancestors up to the longest piece's length above, and
the number of pieces on its best path is carried along; where a pre-token ends, that number is its count. Where the trie
is narrow, as below long pre-tokens, the rest is walked depth first instead: the scores on the path stay up to where the
next pre-token leaves it, so each prefix is computed once there too.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import documents, in_small_batches, mix, tidy_stream

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x5851F42D4C957F2D)
SPACE = "▁"  # stands for the space in front of a word
#: Scores are whole numbers of this fraction of a nat, so sums are exact in any order and ties are real ties.
UNIT = 1 << 20
#: From so few live pre-tokens on, the trie is walked depth first, as whole levels cost more than single steps.
NARROW = 8
SLICE_CHARS = 1 << 20
CACHE_ENTRIES = 300_000


class Unigram:
    """scores: piece to whole-number score. A character that is no piece is spelled in its UTF-8 bytes, each a
    token of score fallback. Of equally good paths the one with fewest pieces counts."""

    def __init__(self, scores: dict[str, int], fallback: int):
        self.scores, self.fallback = scores, fallback
        self.longest = max(map(len, scores), default=1)
        self.cache: dict[str, int] = {}
        h = np.array([self._hash(p) for p in scores], np.uint64)
        order = np.argsort(h)
        self.hashes, self.values = h[order], np.array(list(scores.values()), np.int64)[order]
        # an index on the top 16 bits shortens each search to a few steps
        self.bits = max(1, len(h).bit_length() + 1)
        self.table = np.full(1 << self.bits, -1, np.int64)
        slot = (mix(self.hashes) >> np.uint64(64 - self.bits)).astype(np.int64)
        for i, s in enumerate(slot.tolist()):
            while self.table[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.table[s] = i

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece of each hash, or -1."""
        slot = (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(todo):
            i = self.table[slot[todo]]
            hit = (i >= 0) & (self.hashes[i] == h[todo])
            out[todo[hit]] = i[hit]
            todo = todo[(i >= 0) & ~hit]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _walk(self, tokens: list[str], depth: int, above: list[tuple[int, int]]) -> list[int]:
        """The counts of sorted pre-tokens below one prefix of a depth, depth first; above: (score, less the pieces) of
        the last prefixes up to that one."""
        score, less = array("q", [s for s, _ in above]), array("q", [k for _, k in above])
        base = len(above) - 1 - depth  # the prefix of length d is at d + base
        out, before = [], ""
        for token in tokens:
            kept = max(depth, len(commonprefix((before, token))))
            del score[kept + base + 1 :], less[kept + base + 1 :]
            for d in range(kept + 1, len(token) + 1):
                top = None
                for n in range(1, min(d, self.longest) + 1):
                    s, at = self.scores.get(token[d - n : d]), d - n + base
                    if s is not None:
                        got = (score[at] + s, less[at] - 1)
                    elif n == 1:
                        k = len(token[d - 1].encode())
                        got = (score[at] + k * self.fallback, less[at] - k)
                    else:
                        continue
                    top = got if top is None or got > top else top
                score.append(top[0])
                less.append(top[1])
            out.append(-less[-1])
            before = token
        return out

    def plain(self, token: str) -> int:
        """The count by the recurrence over one pre-token, without a trie."""
        return self._walk([token], 0, [(0, 0)])[0]

    def count_distinct(self, tokens: list[str]) -> np.ndarray:
        """Counts of distinct pre-tokens, which must be sorted."""
        size = np.array([len(t) for t in tokens], np.int64)
        chars = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.uint64)
        offset = np.cumsum(size) - size
        out = np.zeros(len(tokens), np.int64)
        rows, node = np.arange(len(tokens)), np.zeros(len(tokens), np.int64)
        # of the last levels: hashes, best scores, counts of each prefix, and its parent in the level above
        levels = [(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
        power = [np.uint64(1)]
        for _ in range(self.longest):
            power.append(np.uint64(int(power[-1]) * int(_BASE) & 0xFFFFFFFFFFFFFFFF))
        for d in range(1, int(size.max(initial=0)) + 1):
            live = size[rows] >= d
            rows, node = rows[live], node[live]
            if len(rows) <= NARROW:
                for at in dict.fromkeys(node.tolist()):
                    own, above = rows[node == at].tolist(), []
                    for _, best, count, parent in reversed(levels[-self.longest :]):
                        above.append((int(best[at]), -int(count[at])))
                        at = int(parent[at])
                    out[own] = self._walk([tokens[r] for r in own], d - 1, above[::-1])
                break
            c = chars[offset[rows] + d - 1]
            new = np.ones(len(rows), bool)
            new[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(new)
            parent, c = node[at], c[at]
            node = np.cumsum(new) - 1
            up = levels[-1]
            h = up[0][parent] * _BASE + c + np.uint64(1)
            # one character: a piece, or its bytes
            i = self._find(c + np.uint64(1))
            width = 1 + (c > 0x7F) + (c > 0x7FF).astype(np.int64) + (c > 0xFFFF)
            k = np.where(i >= 0, 1, width)
            best = up[1][parent] + np.where(i >= 0, self.values[i], k * self.fallback)
            count = up[2][parent] + k
            above = parent
            for n in range(2, min(d, self.longest) + 1):
                above = levels[-n + 1][3][above]
                old = levels[-n]
                i = self._find(h - old[0][above] * power[n])
                got = np.flatnonzero(i >= 0)
                if len(got):
                    a = above[got]
                    s, k = old[1][a] + self.values[i[got]], old[2][a] + 1
                    better = (s > best[got]) | ((s == best[got]) & (k < count[got]))
                    best[got[better]], count[got[better]] = s[better], k[better]
            levels.append((h, best, count, parent))
            del levels[: -self.longest - 1]
            ends = size[rows] == d
            out[rows[ends]] = count[node[ends]]
        return out

    def learn(self, tokens: set[str]) -> None:
        new = sorted(tokens)
        self.cache.update(zip(new, self.count_distinct(new).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        cut = [[SPACE + w for w in _WORD.findall(t)] for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        self.learn({w for x in cut for w in x}.difference(self.cache))
        get = self.cache.__getitem__
        return [(len(x), sum(map(get, x))) for x in cut]


@lru_cache(2)
def unigram(path: str) -> Unigram:
    """A unigram model from a sentencepiece file's list of pieces. The file ranks its pieces and holds no
    probabilities, so a piece of rank r weighs 1 / (r + 1), as word frequencies fall; nothing is trained."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    score = lambda r: round((-math.log(r + 1) - total) * UNIT)
    return Unigram({p: score(r) for r, p in enumerate(pieces)}, score(len(pieces)) - 2 * UNIT)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row's whole text.

    A pre-token is a run of characters other than space and 9 to 13, with a space mark in front. Null and empty
    texts count nothing. Repeated rows give repeated results. Other columns are left behind. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = unigram(path)
        for batch in batches:
            texts, got, part, size = batch.column(1), [], [], 0
            for t in texts:
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size >= SLICE_CHARS:
                    got += u.count(part)
                    part, size = [], 0
            got += u.count(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in (0, 1))], ["doc_id", "n_pretokens", "n_tokens"])

    return in_small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy_stream(run), "doc_id long, n_pretokens long, n_tokens long")


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts of every document: nulls, empty and very long texts as in the operator."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
