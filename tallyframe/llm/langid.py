"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

One recurrent layer reads a text's UTF-8 bytes forward, one backward; their states label every byte position with
probabilities of the languages. A document's probabilities are the mean over all its positions. Texts are read in
windows side by side; each layer enters a window WARM bytes early, so that its state runs on from window to window but
for what it would remember of bytes further back. At a text's ends it starts at zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import documents, in_small_batches, slices, tidy_stream

WINDOW = 256
WARM = 32
HIDDEN = 8
#: The network is fitted on at most so many documents of each language: all windows of their whole texts, of TAUGHT bytes.
SAMPLE_DOCS = 480
TAUGHT = 64
STEPS = 160
BATCH = 160
#: The label of texts that are null or have no letter.
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes labelled at once: small enough for the caches, and for products that stay in one thread.
SLICE_BYTES = 1 << 18


def _softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: a squashing function several times cheaper than tanh. Its slope is (1 - |y|) ** 2."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


class Network:
    """Weights of both directions: w maps a byte to the inputs of the three gates (3H x 257), u the state (3H x H),
    c biases the candidate's state term; v and d map the joined states to the languages. Gates stand in the order
    update, reset, candidate; they squash with softsign, the first two moved to 0..1. Byte 256 pads and leaves the
    state at zero. Arrays hold units x batch, so that every operation runs along memory."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(hidden)).astype(np.float32)
        self.languages, self.h = languages, hidden
        self.p = {"v": init(len(languages), 2 * hidden), "d": np.zeros((len(languages), 1), np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": init(3 * hidden, 257), f"u{way}": init(3 * hidden, hidden), f"c{way}": np.zeros((hidden, 1), np.float32)}

    def _states(self, x: np.ndarray, way: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: time x batch bytes, in reading order of this direction. States after each step, and what the way back needs."""
        n, h, (w, u, c) = x.shape[1], self.h, (self.p[k + way] for k in "wuc")
        rows = np.ascontiguousarray(w.T)
        padded = (x == 256).any(1)
        state, out, trace = np.zeros((h, n), w.dtype), np.empty((len(x), h, n), w.dtype), []
        for t in range(len(x)):
            a, b = np.ascontiguousarray(rows.take(x[t], axis=0).T), u @ state
            gates = b[: 2 * h]
            gates += a[: 2 * h]
            _softsign(gates)
            gates *= 0.5
            gates += 0.5
            z, r, m, cand = gates[:h], gates[h:], b[2 * h :], a[2 * h :]
            m += c
            cand += r * m
            _softsign(cand)
            new = out[t]
            np.subtract(state, cand, out=new)
            new *= z
            new += cand
            if padded[t]:
                new *= x[t] < 256
            if keep:
                trace.append((state, z, r, m, cand))
            state = new
        return out, trace

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Probabilities of the languages at each position (time x languages x batch)."""
        f, tf = self._states(x, "f", keep)
        b, tb = self._states(x[::-1], "b", keep)
        b = b[::-1]
        logits = self.p["v"][:, : self.h] @ f
        logits += self.p["v"][:, self.h :] @ b
        logits += self.p["d"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits, (f, b, tf, tb)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the masked positions, and its gradient by backpropagation through time."""
        p, (f, b, tf, tb) = self.forward(x, keep=True)
        n = max(1.0, float(mask.sum()))
        hot = np.eye(p.shape[1], dtype=p.dtype)[:, y]
        loss = float(-(np.log(np.maximum(p[:, y, np.arange(len(y))], 1e-12)) * mask).sum() / n)
        e = (p - hot) * (mask / n)[:, None, :]
        # einsum and sums by sorted byte here: products this large would start a thread for each core
        g = {"d": e.sum((0, 2))[:, None], "v": np.concatenate([np.einsum("tlb,thb->lh", e, s) for s in (f, b)], 1)}
        for way, trace, xs, es, v in (("f", tf, x, e, self.p["v"][:, : self.h]), ("b", tb, x[::-1], e[::-1], self.p["v"][:, self.h :])):
            u, dh = self.p[f"u{way}"], np.zeros_like(trace[0][0])
            gu, gc, ups = np.zeros_like(u), np.zeros_like(self.p[f"c{way}"]), []
            for t in range(len(xs) - 1, -1, -1):
                state, z, r, m, cand = trace[t]
                dh = (dh + v.T @ es[t]) * (xs[t] < 256)
                da = dh * (1 - z) * (1 - np.abs(cand)) ** 2
                slope = lambda q: 0.5 * (1 - np.abs(2 * q - 1)) ** 2
                dz = dh * (state - cand) * slope(z)
                dr = da * m * slope(r)
                down = np.concatenate([dz, dr, da * r])
                ups.append(np.concatenate([dz, dr, da]))
                gu += down @ state.T
                gc += down[2 * self.h :].sum(1, keepdims=True)
                dh = dh * z + u.T @ down
            read = xs[::-1].ravel()
            order = np.argsort(read, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(read[order]) != 0))
            gw = np.zeros_like(self.p[f"w{way}"])
            gw[:, read[order[first]]] = np.add.reduceat(np.concatenate(ups, 1)[:, order], first, axis=1)
            g |= {f"u{way}": gu, f"c{way}": gc, f"w{way}": gw}
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over random batches of windows, as many of each language. x: windows x time. Returns the losses."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(q) for k, q in self.p.items()}
        second = {k: np.zeros_like(q) for k, q in self.p.items()}
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        losses = []
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by if len(b)])
            xs = x[at].T
            loss, g = self.gradients(xs, y[at], (xs < 256).astype(np.float32))
            losses.append(loss)
            # the gradient's norm is held to 1, the rate falls over the second half
            clip = min(1.0, 1.0 / max(1e-9, float(np.sqrt(sum((q * q).sum() for q in g.values())))))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, q in g.items():
                q = q * clip
                first[k] += 0.1 * (q - first[k])
                second[k] += 0.01 * (q * q - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return losses

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Each text's mean position probabilities (texts x languages); zeros for an empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        for lo, hi in slices([len(t) for t in texts], SLICE_BYTES):
            x, owner = windows(texts[lo:hi], WINDOW, WARM)
            for a in range(0, len(x), SLICE_BYTES // WINDOW):  # a longer text in parts
                part = x[a : a + SLICE_BYTES // WINDOW].T
                p = self.forward(np.ascontiguousarray(part))[0][WARM : WARM + WINDOW]
                p *= (part[WARM : WARM + WINDOW] < 256)[:, None, :]
                np.add.at(out[lo:hi], owner[a : a + part.shape[1]], p.sum(0).T)
        return out / np.maximum(1, [len(t) for t in texts])[:, None]


def windows(texts: list[bytes], size: int, around: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into windows, with so many bytes around each (256 beyond the text), and the text of each."""
    n = np.array([-(-len(t) // size) for t in texts], np.int64)
    flat = np.full(int(n.sum()) * size + 2 * around * len(texts), 256, np.int16)
    start = (np.cumsum(n) - n) * size + 2 * around * np.arange(len(texts))
    for t, s in zip(texts, start.tolist(), strict=True):
        flat[s + around : s + around + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), n)
    at = start[owner] + (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]) * size
    return flat[at[:, None] + np.arange(size + 2 * around)] if len(at) else np.zeros((0, size + 2 * around), np.int16), owner


def held_out() -> F.Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 4 teach nothing; null ids neither."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> Network | None:
    """Fits a network on a bounded sample of the labelled documents that are not held out: for each language at most
    sample_docs different documents (id and text), those of least hash, with their whole texts. The languages are the
    classes; they and their counts come to the driver. None if nothing is labelled."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (sample_docs + 4 * sample_docs**0.5) / n))).otherwise(share)
    # the limit on the hash lets about so many through that the least sample_docs are among them; 2**52 steps are fine
    # enough for any number of documents
    u = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 52))
    chosen = taught.withColumn("u", u).where(F.col("u") < share * float(1 << 52)).select("lang", "u", F.col("doc_id").cast("long").alias("doc_id"), "text").distinct()
    least: dict[str, list] = {}
    for r in sorted((r["lang"], r["u"], r["doc_id"], r["text"].encode()) for r in chosen.collect()):
        least.setdefault(r[0], []).append(r)
    got = [(lang, doc_id, text) for own in least.values() for lang, _, doc_id, text in own[:sample_docs]]
    languages = sorted(counts)
    x, owner = windows([t for _, _, t in got], TAUGHT)
    y = np.array([languages.index(lang) for lang, _, _ in got], np.int64)[owner]
    network = Network(languages)
    network.fit(x, y, steps)
    return network


def predict(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, lang_pred, score for every row, by the whole text alone. Text that is null or without a
    letter (and every text, where nothing was learned) is "und" with score 0. Narrow: no shuffle."""
    sent = docs.select(F.col("text").alias("_text"), *[F.col(c).cast("long") if c == "doc_id" else c for c in keep if c != "text"])
    names = ["text" if c == "_text" else c for c in sent.columns if c != "_text" or "text" in keep]
    kinds = {c: t for c, t in sent.dtypes} | {"text": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            lettered = [network is not None and _LETTER.search(t) is not None for t in texts]
            labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            at = sorted((i for i, on in enumerate(lettered) if on), key=lambda i: len(texts[i]))
            if network is not None and at:
                p = network.pooled([texts[i].encode() for i in at])
                for i, k, s in zip(at, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    labels[i], scores[i] = network.languages[k], min(1.0, s)
            kept = [batch.column("_text" if c == "text" else c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return in_small_batches(sent).mapInArrow(tidy_stream(run), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row: the network is trained on docs, then labels all of them.

    Equal texts get equal labels; of equally likely languages the first in alphabetical order. An empty table
    gives an empty one; extra columns are left behind.
    """
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, lang_pred and score of every document: texts without letters, nulls and repeats as in identify."""
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
