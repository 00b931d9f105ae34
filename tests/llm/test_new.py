"""Fill-in-middle, nearest neighbours and periodic runs against plain versions, and their edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tallyframe.llm import ann, fim, periodic

CLASH = "doc_id long, text string, n string, form string, prefix string, runs string, collapsed string, _units string, _pieces string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], CLASH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle
PLAIN_UNITS = {"code_point": list, "line": lambda t: regex.findall(r"[^\n]*\n|[^\n]+", t), "word": lambda t: regex.findall(r"[\p{L}\p{M}\p{N}_]+|\s+|[\s\S]", t)}


@pytest.mark.parametrize("name", fim.UNITS)
@pytest.mark.parametrize("block", [7, fim.BLOCK])
def test_units_equal_plain_grammar(spark, monkeypatch, name, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("aB9 \n\ré𝒜🙂日.") for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    df = fim.with_units(spark.createDataFrame(rows, "doc_id long, text string"), "text", fim.UNITS[name])
    n = F.col("_units")
    for r in fim.cut_in_three(df, "text", F.floor(n / 3), F.ceil(n * 0.7), fim.UNITS[name]).collect():
        u = PLAIN_UNITS[name](r.text)
        a, b = len(u) // 3, math.ceil(len(u) * 0.7)
        assert (r._units, r.prefix, r.middle, r.suffix) == (len(u), "".join(u[:a]), "".join(u[a:b]), "".join(u[b:]))


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, a, b - a, sha(out), sha(text)


@pytest.mark.parametrize("block", [5, fim.BLOCK])
def test_fim_query_equals_plain_version(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    texts = [None, "", "a", "<P>", "x<M>y", "<<S", "P>x", "tie\r\n\n  𝒜🙂é日 <", "ab" * 300]
    rows = [(i, texts[i % len(texts)]) for i in range(200)] + [(7, "again"), (7, "again"), (None, "no id"), (-3, "below zero")]
    clashing(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in fim.op11_fim(spark, str(tmp_path)).select(F.coalesce("doc_id", F.lit(-99)), "n", "form", F.coalesce("prefix_chars", F.lit(-1)), F.coalesce("middle_chars", F.lit(-1)), "output_sha256", "restored_sha256").collect())
    none = lambda x: -1 if x is None else x
    want = sorted((-99 if i is None else i, n, f, none(p), none(m), o, r) for i, t in rows for n, f, p, m, o, r in [plain_fim(i, t)])
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_other_units_long_text_and_empty_table(spark):
    long = "one two  three\n" * 30_000  # several blocks
    rows = clashing(spark, [(i, long) for i in range(8)])
    made = fim.fill_in_middle(rows, units=fim.UNITS["word"])
    for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        assert r.back == long and r.n == len(PLAIN_UNITS["word"](long))
        assert r.form == "plain" or r.prefix + r.middle + r.suffix == long
    assert fim.fill_in_middle(rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="outside"):
        fim.cut_in_three(fim.with_units(rows, "text"), "text", F.lit(3), F.lit(2)).collect()


# periodic runs
def plain_runs(w, least):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(2 * p, least):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_kept(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_every_period_tried(least):
    rnd = random.Random(least)
    for _ in range(250):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            n = rnd.choice([0, 1, 5, 30, 100, 300])
            w = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(" \t".join(w))
        runs, left = periodic.runs_of_texts([t.encode() for t in texts], least)
        for t, got, kept in zip(texts, runs, left, strict=True):
            want = plain_runs(t.split(), least)
            assert [tuple(r) for r in got.tolist()] == want and kept == plain_kept(t.split(), want)


def test_runs_of_fibonacci_words_and_one_letter():
    a, b = ["x"], ["x", "y"]
    while len(b) < 1500:
        a, b = b, b + a
    for w in (b, ["x"] * 3000, ["x", "y", "x"] * 700 + ["z"] + ["x", "y", "x"] * 50):
        runs, _ = periodic.runs_of_texts([" ".join(w).encode()])
        assert [tuple(r) for r in runs[0].tolist()] == plain_runs(w, 12)


def plain_query_row(doc_id, text):
    w = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 12)
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    return len(runs), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(plain_kept(w, runs))


def test_runs_query_equals_plain_version(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([" ", "\n", "\t "]).join(rnd.choice(["a", "b", "é", "日 本"]) for _ in range(rnd.randint(0, 150)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "  \n "), (None, "z " * 40), (5, "again " * 12), (5, "again " * 12), (403, "x y " * 20_000)]
    clashing(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in periodic.op13_runs(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = {}
    for i, t in rows:
        if i == 403:
            w = ["x", "y"] * 20_000
            want[i] = [(1, 0, 40_000, 2, 20_000_000, sha("0,40000,2\n"), sha("x y"))] if zlib.crc32(b"403") % 10 else got[i]
        else:
            want.setdefault(i, []).append(plain_query_row(i, t))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_runs_of_an_empty_table(spark):
    assert periodic.periodic_runs(clashing(spark, [(1, "a")]).limit(0)).count() == 0


# nearest neighbours
def plain_nearest(rows, is_query, k):
    width = max((len(v) for _, v in rows), default=0)
    at = [(i, np.pad(np.array(v, float), (0, width - len(v)))) for i, v in rows]
    out = {}
    for q, v in at:
        if is_query(q):
            best = out.setdefault(q, {})
            for c, w in at:
                if c != q:
                    score = float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w)))
                    best[c] = max(best.get(c, -2), score)
    return {q: sorted(((c, round(s, 12)) for c, s in best.items()), key=lambda x: (-x[1], x[0]))[:k] for q, best in out.items()}


def nearest_of(df, is_query, k=5, **more):
    got = {}
    for r in ann.nearest(df, is_query, k, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_nearest_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BIN_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(5)
    near = rng.standard_normal((40, 48))
    rows = [(i, [float(x) for x in (near[i % 40] + 0.7 * rng.standard_normal(48) if i % 2 else rng.standard_normal(48))]) for i in range(3000)]
    rows += [(3000 + i, rows[100][1]) for i in range(900)]  # a hot vector, longer than a bin
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = nearest_of(df, F.col("vec_id") % 50 == 0), plain_nearest(rows, lambda q: q % 50 == 0, 5)
    assert set(got) == set(want)
    hits = sum(s >= want[q][-1][1] - 1e-9 for q in want for _, s in got[q])
    assert hits / sum(map(len, want.values())) >= 0.9
    every = {i: v for i, v in rows}
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for c, s in found:
            a, b = np.array(every[q]), np.array(every[c])
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-11)
    copies = [i for i, v in rows if v == rows[100][1]]
    for q in (c for c in copies if c % 50 == 0):
        assert [c for c, _ in got[q]] == [c for c in copies if c != q][:5]


def test_nearest_edges(spark):
    kind = "vec_id long, embedding array<float>, score string, list int, bin string, `limit` string"
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 1.0]), (7, [1.0, 1.0, 0.0]), (3, [2.0, 2.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0])]
    bad = [(100, None), (150, []), (1, [0.0, 0.0]), (2, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "a", 1, "b", "c") for i, v in good + bad], kind)
    assert nearest_of(df, F.col("vec_id") % 50 == 0, 3) == plain_nearest(good, lambda q: q % 50 == 0, 3)
    assert nearest_of(df, F.col("vec_id") == 0, 50) == plain_nearest(good, lambda q: q == 0, 50)
    assert nearest_of(df.limit(0), F.col("vec_id") == 0) == {} and nearest_of(df, F.col("vec_id") == 77) == {}


def test_share_bound_is_a_quantile():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((200_000, 24))
    share = (v[:, :8] ** 2).sum(1) / (v**2).sum(1)
    assert (share > ann.share_bound(8, 24, 0.01)).mean() == pytest.approx(0.01, abs=0.002)
    r = ann.rotation(24)
    assert np.allclose(r @ r.T, np.eye(24))
