"""Top-k, mixing, sharding, suffix dedup, Jaccard components, HTML, the pipeline: against brute force."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import htmltext, jaccard, mixing, sharding, suffixdedup, topk


def brute_topk(rows, k):
    out = {}
    ok = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q, v in ok.items():
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok.items() if i != q))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("n", [1, 4, 400])
def test_topk(spark, monkeypatch, n):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rnd = random.Random(n)
    rows = [(i * 10, [rnd.choice([0.0, 0.5, -0.25, 1.5, rnd.random()]) for _ in range(6)]) for i in range(n)]
    if n > 4:
        rows[5] = (50, None)
        rows[10] = (100, [1.0, None, 0.0, 0.0, 0.0, 0.0])
        rows[15] = (150, [float("nan")] * 6)
        rows[20] = (200, [float("inf")] + [0.0] * 5)
        rows += [(7, rows[1][1]), (8, rows[1][1]), (9, rows[1][1])]  # ties
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    ready = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantized(F.col("embedding")).alias("vector"))
    got = {}
    for r in topk.top_k(ready, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = {q: {k + 1: x for k, x in enumerate(v)} for q, v in brute_topk(rows, 5).items() if v}
    assert got == want


def test_topk_empty_and_repeated(spark):
    df = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1, 2]), (0, [1, 2]), (1, [5, 5]), (1, [5, 5]), (2, [3])], "vec_id long, vector array<long>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(twice, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 15), (2, 2, 3)]


def test_topk_large_scores(spark):
    big = 3_000_000_000
    rows = [(0, [big, big]), (1, [big, 1 - big]), (2, [big, -big]), (3, [1, 1])] + [(4, [5, i]) for i in range(-20, 20)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(4, 24 * big), (3, 2 * big), (1, big), (2, 0)]
    too_big = spark.createDataFrame([(0, [big * 4]), (1, [big * 4])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(too_big, F.col("vec_id") == 0).collect()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixing_rates_and_counts(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else f"s{i % 30}", 1) for i in range(3000)] + [(9999, None, None, None, None)]
    df = docs(spark, rows)
    n = Counter(r[3] for r in rows)
    out = mixing.mix_sources(df.withColumn("mix_count", F.lit("clash"))).collect()
    want, total = {}, len(rows)
    for i, _, _, s, _ in rows:
        rate = total * (1 / len(n)) / n[s]
        parts = max(1, math.ceil(rate / mixing.PART_RATE))
        count = 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"17:{i}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            c, p, k = 0.0, math.exp(-rate / parts), 0
            while True:
                c += p
                if u < c or k > rate + 200:
                    break
                k += 1
                p *= rate / parts / k
            count += k
        if count:
            want[i] = count
    got = Counter(r.doc_id for r in out)
    assert dict(got) == want and all(r.mix_count == want[r.doc_id] for r in out)
    assert sorted(r.mix_copy for r in out if r.doc_id == next(iter(want))) == list(range(1, next(iter(want.values())) + 1))
    share = Counter(r.source for r in out)
    assert abs(share["big"] / (total / len(n)) - 1) < 0.15


def test_mixing_weights_empty_and_joined(spark, monkeypatch):
    df = docs(spark, [(i, "x", "en", "ab"[i % 2], 1) for i in range(200)])
    out = mixing.mix_sources(df, {"a": 3.0}, target_rows=300)
    assert {r.source for r in out.collect()} == {"a"} and 220 < out.count() < 380
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(r.doc_id for r in mixing.mix_sources(df).collect()) == sorted(r.doc_id for r in mixing.mix_sources(df).collect())
    assert mixing.mix_sources(df.where("false")).count() == 0
    assert mixing.mix_sources(df, {"nowhere": 1.0}).count() == 0


def test_mixing_equal_ids_and_no_target(spark):
    df = docs(spark, [(1, "x", "en", "a", 1), (1, "y", "en", "b", 1), (1, "y", "en", "b", 1)])
    out = mixing.mix_sources(df, target_rows=3000).collect()
    n = Counter(r.text for r in out)
    assert 1200 < n["x"] < 1800 and 1200 < n["y"] < 1800 and len({r.mix_count for r in out if r.source == "b"}) == 1
    assert mixing.mix_sources(df, target_rows=0).count() == 0


def test_mixing_runs_no_python(spark):
    plan = mixing.mix_sources(docs(spark, [(1, "x", "en", "a", 1)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([random.Random(i).getrandbits(64) for i in range(500)], np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    grown = sharding.jump_hash(keys, 9)
    assert all(g in (8, o) for g, o in zip(grown, sharding.jump_hash(keys, 8), strict=True))


def test_sharding(spark):
    rows = [(i, random.choice(["same", None, f"té{i}", ""]), "en", "a", 1) for i in range(700)] + [(5, "twice", "en", "a", 1), (5, "twice", "en", "a", 1), (None, "n", "en", "a", 1)]
    df = docs(spark, rows).withColumn("shard", F.lit("clash"))
    out = sharding.shard_documents(df, chunks=16).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"key"}
    text = Counter((i, t) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter({k: v for k, v in Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in text.elements()).items()})
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    of = {}
    for r in out:
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) and r.grown_shard in (r.shard, 8)
    alone = sharding.shard_documents(df.where("doc_id = 77"), chunks=16).first()
    assert (alone.shard, alone.grown_shard) == of[77]  # other rows have no say
    assert sharding.shard_documents(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_column(F.lit(1), 0)


def brute_substrings(rows):
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        b = (rows[i][1] or "").encode()
        for s in range(len(b) - 99):
            seen.setdefault(b[s : s + 100], (i, s))
    for i in order:
        b = (rows[i][1] or "").encode()
        g = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] != (i, s):
                g[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, y in zip(b, g) if not y)
        out[rows[i][0]] = (len(b), sum(g), sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def substring_rows(seed=1, n=90):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared, rows = [text(30) for _ in range(6)], []
    for i in range(n):
        k = rnd.random()
        if k < 0.1:
            t = None
        elif k < 0.2:
            t = rnd.choice(["x", "ab"]) * rnd.randint(45, 300)
        elif k < 0.5:
            t = text(rnd.randint(0, 60)) + rnd.choice(shared) + text(rnd.randint(0, 60))
        elif k < 0.8 and rows:
            t = rows[rnd.randrange(len(rows))][1] or ""
            c = rnd.randrange(len(t) + 1)
            t = t[:c] + rnd.choice(["", "Z", text(3)]) + t[c + rnd.randint(0, 5) :]
        else:
            t = text(rnd.randint(0, 200))
        rows.append((1000 - i * 3, t))
    return rows


@pytest.mark.parametrize("rows", [substring_rows(), [(1, "")], [(5, "q" * 100), (2, "q" * 100), (3, None), (9, "q" * 99)]])
def test_suffix_dedup(spark, monkeypatch, rows):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 2000)
    df = spark.createDataFrame([(*r, "s", "c") for r in rows], "doc_id long, text string, source string, n_bytes string").repartition(3)
    want = brute_substrings(rows)
    out = suffixdedup.dedup_substrings(df, with_text=True, keep=("source",)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert r.source == "s" and (r.n_removed or r.kept_text == dict(rows)[r.doc_id] or not dict(rows)[r.doc_id])


def test_suffix_pieces_that_only_hash_alike_are_told_apart():
    rnd = random.Random(8)
    unit = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    texts = [(unit + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 90))) + unit[: rnd.randint(150, 400)]).encode() for _ in range(12)]
    p = suffixdedup.Pieces(texts)
    p.hash[:], p.content[:] = 7, 9  # all hashes collide
    seen, want = [], []
    for a, b in zip(p.start.tolist(), p.end.tolist()):
        piece = p.buf[a:b].tobytes()
        want.append(not seen or piece != seen[0])  # the one that the hash finds is the first of all
        seen.append(piece)
    assert p.firsts().tolist() == want and not all(want)


def test_suffix_dedup_empty_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "w" * 150), (1, "w" * 150), (None, "v")], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffixdedup.dedup_substrings(df).collect()) == [0, 149, 150]  # in a run of one letter all but its first byte repeat
    assert suffixdedup.dedup_substrings(df.where("false")).count() == 0


def test_windows_of_one_collection():
    rnd = random.Random(3)
    anchor, pieces = b"A" * 16 + b"B" * 16, []
    lefts = [bytes(rnd.choice(b"xy") for _ in range(68)) for _ in range(4)]
    rights = [bytes(rnd.choice(b"xy") for _ in range(68)) for _ in range(4)]
    for _ in range(60):
        a, b = rnd.choice(lefts)[rnd.randint(0, 67) :], rnd.choice(rights)[: rnd.randint(0, 68)]
        if len(a) + 32 + len(b) >= 100:
            pieces.append((len(a), a + anchor + b))
    pieces = list(dict.fromkeys(pieces))
    rank = np.array(rnd.sample(range(len(pieces)), len(pieces)))
    got = suffixdedup.repeated_windows(np.zeros(len(pieces), np.uint64), rank, np.array([p[0] for p in pieces]), np.array([len(p[1]) for p in pieces]), np.frombuffer(b"".join(p[1] for p in pieces), np.uint8))
    first = {}
    for i in np.argsort(rank):
        for s in range(len(pieces[i][1]) - 99):
            c = 68 - pieces[i][0] + s
            key = pieces[i][1][s : s + 100]
            assert got[i, c] == (key in first)
            first.setdefault(key, i)


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed=4, n=220):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    rows = []
    for i in range(n):
        k = rnd.random()
        if k < 0.03:
            t = None
        elif k < 0.07:
            t = " ".join(rnd.choice(vocabulary[:4]) for _ in range(rnd.randint(0, 3)))
        elif k < 0.35 or not rows:
            t = " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 100, 400])))
        else:
            x = (rows[rnd.randrange(len(rows))][1] or "a").split()
            for _ in range(rnd.randint(0, max(1, len(x) // 25))):
                c = rnd.randrange(len(x) + 1)
                x[c : c + rnd.randint(0, 1)] = [rnd.choice(vocabulary).upper()] * rnd.randint(0, 1)
            t = "  ".join(x)
        rows.append((i * 7 % 1009, t))
    return rows


@pytest.mark.parametrize("words,percent,second,differing", [(3, 90, None, None), (5, 80, None, None), (3, 90, 3, 1), (3, 50, None, None)])
def test_jaccard_components(spark, words, percent, second, differing):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    want = brute_components(rows, words, percent)
    out = jaccard.jaccard_components(df, words, percent, second, differing).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and len(out) == len(rows)
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("percent", [30, 50, 60, 71])
def test_jaccard_low_similarity_meets_in_every_band_between(percent):
    scheme = jaccard.PartEnum(percent)
    rng = np.random.default_rng(percent)
    for n in range(1, 60):
        pool = rng.integers(0, 1 << 63, scheme.largest(n), dtype=np.uint64)
        for more in range(n, len(pool) + 1):
            assert len(np.intersect1d(scheme.signatures(pool[:n]), scheme.signatures(pool[:more]))), (n, more)


def test_jaccard_shuffled_filters_empty_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = [(3, "a b c d"), (3, "a b c d"), (9, "A b  c d"), (4, None), (5, ""), (6, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()) == [(3, 2, 3), (3, 2, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (9, 2, 3)]
    assert jaccard.jaccard_components(df.where("false")).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for scheme in (jaccard.PartEnum(90), jaccard.PartEnum(80), jaccard.PartEnum(90, 4, 1), jaccard.PartEnum(90, 3, 2)):
        for n in (1, 2, 5, 9, 10, 19, 40, 133, 400, 1500):
            for _ in range(5):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                both = -(-scheme.percent * n // 100)  # the fewest common elements of a subset that is still similar
                b = a[:both]
                extra = rng.integers(0, 2**63, 100 * n // scheme.percent - n).astype(np.uint64)
                for other in (b, np.concatenate([a, extra])):
                    assert np.intersect1d(scheme.signatures(np.unique(a)), scheme.signatures(np.unique(other))).size


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(2)
    for n in (3, 50, 700, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets = [a, a[: -(-90 * len(a) // 100)]]
        sk = jaccard.Sketches(np.array([len(s) for s in sets]), [jaccard._sketch(s) for s in sets])
        assert sk.possible(np.array([0, 1]), np.array([1, 0]), 90).all()


@pytest.mark.parametrize("percent", [80, 90])
def test_unrelated_sets_hardly_share_a_signature(percent):
    scheme, rng = jaccard.PartEnum(percent), np.random.default_rng(3)
    n2, k2 = scheme.layout(scheme.band(1000))[1:]
    assert n2 > k2 > 0  # subsets are enumerated
    sets = [rng.integers(0, 2**63, 1000).astype(np.uint64) for _ in range(300)]
    sigs, at, native = scheme.sign(sets)
    groups = {}
    for s, i, here in zip(sigs.tolist(), at.tolist(), native.tolist()):
        groups.setdefault(s, []).append((i, here))
    pairs = {(min(i, j), max(i, j)) for g in groups.values() for i, x in g for j, y in g if i != j and (x or y)}
    assert len(pairs) < 0.001 * 300 * 299 / 2 and max(map(len, groups.values())) < 10


def test_patterned_words_do_not_agree(spark):
    word = lambda a, b: "".join(a if bin(i).count("1") % 2 else b for i in range(1024))
    rows = [(1, " ".join([word("a", "b")] * 4)), (2, " ".join([word("b", "a")] * 4))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in got) == [1, 2]


def test_jaccard_nulls_and_shared_ids(spark, monkeypatch):
    """A doc_id of two texts links the classes of both; a null doc_id takes part through equal sets alone."""
    monkeypatch.setattr(jaccard, "CHUNK", 2)
    rows = [(5, "a b c d e"), (5, "p q r s t"), (1, "a b c d e"), (7, "p q r s t"), (None, "p q r s t"), (None, "only here"), (8, "x y z")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 1), (1, 1), (5, 1), (5, 1), (7, 1), (8, 8)]


@pytest.fixture(scope="module")
def trees():
    return htmltext.model()


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header class=top><a href=/>Site</a></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div id="cookie-notice">We use cookies here. <button>OK</button></div><article><h1>The  title &amp; more</h1><p>First <b>paragraph</b> with&nbsp;some
text, and a <a href=x>link</a>.<p>Second paragraph &lt;unclosed&gt;, long enough to be text.<br>After a break.</p><div class="ad">Buy now!</div><ul><li>point one of the article<li>point two of it</ul></article>
<aside class=sidebar><h3>Related</h3><p>Read other things too.</p></aside><form><label>Mail</label><input></form><section class="comments"><div class=comment><p>Great post, thanks!</p></div></section><footer>&copy; 2020 all rights</footer></body></html>"""


def test_html_page(trees):
    assert htmltext.extract([PAGE], trees) == ["The title & more\nFirst paragraph with some text, and a link.\nSecond paragraph <unclosed>, long enough to be text. After a break.\npoint one of the article\npoint two of it"]


PROSE = "A paragraph of plain prose, which says a few things and ends here."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<p>{PROSE}</p>" * 5, [PROSE] * 5),
        (f"<html><body>{f'<p>{PROSE}' * 3}</body></html>", [PROSE] * 3),
        (PROSE, [PROSE]),
        (f"<article><p>{PROSE}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given, and so on it goes.</p></article>", [PROSE, "Let x=2 be given, and so on it goes."]),
        (f"<article><p>{PROSE}</p><object data=z><p>{PROSE} Fallback.</p></object><p>{PROSE}</p></article>", [PROSE, PROSE + " Fallback.", PROSE]),
        (f"<article><p>{PROSE}</p><div hidden>{PROSE}</div><div style='display: none'><p>{PROSE}</p></div><p>{PROSE}</p></article>", [PROSE] * 2),
        (f"<article><p>{PROSE}</p><noscript>Please enable scripts here.</noscript><select><option>one<option>two</select><p>{PROSE}</p></article>", [PROSE] * 2),
        (f"{'<div>' * 3000}<p>{PROSE}</p><p>{PROSE}</p>{'</div>' * 3000}", [PROSE] * 2),
    ],
)
def test_html_cases(trees, page, want):
    assert htmltext.extract([page], trees) == ["\n".join(want)]


PARAGRAPHS = [f"This is paragraph number {i}, with words enough to be read as text by anyone." for i in range(4)]
MENU, FOOT = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>", "<footer>© 2020 example.com | all rights</footer>"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        # the article's tokens are of several kinds
        (f'<div class="widget-content post"><h1>The title of it</h1>{"".join(f"<p>{p}</p>" for p in PARAGRAPHS)}</div>', ["The title of it", *PARAGRAPHS]),
        # no article element, and divs for paragraphs
        ("<h1>The title of it</h1>" + "".join(f"<div>{p}</div>" for p in PARAGRAPHS[:2]), ["The title of it", *PARAGRAPHS[:2]]),
        # paragraphs and lists of links
        (
            f'<article><h1>Title here</h1><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p><p><a href="/x">A paragraph that is one link to something</a></p><h2>Sources</h2><ul><li><a href="/1">First source of it</a></li><li><a href="/2">Second source of it</a></li></ul></article>',
            ["Title here", *PARAGRAPHS[:2], "A paragraph that is one link to something", "Sources", "First source of it", "Second source of it"],
        ),
        # inline elements with attributes are judged; descriptions in drawings are not shown
        (f'<article><h1>Title here</h1><p>{PARAGRAPHS[0]}</p><p>Before it <span class="advert">BUY NOW</span> after it, and <span hidden>SECRET</span> the <em id="k">end</em>. <svg><desc>what it shows</desc></svg></p></article>', ["Title here", PARAGRAPHS[0], "Before it after it, and the end."]),
    ],
)
def test_html_keeps_whole_articles(trees, inner, want):
    assert htmltext.extract([f"<html><body>{MENU}{inner}{FOOT}</body></html>"], trees) == ["\n".join(want)]


def test_html_equals_the_articles_of_the_pages_table(trees):
    """Each page of the table has one article element; its blocks by plain string work."""
    import pyarrow.parquet as pq

    pages = [r["html"] for sf in ("sf0.001", "sf0.01") for r in pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist()]
    for page, got in zip(pages, htmltext.extract(pages, trees), strict=True):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        lines = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|h2|li)\b[^>]*>", "\n", inner.replace("<br>", " "))).split("\n")
        assert got == "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)


def test_html_made_up_pages(trees):
    rng = random.Random(4242)  # another seed than the training pages'
    pages = [htmltext.made_up_page(rng) for _ in range(150)]
    hit = got = true = 0
    for page, out in zip(pages, htmltext.extract(pages, trees), strict=True):
        q = sum(w.startswith("q") for w in out.split())
        hit, got = hit + q, got + len(out.split())
        true += sum(w.startswith("q") for w in re.sub(r"<[^>]*>", " ", html.unescape(page.split("<body>")[1])).split())
    assert hit / got > 0.98 and hit / true > 0.98


def test_html_decoding_is_consistent():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 9
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        margin = rng.normal(size=n) * 3
        got = htmltext.decode(margin, parent)
        score = lambda keep: sum(-np.logaddexp(0, -m) if k else -np.logaddexp(0, m) for m, k in zip(margin, keep))
        legal = [k for k in range(1 << n) if all(not k >> i & 1 or i == 0 or k >> int(parent[i]) & 1 for i in range(n))]
        best = max(score([k >> i & 1 for i in range(n)]) for k in legal)
        assert score(got) == pytest.approx(best) and all(not got[i] or got[parent[i]] for i in range(1, n))


def test_html_operator(spark, trees):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (4, "u", "<p", "x"), (5, "u", "<article>" + "<p>word word word</p>" * 4000 + "</article>", "x"), (None, "u", "</div></p><b>", "x")]
    out = htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), trees).collect()
    assert len(out) == 7 and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r for r in out}
    assert by[2].text == by[3].text == "" and by[5].text.count("\n") == 3999 and by[1].text.startswith("The title")
    assert htmltext.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), trees).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    rnd = random.Random(8)
    sound = {"en": "the and of tion ing er", "de": "sch ung ich ein ß ü"}
    rows = []
    for i in range(60):
        lang = rnd.choice(sorted(sound))
        rows.append((i, " ".join(rnd.choice(sound[lang].split()) + rnd.choice("abcdefgh") for _ in range(120)), lang, f"s{i % 3}", 1))
    rows += [(100, rows[3][1] + " tail", "en", "s1", 1), (101, None, None, None, None), (102, "1234 5678", "en", "s0", 1), (103, rows[5][1][:300] + " " + rows[6][1][:200], "en", "s2", 1)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in C.STAGES:
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen[name] = d.collect()
        if name != "encode":
            assert tuple(d.columns) == C.COLUMNS
    kept = {r.doc_id for r in seen["language_id"]}
    assert {101, 102}.isdisjoint(kept) and set(range(60)) <= kept
    assert {r.doc_id for r in seen["ngram_join"]} == kept - {100}
    cut = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert 103 not in cut or len(cut[103]) < 200
    assert all(r.n_chars == len(r.text) for r in seen["suffix_dedup"])
    assert Counter(r.doc_id for r in seen["encode"]) == Counter(r.doc_id for r in seen["mix"])
    whole = C.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in whole) == Counter((r.doc_id, r.ids_sha256) for r in seen["encode"])


def test_pipeline_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline as C

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    english, german = "the cat sat on the mat and it was warm there ", "der hund lief durch den wald und bellte laut "
    taught = [(i, (english, german)[i % 2] * (1 + i % 5), ("en", "de")[i % 2], "s", 1) for i in range(100, 160)]
    odd = [(None, None, "en", "s", 1), (None, "", "de", "s", 1), (7, None, "en", "s", 1), (7, english * 3, "en", "s", 1), (None, german * 3, "de", "s", 1)]
    out = C.language_id(spark, spark.createDataFrame(taught + odd, kind), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out if not (r.doc_id or 0) >= 100) == [(0, german * 3), (7, english * 3)]
    blank = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(["a b", "c"])], kind)
    assert C.language_id(spark, blank, "").count() == 2

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (5, a), (5, a), (4, b), (4, c), (9, b), (None, c), (None, None), (None, None), (8, "")]
    out = C.ngram_join(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], kind), "").collect()
    got = sorted((r.doc_id or 0, r.text or "") for r in out)
    assert got == sorted([(5, a), (4, b), (4, c), (0, ""), (0, ""), (8, "")])


def test_pipeline_of_an_empty_table_and_of_odd_columns(spark, tmp_path):
    """Extra columns with names of the stages' own, a very long text, null and repeated ids, and no rows at all."""
    import corpus_pipeline as C

    kind = "doc_id long, text string, lang string, source string, n_chars long, _row long, component_id string, kept_text string, n_tokens string, score double, lang_pred string"
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(60), "en", "s1", 1) for i in range(20)] + [(20, prose(40_000), "en", "s2", 1), (3, prose(50), "en", None, 1), (None, prose(50), "en", "s1", 1)]
    df = spark.createDataFrame([(*r, 7, "a", "b", "c", 0.5, "de") for r in rows], kind)
    for part, n in ((df, len(rows)), (df.limit(0), 0)):
        d = part
        for name, stage in C.STAGES:
            out = stage(spark, d, str(tmp_path))
            path = str(tmp_path / f"{name}-{n}")
            out.write.parquet(path)
            d = spark.read.parquet(path)
            if name in ("language_id", "ngram_join", "suffix_dedup"):
                assert tuple(d.columns) == C.COLUMNS and d.count() == n
                assert {(r.doc_id, r.text) for r in d.collect()} == {r[:2] for r in rows[:n]}
        assert (d.count() > 0) == (n > 0)


def test_stages_of_null_and_repeated_ids(spark):
    import corpus_pipeline as C

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["first of all words " * 3, "something else again " * 4, "and a third one here " * 5]
    rows = [(None, texts[0], "en", "a", 1), (5, texts[1], "en", "a", 1), (5, texts[2], "de", None, 1), (5, None, None, "b", 1), (None, "", "en", "b", 1)]
    df = spark.createDataFrame(rows, kind)
    cut = sorted((r.doc_id or 0, r.text, r.n_chars) for r in C.suffix_dedup(spark, df, "").collect())
    assert cut == sorted((i or 0, t, len(t)) for i, t, *_ in rows if t)
    mixed = Counter((r.doc_id, r.text) for r in C.mix(spark, df, "").collect())
    assert set(mixed) <= {r[:2] for r in rows}
    told = C.encode(spark, df, "").collect()
    assert len(told) == len(rows) and sorted(r.n_tokens for r in told)[:2] == [0, 0]
