"""Byte-level BPE, token counts, fingerprints, language ID: kernels and operators against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tallyframe.llm import bpe, common, langid, simhash, tokencount

ODD = ["", " ", "\n\n  x", "a" * 3000, "ab" * 400, "日本語テキスト" * 20, "<|endoftext|>", "naïve café — x²", "\x00\x01", "$$$%%%" * 60, "Ab" * 129, " x" * 300, "🙂🙂 é"]
CLASH = "doc_id long, text string, n_tokens string, score string, lang string, fingerprint string, ids string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "en", "c", "d") for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_the_library(codec):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abcdefgh étß19 .\n") for _ in range(rnd.randint(1, 400))) for _ in range(200)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_folded_rows_equal_the_library(codec):
    ref = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(2)
    for n in (2, 3, 7, 50, 400, 3000):
        for letters in ("ab", "the ing on", "aé日\n 0"):
            t = "".join(rnd.choice(letters) for _ in range(n))
            want = ref.encode_ordinary(t)
            for width in (2, 3, 16, 256):
                assert codec.merge_folded(t.encode(), width).tolist() == want
            assert codec.merge_matrix([t.encode()])[0].tolist() == want


def test_bpe_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0}, ".")


def test_bpe_operator_nulls_repeats_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "Hello there"), (3, "Hello there"), (None, "x")]
    out = bpe.encode_documents(clashing(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    none = hashlib.sha256(b"").hexdigest()
    by = {(r.doc_id, r.n_tokens): r for r in out}
    assert len(out) == 5 and by[1, 0].ids_sha256 == none == by[2, 0].decoded_sha256
    three = [r for r in out if r.doc_id == 3]
    assert len(three) == 2 and three[0] == three[1] and three[0].n_tokens == len(three[0].ids)
    assert three[0].decoded_sha256 == hashlib.sha256(b"Hello there").hexdigest()
    assert bpe.encode_documents(clashing(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_counts_equal_the_recurrence():
    u = tokencount.unigram(P.path("piece_bpe_32k.model"))
    rnd = random.Random(3)
    words = sorted({tokencount.SPACE + "".join(rnd.choice("abcdeéß日🙂xyz") for _ in range(rnd.randint(1, 40))) for _ in range(500)})
    assert u.count_distinct(words).tolist() == [u.plain(w) for w in words]
    long = sorted({tokencount.SPACE + "".join(rnd.choice("abcdeé日🙂ing") for _ in range(n)) for n in (255, 256, 257, 900, 5000)} | set(words[:3]))
    long += [long[-1] + "ing"]  # goes on where another ends
    assert u.count_distinct(long).tolist() == [u.plain(w) for w in long]


def test_narrow_tries_are_walked_once(monkeypatch):
    u = tokencount.unigram(P.path("piece_bpe_32k.model"))
    rnd = random.Random(8)
    stem = tokencount.SPACE + "".join(rnd.choice("thesing日🙂é") for _ in range(3000))
    words = sorted({stem, stem + "a", stem + "ab", stem[:2000] + "zz", stem[:1], stem[:7] + "q", "x" * 40})
    got = u.count_distinct(words).tolist()
    assert got == [u.plain(w) for w in words]
    monkeypatch.setattr(tokencount, "NARROW", 0)  # level by level to the end
    assert got == u.count_distinct(words).tolist()
    asked = []

    class Asked(dict):
        def get(self, piece):
            asked.append(1)
            return dict.get(self, piece)

    monkeypatch.setattr(tokencount, "NARROW", 8)
    monkeypatch.setattr(u, "scores", Asked(u.scores))
    u.count_distinct(words)
    assert len(asked) <= (3000 + 40 + 20) * u.longest  # one step a prefix, however many share it


def test_token_counts_brute_force_over_all_cuts():
    u = tokencount.Unigram({"a": -3, "ab": -4, "b": -3, "abc": -6, "bc": -2, "▁": -1, "▁a": -3}, -10)

    def cuts(s):
        if not s:
            yield 0, 0
        for n in range(1, len(s) + 1):
            p = u.scores.get(s[:n])
            cost = (p, 1) if p is not None else (len(s[0].encode()) * u.fallback, len(s[0].encode())) if n == 1 else None
            if cost:
                for a, b in cuts(s[n:]):
                    yield a + cost[0], b + cost[1]

    for w in ["▁abc", "▁aabbcc", "▁zé", "▁", "▁abcabc"]:
        best = max(cuts(w), key=lambda x: (x[0], -x[1]))
        assert u.plain(w) == best[1] == u.count_distinct([w])[0]


def test_token_counts_operator(spark):
    rows = [(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (4, "y" * 2000)]
    out = tokencount.count_tokens(clashing(spark, rows), P.path("piece_bpe_32k.model")).collect()
    got = sorted((r.doc_id, r.n_pretokens, r.n_tokens) for r in out)
    assert got[:2] == [(1, 0, 0), (2, 0, 0)] and got[2] == got[3] and got[2][1] == 2 and got[4][1] == 1 and got[4][2] > 1
    assert tokencount.count_tokens(clashing(spark, []), P.path("piece_bpe_32k.model")).count() == 0


def plain_simhash(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return tuple(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else ((tuple(words),) if words else ())


def test_fingerprints_depend_on_terms_alone():
    same = simhash.fingerprints([b"One two three four five six", b"one  TWO\nthree four five six", b"", b"   ", b"x"])
    assert same[0] == same[1] and same[2] == same[3] == 0 and same[4] != 0
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(500)]
    base = words[:]
    near = base[:]
    near[100] = "changed"
    f = simhash.fingerprints([" ".join(x).encode() for x in (base, near, words[::-1])])
    assert simhash.likeness(f[:1], f[1:2])[0] > 0.85 > 0.75 > simhash.likeness(f[:1], f[2:])[0]
    long = (" ".join(words) + " ").encode() * 200  # longer than a slice of votes
    assert simhash.fingerprints([long])[0] == simhash.fingerprints([b"zz", long])[1]


def test_votes_equal_a_plain_count():
    from tallyframe.llm import common

    text = b"a b c d e f g a b c d e a b c d e"
    blob, ends = common.pack_texts([text])
    words, doc = common.word_table(blob, ends)
    terms, _ = common.shingle_table(words, doc, 1, 5)
    assert len(terms) == len(plain_simhash(text.decode())) and len(set(terms.tolist())) == len(set(plain_simhash(text.decode())))
    h = common.mix(terms)
    bits = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))
    assert int(simhash.fingerprints([text])[0]) == bits


def plain_fingerprint(text):
    """Votes bit by bit, over the terms' hashes (the only part shared with the kernel)."""
    blob, ends = common.pack_texts([text.encode()])
    words, doc = common.word_table(common.lower_ascii(blob), ends)
    terms = [int(x) for x in common.mix(common.shingle_table(words, doc, 1, 5)[0])]
    return sum(1 << bit for bit in range(64) if sum(1 if t >> bit & 1 else -1 for t in terms) > 0)


def brute_edited(rows):
    order = sorted(((-1 << 63 if d is None else d, (t or "").encode(), t or "") for d, t in rows), reverse=True)
    for i, (d, _, t) in enumerate(order):
        nx, k = order[(i + 1) % len(order)][2], len(t) // 3
        edited = t[: len(t) - k] + nx[:k]
        own, other, nxt = (plain_fingerprint(x) for x in (t, edited, nx))
        same = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        yield (None if d == -1 << 63 else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other, same(own, other), same(own, nxt))


@pytest.mark.parametrize("n", [1, 2, 40, 300])
def test_edited_texts(spark, n):
    rnd = random.Random(n)
    rows = [(i // 2 * 3, rnd.choice([None, "", "é" * rnd.randint(1, 50), " ".join(rnd.choice(["alpha", "béta", "gamma", "δ"]) for _ in range(rnd.randint(1, 60)))])) for i in range(n)]
    rows += [(None, "no id at all"), rows[0]] if n > 2 else []
    rnd.shuffle(rows)
    out = simhash.compare_edited(clashing(spark, rows).repartition(3)).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint % (1 << 64), r.edited_fingerprint % (1 << 64), r.near_edited, r.near_next) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, brute_edited(rows)))


def test_edited_empty(spark):
    assert simhash.compare_edited(clashing(spark, [])).count() == 0


def test_simhash_query_counts_near_fingerprints(spark, tmp_path):
    rnd = random.Random(3)
    base = " ".join(rnd.choice("abcdefgh") for _ in range(300))
    rows = [(i, base + " " + rnd.choice("xyz") * (i % 4)) for i in range(12)] + [(20, "apart"), (21, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = simhash.op6_simhash(spark, str(tmp_path)).collect()
    prints = {int(r.fingerprint, 16) for r in out}
    assert len(out) == len(rows)
    for r in out:
        own = int(r.fingerprint, 16)
        assert r.n_near == sum(0 < bin(own ^ x).count("1") <= 3 for x in prints) and own == plain_fingerprint(dict(rows)[r.doc_id] or "")


def test_block_tables_lose_no_pair(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(30)]
    values = list({b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(6)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed + signed[:5] + [None]], "fingerprint long")
    got = {(r.a, r.b): r.distance for r in simhash.near_fingerprints(df, 3, 6).collect()}
    want = {}
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            d = bin((a ^ b) & (1 << 64) - 1).count("1")
            if d <= 3:
                want[min(a, b), max(a, b)] = d
    assert got == want and len(want) > 20


LANGS = {"aa": "aeiou naia oue iau", "bb": "brkt zkrt ptk vrk", "cc": "éàü öéß üàé ßö"}


def made_up(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(LANGS))
        rows.append((i, " ".join(rnd.choice(LANGS[lang].split()) for _ in range(rnd.randint(3, 60))), lang))
    return rows


def test_gradients_by_differences():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, m = rng.integers(0, 257, (6, 4)), np.array([0, 1, 2, 1]), rng.integers(0, 2, (6, 4)).astype(float)
    _, g = net.gradients(x, y, m)
    for k, p in net.p.items():
        for at in [np.unravel_index(np.abs(g[k]).argmax(), p.shape), tuple(0 for _ in p.shape)]:
            old, e = p[at], 1e-6
            p[at] = old + e
            up = net.gradients(x, y, m)[0]
            p[at] = old - e
            down = net.gradients(x, y, m)[0]
            p[at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_language_id_held_out(spark):
    rows = made_up(300)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 $$$", None), (1003, rows[0][1], None), (None, "brkt zkrt", "bb")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], "doc_id long, text string, lang string, score string, lang_pred string")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(out) == 305
    told = {i: lang for i, _, lang in rows}
    for i, r in out.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [i for i in told if out[i].held_out]
    assert np.mean([out[i].lang_pred == told[i] for i in held]) > 0.95
    assert {out[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and out[1003].lang_pred == out[0].lang_pred


def test_language_id_learns_nothing_from_held_out_rows(spark):
    rows = [(i, t, lang) for i, t, lang in made_up(120, 5)]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (langid.train(spark.createDataFrame(r, "doc_id long, text string, lang string"), steps=20) for r in (rows, wrong))
    assert a.languages == b.languages and all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.where("false")).count() == 0


def plain_states(net, raw, way):
    """The recurrence, byte by byte and unit by unit."""
    squash = lambda v: v / (1 + abs(v))
    w, u, c, h = net.p["w" + way], net.p["u" + way], net.p["c" + way], net.h
    state, out = [0.0] * h, []
    for byte in raw if way == "f" else raw[::-1]:
        gate = lambda k: 0.5 + 0.5 * squash(float(w[k, byte]) + sum(float(u[k, j]) * state[j] for j in range(h)))  # noqa: E731,B023
        new = []
        for k in range(h):
            z, r = gate(k), gate(h + k)
            memory = sum(float(u[2 * h + k, j]) * state[j] for j in range(h)) + float(c[k, 0])
            new.append(z * state[k] + (1 - z) * squash(float(w[2 * h + k, byte]) + r * memory))
        state = new
        out.append(state)
    return out if way == "f" else out[::-1]


def plain_pooled(net, raw):
    total = np.zeros(len(net.languages))
    f, b = (plain_states(net, raw, way) for way in "fb")
    for x, y in zip(f, b):
        e = np.exp(net.p["v"].astype(float) @ np.array(x + y) + net.p["d"][:, 0])
        total += e / e.sum()
    return total / len(raw)


def test_network_equals_the_plain_recurrence():
    net = langid.Network(["a", "b", "c"], hidden=4)
    rnd = random.Random(9)
    texts = [bytes(rnd.randrange(256) for _ in range(n)) for n in (1, 5, 200, 256)]
    for raw, p in zip(texts, net.pooled(texts)):
        assert np.allclose(p, plain_pooled(net, raw), atol=1e-5)


def test_state_runs_on_across_windows():
    """A text of several windows, and a very long one, come out as if read in one go."""
    net = langid.Network(["a", "b", "c"], hidden=4)
    rnd = random.Random(10)
    raw = " ".join(rnd.choice(["zart", "brkt", "oué", "lilo"]) for _ in range(600)).encode()
    assert len(raw) > 5 * langid.WINDOW
    assert np.allclose(net.pooled([raw])[0], plain_pooled(net, raw), atol=1e-3)
    assert np.allclose(net.pooled([raw * 300])[0], net.pooled([raw])[0], atol=1e-2)


def test_pooling_ignores_how_texts_are_batched():
    net = langid.Network(["a", "b"])
    texts = [b"x" * 500, b"", "é".encode() * 40, b"q"]
    together = net.pooled(texts)
    for t, p in zip(texts, together, strict=True):
        assert np.allclose(net.pooled([t])[0], p, atol=1e-5)
    assert np.allclose(together.sum(1), [1, 0, 1, 1], atol=1e-5)
