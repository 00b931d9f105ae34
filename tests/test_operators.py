"""The library's operators on small frames, and its queries against DuckDB."""

import hashlib
import itertools
import json
import math
import os
import random
import shutil
import subprocess
import sys
import uuid
import zipfile
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyframe import catalog
from tallyframe.functions import events as E
from tallyframe.functions import paths as P
from tallyframe.functions import quality
from tallyframe.operators import metrics as M
from tallyframe.operators import ranking as R
from tallyframe.operators import relations as J
from tallyframe.operators import scoring as S
from tallyframe.operators import sequential as Q
from tallyframe.operators.graph import connected_components
from tallyframe.sources import archives, manifest, sinks
from tallyframe.streaming import market

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(round(float(x), 5) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cursor.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(map(canonical, r)) for r in cursor.fetchall())
    got = sorted(tuple(map(canonical, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


# ---------------------------------------------------------------- metrics


def test_metrics_of_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("a", "zz"), (None, "a")], "t string, p string")
    m = M.confusion(df, "t", "p", ["a", "b", "c"])
    assert m.count() == 9 and {(r.truth, r.pred): r.n for r in m.collect()}["a", "b"] == 1
    s = M.summary(m, ("a", "c")).first()
    every = M.summary(m, ("a", "c"), all_classes=True).first()
    assert s.n == 3 and s.macro_f1 == pytest.approx(2 / 3) and every.macro_f1 == pytest.approx(4 / 9) and s.cross_step == 0
    empty = df.where("false")
    assert [r.n for r in M.confusion(empty, "t", "p", ["a"]).collect()] == [0]
    assert M.confusion(empty.withColumn("k", F.lit(1)), "t", "p", ["a"], ("k",)).count() == 0


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1.0, True), (0.1, False), (0.1, True), (0.0, True)], "c double, ok boolean")
    b = {r.bin: r for r in M.calibration_bins(df, F.col("ok"), F.col("c")).collect()}
    assert b[9].n == 1 and b[1].n == 2 and b[0].n == 1 and b[5].n == 0 and b[5].accuracy is None


def test_wilson_and_bootstrap(spark):
    low, high = M.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(8, 10), (0, 0)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert r[0].l == pytest.approx(0.490157, abs=1e-5) and r[0].h == pytest.approx(0.943318, abs=1e-5) and (r[1].l, r[1].h) == (0, 0)
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, 400)
    out = M.bootstrap_mean(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double"), "v", "i", 300).first()
    assert out.n == 400 and out["mean"] == pytest.approx(x.mean()) and out.low < out["mean"] < out.high
    assert out.high - out.low == pytest.approx(4 * 2 / 20, rel=0.35)
    empty = M.bootstrap_mean(spark.createDataFrame([], "i long, v double"), "v", "i").first()
    assert (empty.n, empty["mean"], empty.low) == (0, None, None)


def test_bootstrap_draws_as_often_as_the_reference(spark, monkeypatch):
    asked, real = [], M.bootstrap_mean
    monkeypatch.setattr(M, "bootstrap_mean", lambda df, value, key, resamples: asked.append(resamples) or real(df, value, key, resamples))
    out = catalog.QUERIES["q_bootstrap_mean"](spark, SF).first()
    assert asked == [10_000]
    v = np.array([r.value for r in spark.read.parquet(f"{SF}/events.parquet").select("value").collect() if r.value is not None])
    rng = np.random.default_rng(1)
    low, high = np.percentile([v[rng.integers(0, len(v), len(v))].mean() for _ in range(10_000)], [2.5, 97.5])
    assert out.n == len(v) and out["mean"] == pytest.approx(v.mean())
    assert abs(out.low - low) < 0.03 * (high - low) and abs(out.high - high) < 0.03 * (high - low)


# ---------------------------------------------------------------- leakage


def test_leakage_on_whole_texts(spark, monkeypatch):
    passage = "It stands in the very middle, whole."
    texts = [f"{'x' * 70} pre{passage}post", f"{passage[:-1]}?", None, "", "ab", "It stands  in the very middle, whole.", passage, "xx oddz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    bench = spark.createDataFrame([(passage,), (passage,), ("oddz",), ("",), (None,)], "p string")
    for few in (100_000, 2):
        monkeypatch.setattr(J, "FEW_PASSAGES", few)
        assert {r.id for r in J.containing(docs, "text", bench, "p").collect()} == {0, 6, 7}
    bits = spark.createDataFrame([(0, 0b111111), (5, 0b1111111), (10, -1), (1, 0), (2, -1), (15, None), (3, None)], "id long, h long")
    test = F.col("id") % 5 == 0
    for few in (1_000_000, 0):
        monkeypatch.setattr(J, "FEW_KEYS", few)
        assert {r.id for r in J.near_other_side(bits, "h", 6, test).collect()} == {0, 10}
        assert {r.id for r in J.on_both_sides(bits, "h", test).collect()} == {10}


def test_registered_leakage_finds_what_the_prefix_misses(spark):
    rows = {(r.leg, r.id) for r in catalog.QUERIES["q_leakage"](spark, "/root/testdata/sf0.01").collect()}
    assert len([x for x in rows if x[0] == "passage"]) == 26


# ---------------------------------------------------------------- events


def good_event(**change):
    r = dict(
        status="ok", label="light", label_th="x", message_th="m", model="b1", confidence=0.9, probs={"light": 0.9, "medium": 0.05, "dark": 0.05}, warnings=["mixed_roast"], n_beans=3,
        proportions={"light": 0.67, "medium": 0.33, "dark": 0.0}, beans=[{"label": "light"}, {"label": "light"}, {"label": "medium"}], timing_ms={}, schema_version=3,
        counts={"light": 2, "medium": 1, "dark": 0}, count_method="exact", image_size=[640, 480],
    )
    r |= change
    return {"msg_id": str(uuid.uuid4()), "created_at": "2026-01-01T00:00:00Z", "result": {k: v for k, v in r.items() if v != "ABSENT"}}


@pytest.mark.parametrize(
    "change,error",
    [
        ({}, None), ({"beans": "ABSENT"}, None), ({"n_beans": True}, "n_beans"), ({"n_beans": 3.0}, "n_beans"), ({"n_beans": -1}, "n_beans"), ({"counts": {"light": 3, "medium": 1, "dark": 0}}, "counts"),
        ({"counts": {"light": True, "medium": 2, "dark": 0}}, "counts"), ({"counts": {"light": 3}}, "counts"), ({"warnings": ["mixed_roast", 1]}, "warnings"), ({"warnings": []}, "count_warning"),
        ({"count_method": "guess"}, "method_warning"), ({"label": "dark"}, "label_not_majority"), ({"image_size": [0, 4]}, "image_size"), ({"image_size": None}, None), ({"image_size": [4, True]}, "image_size"),
        ({"schema_version": 3.0}, "schema_version"), ({"schema_version": "3"}, "key_set"), ({"extra": 1}, "key_set"), ({"status": "odd"}, "status"),
        ({"status": "error"}, "failed_with_label"), ({"status": "error", "label": None}, "failed_with_counts"), ({"model": None}, "texts"),
        ({"counts": None, "n_beans": None}, "uncounted_with_values"), ({"counts": None, "n_beans": None, "count_method": None, "beans": []}, None), ({"beans": [{"label": "light"}]}, "bean_number"),
        ({"beans": [{"label": "light"}, {"label": "odd"}, {"label": "medium"}]}, "bean_label"), ({"beans": [{"label": "dark"}, {"label": "light"}, {"label": "medium"}]}, "bean_counts"),
    ],
)
def test_event_rules(spark, change, error):
    df = spark.createDataFrame([(json.dumps(good_event(**change)),)], "payload string")
    assert E.validated(df, "payload").first().error == error


def test_event_envelope(spark):
    e = good_event()
    rows = [json.dumps(e), json.dumps(e | {"msg_id": "{" + e["msg_id"].replace("-", "").upper() + "}"}), "[]", "NaN", None, json.dumps(e | {"msg_id": "x"}), json.dumps(e | {"created_at": "y" * 41}), json.dumps(e | {"created_at": 5}), json.dumps(e | {"result": []}), json.dumps(e).replace("0.9,", "NaN,")]
    got = [r.error for r in E.validated(spark.createDataFrame([(x,) for x in rows], "payload string"), "payload").collect()]
    assert got == [None, None, *["not_object"] * 3, "msg_id", "created_at", "created_at", "result_not_object", "not_object"]


def test_estimated_flag(spark, tmp_path):
    spark.range(-16, 31).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.estimated for r in catalog.QUERIES["q_estimated_flag"](spark, str(tmp_path)).collect()}
    assert got == {i: i % 3 == 0 or i % 5 == 0 for i in range(-16, 31)}
    told = [{"count_method": "estimated"}, {"count_method": "exact", "warnings": ["x", "bean_count_estimated"]}, {"count_method": True, "warnings": "x"}, {"warnings": {"bean_count_estimated": 1}}, {}]
    rows = [(i, x) for i, x in enumerate([*map(json.dumps, told), "[]", "nonsense", None])]
    df = spark.createDataFrame(rows, "i int, j string").select("i", E.members(E.variant(F.col("j"))).alias("m"))
    assert [r.e for r in df.select("i", E.estimated(F.col("m")).alias("e")).orderBy("i").collect()] == [True, True, *[False] * 6]


def plain_apportion(n, shares):
    raw = [n * s / sum(shares) for s in shares]
    base = [int(x) for x in raw]
    for i in sorted(range(3), key=lambda i: (-(raw[i] - base[i]), i))[: n - sum(base)]:
        base[i] += 1
    return base


def test_apportionment(spark):
    rnd = random.Random(1)
    rows = [(n, *[rnd.choice([0.0, 0.25, 1 / 3, rnd.random()]) for _ in range(3)]) for n in range(1, 120)] + [(5, 1.0, 1.0, 1.0), (1, 0.0, 0.0, 0.0), (0, 1.0, 0.0, 0.0), (3, float("nan"), 1.0, 1.0), (3, -1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "n long, a double, b double, c double")
    for r in df.withColumn("x", E.apportion(F.col("n"), [F.col("a"), F.col("b"), F.col("c")])).collect():
        ok = r.n > 0 and sum((r.a, r.b, r.c)) > 0 and min(r.a, r.b, r.c) >= 0 and not math.isnan(r.a)
        assert (list(r.x) == plain_apportion(r.n, (r.a, r.b, r.c)) and sum(r.x) == r.n) if ok else r.x is None


def lines(stamps):
    out = []
    for i, (stamp, kind) in enumerate(stamps):
        e = good_event() if kind == "ok" else good_event(counts=None, n_beans=None, count_method=None, beans=[]) if kind == "none" else {"bad": 1}
        e |= {"created_at": f"2026-01-01T00:00:{stamp:02d}"}
        out.append((json.dumps(e | {"msg_id": str(uuid.UUID(int=i + 1))}) if kind != "bad" else json.dumps(e),))
    return out


def test_stream_ingest_and_snapshot_equal_a_rebuild(spark, tmp_path):
    inbox, folder = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    batches = [lines([(5, "ok"), (1, "ok"), (9, "bad")]), lines([(5, "ok"), (1, "ok"), (9, "ok"), (1, "ok"), (7, "none")]), lines([(2, "ok")] * 7)]
    snap = market.Snapshot(folder, limit=3)
    for i, rows in enumerate(batches):
        (inbox / f"{i}.txt").write_text("\n".join(r[0] for r in rows))
        q = market.start_ingest(spark.readStream.text(str(inbox)), folder, str(tmp_path / "cp"), snap.fold)
        q.awaitTermination()
        stored = market.read_predictions(spark, folder)
        state, top, beans = snap.read(spark)
        want = market.totals(stored).first()
        assert state.first().asDict() == want.asDict()
        assert [tuple(r) for r in top.collect()] == [tuple(r) for r in market.newest(stored, 3).collect()]
        assert [tuple(r) for r in beans.collect()] == [tuple(r) for r in market.newest_beans(stored, 3).collect()]
        seqs = sorted(r.ingest_seq for r in stored.collect())
        assert seqs == sorted(set(seqs)) and seqs[-1] < 15  # numbers go on without gaps over all rows of all batches
    # the first event of an id wins: ids 1, 2 of the first batch, 3 to 5 of the second, 6 and 7 of the third
    assert {r.msg_id[-1]: r.created_at[-2:] for r in stored.collect()} == {"1": "05", "2": "01", "3": "09", "4": "01", "5": "07", "6": "02", "7": "02"}
    assert want.results == 6 and want.light == 12
    beans = market.newest_beans(stored, 4).collect()
    assert [(r.created_at[-2:], r["index"], r.label) for r in beans] == [("09", 1, "light"), ("09", 2, "light"), ("09", 3, "medium"), ("05", 1, "light")]
    rejects = spark.read.parquet(f"{folder}/rejects").collect()
    assert [r.reason for r in rejects] == ["msg_id"]
    market.ingest_batch(spark.createDataFrame(batches[2], "value string"), 2, folder)  # a batch run again changes nothing
    assert market.totals(market.read_predictions(spark, folder)).first().asDict() == want.asDict()


def test_publish_and_visible_only(spark, tmp_path):
    rows = [json.dumps(good_event(warnings=["mixed_roast", "count_visible_only"]) | {"msg_id": str(uuid.UUID(int=i + 1))}) for i in range(5)]
    market.ingest_batch(spark.createDataFrame([(r,) for r in rows], "value string"), 0, str(tmp_path / "s"))
    stored = market.read_predictions(spark, str(tmp_path / "s"))
    assert market.totals(stored).first().visible_only == 5
    for _ in range(2):  # a batch run again replaces its part
        market.publish(stored, str(tmp_path / "out"), 0, most=3)
    sent = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    want = json.loads(rows[0])["result"]
    assert len(sent) == 3 and all(x["result"] == {k: v for k, v in want.items() if k != "beans"} for x in sent)
    assert json.loads(market.publishable(stored, 1, compact=False).first().value)["result"] == want | {"beans": []}


def test_bounded_dedup_streams(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(40).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    out = []
    q = market.bounded_dedup(s, "user_id", "ts", "365 days").writeStream.foreachBatch(lambda d, i: out.extend(d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(out) == spark.read.parquet(str(tmp_path / "e")).select("user_id").distinct().count()


# ---------------------------------------------------------------- ranking, joins, graph


def test_priority_dedup(spark):
    rows = [(1, "m", "x", 2), (2, "m", "x", 1), (3, "n", "x", 1), (4, "n", "y", 1), (5, None, "z", 1), (6, None, "z", 1)]
    df = spark.createDataFrame(rows, "id long, md5 string, label string, rank int")
    twice, gone = R.priority_dedup(spark.createDataFrame([(1, "m", "x"), (1, "m", "x"), (2, "m", "x"), (3, "n", "x"), (4, "n", "x")], "id long, md5 string, label string"), "md5", "label", [F.lit(0)])
    assert twice.count() == 2 and gone.count() == 3 and {r.md5 for r in twice.collect()} == {"m", "n"}  # rows of equal order
    kept, dropped = R.priority_dedup(df, "md5", "label", [F.col("rank"), F.col("id")])
    assert sorted(r.id for r in kept.collect()) == [2, 5]
    assert {(r.id, r.reason) for r in dropped.collect()} == {(1, "duplicate"), (3, "label_conflict"), (4, "label_conflict"), (6, "duplicate")}


def test_caps_and_samples(spark):
    rows = [("s:video:A", f"p{i:02d}") for i in range(25)] + [("s:video:B", f"q{i}") for i in range(4)] + [("s:file:x", f"r{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "g string, path string")
    out = R.cap_groups(df, "g", F.contains("g", F.lit(":video:")), 10, [R.shuffled(7, "path")])
    assert {r.g: r["count"] for r in out.groupBy("g").count().collect()} == {"s:video:A": 10, "s:video:B": 4, "s:file:x": 3}
    again = R.cap_groups(df.orderBy(F.rand()), "g", F.contains("g", F.lit(":video:")), 10, [R.shuffled(7, "path")])
    assert sorted(out.collect()) == sorted(again.collect())
    halves = R.half_split(df.withColumn("g", F.col("path")), "g", 3).collect()
    assert len(halves) == 32 and sum(r.half == "dev" for r in halves) == 16
    assert [r.path for r in R.spaced(df.where("g = 's:video:A'"), ["g"], [F.col("path")], 5, 2).orderBy("path").collect()] == ["p02", "p07", "p12", "p17", "p22"]


def test_guards(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,), (3,)], "k long")
    with pytest.raises(ValueError, match="populations"):
        J.same_population(a, b, "k")
    with pytest.raises(ValueError, match="unique"):
        J.same_population(a.union(a), a, "k")
    with pytest.raises(ValueError, match="mask"):
        J.keep_by_mask(a, b.withColumn("f", F.lit(1)), "k", "f")
    assert {(r.k, r.side) for r in J.population_diff(a, b, "k").collect()} == {(2, "a"), (3, "b")}
    with pytest.raises(PermissionError):
        manifest.test_rows(a, False)


def test_append_first_writer_wins(spark):
    batch = spark.createDataFrame([("a", 3, "late"), ("a", 1, "first"), ("b", 2, "new"), ("c", 4, None)], "id string, seq int, v string")
    target = spark.createDataFrame([("b",)], "id string")
    assert sorted((r.id, r.seq, r.v) for r in J.append_new(target, batch, "id", [F.col("seq")]).collect()) == [("a", 1, "first"), ("c", 4, None)]


def test_hamming_join(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 9))) for b in base for _ in range(5)]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)] + [(999, None)], "k long, h long")
    got = {(r.a, r.b, r.distance) for r in J.hamming_join(df, "k", "h", 6).collect()}
    assert got == {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(100) for j in range(i + 1, 100) if (values[i] ^ values[j]).bit_count() <= 6}


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (60, 60)], "random"])
def test_components(spark, edges):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] if edges == "random" else edges
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_boxes(spark):
    rows = [("i", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 2, 1.0, 0.0, 11.0, 10.0, 0.8), ("i", 3, 20.0, 20.0, 30.0, 30.0, 0.8), ("i", 4, -5.0, -5.0, 40.0, 40.0, 0.1), ("j", 1, 0.0, 0.0, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "image string, box long, x0 double, y0 double, x1 double, y1 double, score double")
    assert [(r.image, r.box) for r in Q.suppress(df, "image", "box", "score", 0.5, 10).orderBy("image", "rank").collect()] == [("i", 1), ("i", 3), ("i", 4), ("j", 1)]
    assert Q.suppress(df, "image", "box", "score", 0.5, 1).count() == 2
    assert [(r.box, r.inside) for r in J.containers(df, "image", "box", 3, 2.0).collect()] == [(4, 3)]
    assert {r.image: r.share for r in J.overlap_share(df, "image", "box").collect()} == {"i": 0.5, "j": 0.0}
    top = J.box_pairs(df, "image", "box").where("a = 1 and b = 2").first()
    assert top.iou == pytest.approx(90 / 110)


# ---------------------------------------------------------------- sequential, scoring


def test_clusters_and_ordered_labels():
    values = np.array([10.0, 11, 12, 50, 51, 52, 90, 91])
    borders, centres = Q.Line(values[::-1]).cut(3)
    assert borders.tolist() == [0, 3, 6, 8] and centres.tolist() == [11, 51, 90.5]
    assert Q.Line(np.ones(4)).cut(2) is None
    rng = np.random.default_rng(4)
    for _ in range(200):
        gain = rng.integers(0, 4, (rng.integers(1, 4), 4)).astype(float)
        best = max(itertools.combinations(range(4), len(gain)), key=lambda c: sum(gain[j, x] for j, x in enumerate(c)))
        assert Q.rising_choice(gain) == list(best)
    probs = np.tile([0.2, 0.3, 0.5], (8, 1))
    label, k = Q.ordered_labels(values, probs, [2, 1, 0], 12.0)
    assert k == 3 and label.tolist() == [2, 2, 2, 1, 1, 1, 0, 0]
    label, k = Q.ordered_labels(np.ones(5), probs[:5], [2, 1, 0], 12.0)
    assert k == 1 and set(label) == {2}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_groups_of_one_size_are_judged_as_each_alone(n):
    rng = np.random.default_rng(n)
    values, probs = rng.integers(1, 51, (60, n)).astype(float), rng.random((60, n, 3)).round(1)
    label, k = Q.label_many(values, probs, [2, 1, 0], 12.0)
    boxes, scores = rng.integers(0, 30, (60, n, 4)).astype(float), rng.integers(0, 5, (60, n)).astype(float)
    boxes[:, :, 2:] += boxes[:, :, :2]
    if n == 8:
        scores[::5, 3] = np.nan
    rank = Q.keep_many(boxes, scores, 0.3, 5)
    for g in range(60):
        own, groups = Q.ordered_labels(values[g], probs[g], [2, 1, 0], 12.0)
        assert own.tolist() == label[g].tolist() and groups == k[g]
        kept = Q.greedy_keep(boxes[g], scores[g], 0.3, 5)
        assert rank[g, kept].tolist() == list(range(1, len(kept) + 1)) and (rank[g] > 0).sum() == len(kept)


def test_label_groups_goes_through_many_groups_at_a_time(spark):
    """Groups of several sizes, one beyond a batch, a null one, and numbers of rows that are not unique."""
    rng = np.random.default_rng(5)
    rows = [(None if i % 9 == 0 else int(i % 9 * rng.integers(1, 60)), int(rng.integers(0, 5)), float(rng.integers(1, 51)), *map(float, rng.random(3).round(2))) for i in range(3000)]
    rows += [(-1, i, float(i % 50), 0.2, 0.3, 0.5) for i in range(12_000)]
    df = spark.createDataFrame(rows, "image long, bean long, value double, p0 double, p1 double, p2 double").repartition(3)
    got = Q.label_groups(df, "image", "bean", "value", ["p0", "p1", "p2"])
    groups = {}
    for image, *row in rows:
        groups.setdefault(image, []).append(row)
    want = []
    for image, g in groups.items():
        g = sorted(g)
        label, k = Q.ordered_labels(np.array([r[1] for r in g]), np.array([r[2:] for r in g]), [2, 1, 0], 12.0)
        want += [(image, r[0], int(x), k) for r, x in zip(g, label)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_suppress_goes_through_many_images_at_a_time(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 9 == 0 else f"i{i % 9 * rng.integers(1, 60)}", i, *c, c[0] + 9, c[1] + 9, s) for i, (c, s) in enumerate(zip(rng.integers(0, 9, (3000, 2)).astype(float).tolist(), rng.integers(0, 9, 3000).astype(float).tolist()))]
    df = spark.createDataFrame(rows, "image string, box long, x0 double, y0 double, x1 double, y1 double, score double").repartition(3)
    got = Q.suppress(df, "image", "box", "score", 0.5, 4)
    groups = {}
    for image, *row in rows:
        groups.setdefault(image, []).append(row)
    want = []
    for image, g in groups.items():
        kept = Q.greedy_keep(np.array([r[1:5] for r in g]), np.array([r[5] for r in g]), 0.5, 4)
        want += [(image, g[i][0], r + 1) for r, i in enumerate(kept)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_group_split_walks_like_a_loop(spark):
    for seed, sizes, target in [(1, [3, 5, 2, 9, 1, 4, 1, 7, 2, 6] * 3, 40), (2, [8, 8, 8, 1, 1], 11), (3, [2, 2], 4), (4, [5], 0), (5, [9, 9], 4)]:
        rows = [(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)] + [(None,)]
        want, used = {}, 0
        for g in sorted({r[0] for r in rows[:-1]}, key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g)):
            n = sizes[int(g[1:])]
            want[g] = "dev" if used + n <= target else "frozen"
            used += n if want[g] == "dev" else 0
        df = spark.createDataFrame(rows, "g string").repartition(3)
        assert {r.g: r.half for r in Q.group_split(df, "g", target, seed, exact=False).collect()} == want
        if used == target:
            assert Q.group_split(df, "g", target, seed).count() == len(want)
        else:
            with pytest.raises(ValueError):
                Q.group_split(df, "g", target, seed)
    assert Q.group_split(spark.createDataFrame([], "g string"), "g", 3, 1, exact=False).count() == 0


def test_light_groups_are_dealt_in_tasks(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.choice("xyz") if g % 3 else "x") for g in range(900) for _ in range(rnd.randint(1, 4))]
    rows += [(1000 + g, "yz"[g % 2]) for g in range(3) for _ in range(200)] + [(None, "x"), (1, None)]
    df = spark.createDataFrame(rows, "g long, y string").repartition(5)
    fold = {r.g: r.fold for r in Q.stratified_folds(df, "g", "y", 4, heavy=8).collect()}
    assert set(fold) == {g for g, _ in rows if g is not None} and fold == {r.g: r.fold for r in Q.stratified_folds(df.repartition(2), "g", "y", 4, heavy=8).collect()}
    n = {c: [sum(fold[g] == f for g, y in rows if g is not None and y == c) for f in range(4)] for c in "xyz"}
    assert max(n["x"]) - min(n["x"]) < 0.15 * sum(n["x"]) / 4 and len({fold[1000], fold[1001], fold[1002]}) >= 2
    assert all(max(x) - min(x) <= 200 for x in n.values())
    assert [r.no for r in Q.numbered(spark.range(100).repartition(7), "no", F.desc("id")).orderBy("id").collect()] == list(range(99, -1, -1))
    with pytest.raises(ValueError):
        Q.stratified_folds(df.where("g < 3"), "g", "y", 4)


def test_folds_take_every_class_of_every_group(spark):
    rows = [(f"g{i % 3}", f"c{i % 40}") for i in range(120)]
    df = spark.createDataFrame(rows, "g string, y string")
    assert Q.stratified_folds(df, "g", "y", 3).count() == 3


def test_folds_keep_groups_whole(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(f"g{rnd.randrange(60)}", rnd.choice(["x", "y", "z"])) for _ in range(600)], "g string, y string")
    folds = Q.stratified_folds(df, "g", "y", 5)
    assert folds.count() == folds.select("g").distinct().count() == df.select("g").distinct().count()
    n = [r["count"] for r in df.join(folds, "g").groupBy("fold").count().collect()]
    assert len(n) == 5 and max(n) < 1.5 * min(n)
    assert Q.usable_fold(df, folds, "g", "y", ["x", "y", "z"]) == 0
    with pytest.raises(ValueError):
        Q.usable_fold(df, folds, "g", "y", ["x", "never"])
    with pytest.raises(ValueError):
        Q.stratified_folds(df.where("g = 'g1'"), "g", "y", 5)


def test_flag_cover(spark):
    df = spark.createDataFrame([("s", 1, ["a"]), ("s", 2, ["a"]), ("s", 3, ["b", "a"]), ("s", 4, []), ("s", 5, ["c"])], "s string, r long, f array<string>")
    assert [r.r for r in Q.diverse_rows(df, "s", "r", "f", 4).orderBy("place").collect()] == [1, 3, 5, 2]


def test_threshold_fit_equals_a_loop(spark):
    rnd = random.Random(6)
    rows = [(x := rnd.gauss(50, 20), "dark" if x + rnd.gauss(0, 8) < 40 else "medium" if x < 60 else "light") for _ in range(200)]
    classes = ("dark", "medium", "light")
    got = S.fit_thresholds(spark.createDataFrame(rows, "x double, y string"), "x", "y", classes).first()
    cuts = np.unique(np.percentile([x for x, _ in rows], range(1, 100)))

    def f1(lo, hi):
        p = ["dark" if x < lo else "medium" if x < hi else "light" for x, _ in rows]
        return sum(2 * sum(a == b == c for a, (_, b) in zip(p, rows)) / max(1, sum(a == c for a in p) + sum(b == c for _, b in rows)) for c in classes) / 3

    best = max(f1(a, b) for i, a in enumerate(cuts) for b in cuts[i + 1 :])
    assert got.macro_f1 == pytest.approx(best) == f1(got.low, got.high)


def test_scorer_registry():
    with pytest.raises(ValueError):
        S.scorer("nobody")
    with pytest.raises(ValueError):
        S.register_scorer("ordinal_price", lambda d: d)


# ---------------------------------------------------------------- sources and sinks


def test_manifest_and_predictions(spark, tmp_path):
    head = ",".join(manifest.COLUMNS)
    row = "{},{},x,{},g,{},,,m,{},,,"
    lines_ = [head, row.format("a", "light", "s1", "trainval", "ffffffffffffffff"), row.format("b", "light", "s1", "test", ""), row.format("c", "odd", "s1", "trainval", ""), row.format("d", "dark", "s9", "trainval", ""), row.format("e", "dark", "s2", "trainval", "zz")]
    (tmp_path / "m.csv").write_text("\n".join(lines_))
    df = manifest.read_manifest(spark, str(tmp_path / "m.csv"))
    kept = manifest.trainval(df, ("light", "medium", "dark"), ("s1", "s2"))
    assert sorted((r.path, r.phash_bits) for r in kept.collect()) == [("a", -1), ("e", None)]
    with pytest.raises(ValueError, match="repeated"):
        manifest.trainval(df.union(df), ("light",), ("s1",))
    with pytest.raises(ValueError, match="safe"):
        manifest.frozen_reader(kept, kept.where("false"), kept.where("path = 'a'"))
    (tmp_path / "p.csv").write_text("path,label,p_light,p_medium,p_dark\na,light,0.5,0.25,0.25\n")
    assert manifest.read_predictions(spark, str(tmp_path / "p.csv"), "p_").first().prob_light == 0.5
    (tmp_path / "q.csv").write_text("path,label,p_light,p_medium,p_dark\na,light,0.5,0.25,0.2\n")
    with pytest.raises(Exception, match="sum to one"):
        manifest.read_predictions(spark, str(tmp_path / "q.csv"), "p_").collect()


def test_folders_annotations_and_names(spark, tmp_path):
    for split, cls, name in (("train", "Dark", "a.rf.00ff.jpg"), ("train", "Light", "b.png"), ("val", "Dark", "c.txt")):
        (tmp_path / "f" / split / cls).mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / split / cls / name).write_bytes(b"12345")
    got = sorted((r.split_orig, r.label_orig, r.stem, r.bytes) for r in manifest.scan("folder", spark, str(tmp_path / "f"), "s").collect())
    assert got == [("train", "Dark", "a", 5), ("train", "Light", "b", 5)]
    with pytest.raises(ValueError):
        manifest.scan("nowhere")
    for d in ("images", "labels"):
        (tmp_path / "y" / "train" / d).mkdir(parents=True)
    for n in ("a", "b"):
        (tmp_path / "y" / "train" / "images" / f"{n}.jpg").write_bytes(b"1")
    (tmp_path / "y" / "train" / "labels" / "a.txt").write_text("1 .5 .5 .1 .1\n0 .5 .5 .1 .1 9\nbad\n")
    got = sorted((r.stem, r.label_orig, r.n_boxes) for r in manifest.scan_annotated(spark, str(tmp_path / "y"), "s", ["Raw", "Dark Roast"]).collect())
    assert got == [("a", "Dark Roast|Raw", 2), ("b", "(no_label)", 0)]
    (tmp_path / "d.yaml").write_text("train: x\nnames: ['Raw', 'Dark Roast']\n")
    assert manifest.class_names(spark, str(tmp_path / "d.yaml")) == ["Raw", "Dark Roast"]
    rows = ["0 .5 .5 .1 .1", "0 .5 .5 .1", "0 x .5 .1 .1", "0 .5 .5 0 .1", "0 .95 .5 .2 .1", "0 NaN .5 .1 .1"]
    got = [r.issues for r in manifest.annotation_issues(spark.createDataFrame([(x,) for x in rows], "value string")).collect()]
    assert got == [[], ["field_count"], ["not_a_number"], ["empty_box"], ["out_of_bounds"], ["not_a_number"]]
    assert sorted((r.folder, r.extension, r.files, r.images) for r in manifest.survey(spark, str(tmp_path / "f")).collect()) == [("Dark", "jpg", 1, 1), ("Dark", "txt", 1, 0), ("Light", "png", 1, 1)]


def test_photo_metadata(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿device_id;name_paper\n1;a\n1;a\n1;b\n2;b\n9;c\n", encoding="utf-8")
    photos = manifest.read_semicolon_csv(spark, str(tmp_path / "p.csv"))
    devices = spark.createDataFrame([("1", "one"), ("2", "two")], "device_id string, name string")
    kept, rejects = manifest.photos_with_devices(photos, devices)
    assert sorted((r.name_paper, r.device) for r in kept.collect()) == [("a", "one"), ("c", "?")]
    assert {r.name_paper for r in rejects.collect()} == {"b"}


def test_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def make(name, members):
        with zipfile.ZipFile(tmp_path / "in" / name, "w") as z:
            for m in members:
                z.writestr(m, m * 3)

    bad = {"parent.zip": ["ok", "../x"], "absolute.zip": ["/x"], "drive.zip": ["c:x"], "repeated.zip": ["A", "a", "b"]}
    for name, m in bad.items():
        make(name, m)
    make("ok.zip", ["a/b.txt", "c", "empty/"])
    make("none.zip", [])
    (tmp_path / "in" / "not_an_archive.zip").write_bytes(b"no zip at all")
    (tmp_path / "in" / "other.txt").write_bytes(b"not read")
    make("broken.zip", ["first", "second"])
    raw = (tmp_path / "in" / "broken.zip").read_bytes()
    (tmp_path / "in" / "broken.zip").write_bytes(raw.replace(b"second" * 3, b"sEcond" * 3))
    refused = archives.ingest_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {Path(r.archive).name: r.reason for r in refused.collect()} == {f"{n}.zip": n for n in ("parent", "absolute", "drive", "repeated", "not_an_archive", "broken")}
    assert {(Path(r.archive).name, r.member, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("ok.zip", "a/b.txt", b"a/b.txt" * 3), ("ok.zip", "c", b"ccc")}
    with pytest.raises(AnalysisException):
        archives.ingest_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    with_null = archives.members(spark.createDataFrame([(None, None), (1, bytearray(b""))], "k long, c binary"), "k", "c")
    assert {r.reason for r in with_null.collect()} == {"not_an_archive"} and archives.taken_and_refused(with_null)[0].count() == 0


def test_quality_rules_stop_and_take_what_is_there(spark):
    rows = [(1, "a", "b", True, True, 0, 10.0, "light"), (2, "a", "a", False, True, 9, 10.0, "light"), (3, "a", "a", True, False, 1, 10.0, "green"), (4, None, "a", None, None, None, None, None), (5, "a", "a", True, True, 8, 128.0, "odd")]
    df = spark.createDataFrame(rows, "k int, md5 string, md5_actual string, decoded boolean, roi_fits boolean, orientation int, view_short double, label string")
    got = {r.k: (r.flags, r.hard_exclude) for r in quality.judged(df).collect()}
    assert got == {
        1: (["manifest_hash_mismatch", "exif_orientation_invalid", "low_resolution"], False), 2: (["exif_orientation_invalid", "decode_failed"], True), 3: (["roi_invalid"], True), 4: ([], False), 5: (["unknown_label"], False),
    }
    more = spark.createDataFrame([(["field_count"], "mixed", "dark", "Maw|Raw", 35.0, 0.2, True, "full", 0.4, False, 0.2, 0.15, "x")], "annotation_faults array<string>, label string, annotation_label string, label_orig string, mean_quantizer double, bytes_per_pixel double, white_balanced boolean, mode string, selected_inside_boxes double, boxes_white_balanced boolean, black_clipped double, white_clipped double, pipeline_error string")
    assert quality.judged(more).first().flags == ["field_count", "label_annotation_mismatch", "non_target_mixed", "ambiguous_maw", "compression_review", "pipeline_full_fallback", "pipeline_background_selection", "wb_train_pipeline_mismatch", "black_clipping_review", "pipeline_diagnostic_error"]


def test_parts_without_estimated_are_read(spark, tmp_path):
    old = ", ".join(c for c in market.PREDICTIONS.split(", ") if not c.startswith("estimated"))
    result = '{"status":"ok","label":"light","n_beans":3,"counts":{"light":2,"medium":1,"dark":0}}'
    spark.createDataFrame([(0, "m0", "2024-01-01T00:00:00", "ok", "light", 0.9, "m", result)], old).write.parquet(str(tmp_path / "predictions" / "batch=0"))
    spark.createDataFrame([(1, "m1", "2024-01-01T00:00:01", "ok", "light", 0.9, "m", result, 1)], market.PREDICTIONS).write.parquet(str(tmp_path / "predictions" / "batch=1"))
    stored = market.read_predictions(spark, str(tmp_path))
    assert sorted((r.msg_id, r.estimated) for r in stored.collect()) == [("m0", 0), ("m1", 1)]
    assert [(r.ingest_seq, r.estimated) for r in market.newest(stored, 5).collect()] == [(1, True), (0, False)]
    total = market.totals(stored).first()
    assert (total.light, total.medium, total.estimated, total.results) == (4, 2, 1, 2)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1.0}), (2, None, None)], "k int, l array<int>, m map<string,double>")
    sinks.write_csv(df, str(tmp_path / "c"), once=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).where("k = 1").first().l == "[1,2]"
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "c"), once=True)
    with pytest.raises(Exception, match="finite"):
        sinks.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "j"))
    sinks.dump_once(str(tmp_path / "plan.json"), {"a": 1})
    sinks.dump_once(str(tmp_path / "plan.json"), {"a": 1})
    with pytest.raises(ValueError):
        sinks.dump_once(str(tmp_path / "plan.json"), {"a": 2})


def test_refill(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    cache = spark.createDataFrame([(1, 10)], "k long, v long")
    full = manifest.refill(cache, rows, "k", lambda d: d.withColumn("v", F.col("k") * 10))
    assert sorted((r.k, r.v) for r in full.collect()) == [(1, 10), (2, 20), (3, 30)]
    with pytest.raises(ValueError):
        manifest.refill(cache, rows, "k", lambda d: d.withColumn("v", F.col("k")).where("k < 3"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_llm_and_pipeline(tmp_path):
    """In a copy without both: the entry imports and has the library's own queries."""
    shutil.copytree(ROOT / "tallyframe", tmp_path / "tallyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, tallyframe.catalog as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLES)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
    (tmp_path / "tallyframe" / "llm").mkdir()
    (tmp_path / "tallyframe" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tallyframe" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, stderr=subprocess.DEVNULL).returncode != 0  # broken is not absent


def test_paths(spark):
    df = spark.createDataFrame([("1,2,3.5,4",), ("1,2,3",), ("a,b,c,d",), ("1,2,0,4",), (None,)], "t string")
    assert [r.r for r in df.select(P.parse_roi(F.col("t"), F.lit(1.0), F.lit(2.5)).alias("r")).collect()] == [[1, 5, 4, 10], None, None, None, None]
    q = E.clean_proportions([F.lit(1 / 3)] * 3)
    assert [round(x, 4) for x in spark.range(1).select(*q).first()] == [0.3334, 0.3333, 0.3333]


# ---------------------------------------------------------------- single results


def test_variants(spark):
    from tallyframe.functions.results import resolved_variants

    nan = float("nan")
    cards = [("good", "image_prior", 0.5, "a"), ("none", None, 0.25, None), ("odd", None, None, "a"), ("group", "group", 0.5, "a"), ("late", "image_prior", 0.6, "a"), ("lost", "image_prior", 0.5, None)]
    own = [("a", "x", 0.5), ("b_2", "y", 1.0)]
    told = [(c, *v) for c in ("good", "group", "late", "lost") for v in own]
    for name, extra in (("é", ("é", "x", 1.0)), ("__", ("__", "x", 1.0)), ("long", ("c" * 33, "x", 1.0)), ("label", ("c", None, 1.0)), ("below", ("c", "x", -1.0)), ("nan", ("c", "x", nan)), ("null", ("c", "x", None)), ("twice", ("a", "x", 0.5))):
        cards.append((name, "image_prior", 0.5, "a"))
        told += [(name, *v) for v in (*own, extra)]
    asked = [("good", None), ("good", "b_2"), ("good", "b_2"), ("good", "zz"), ("none", None), ("none", "a"), ("nowhere", None), *[(c[0], None) for c in cards[2:]]]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = resolved_variants(df(cards, "card string, mode string, prior_weight double, default_variant string"), df(told, "card string, variant string, label string, prior_weight double"), df(asked, "card string, requested string"))
    got = sorted((r.card, r.requested or "", r.chosen, r.prior_weight, r.fault) for r in out.collect())
    want = [("good", "", "a", 0.5, None), ("good", "b_2", "b_2", 1.0, None), ("good", "b_2", "b_2", 1.0, None), ("good", "zz", None, None, "unknown"), ("none", "", None, 0.25, None), ("none", "a", None, None, "undeclared"), ("nowhere", "", None, None, "no_card")]
    want += [(c, "", None, None, f) for c, f in (("odd", "undeclared"), ("group", "mode"), ("late", "default"), ("lost", "default"))] + [(c[0], "", None, None, "malformed") for c in cards[6:]]
    assert got == sorted(want)


def test_gate_directions_and_unmeasured(spark):
    from tallyframe.functions.results import gate

    df = spark.createDataFrame([(0.5, 0.4, 0.6), (0.5, 0.5, 0.6), (0.4, None, None), (None, 0.1, 0.2)], "v double, lo double, hi double")
    g = lambda up: [tuple(r.g) for r in df.select(gate(F.col("v"), F.col("lo"), F.col("hi"), 0.45, up).alias("g")).collect()]
    assert g(True) == [(True, True), (True, False), (False, False), (None, True)]
    assert g(False) == [(False, True), (False, True), (True, False), (None, False)]


def test_half_open_bins_compare_borders(spark):
    df = spark.createDataFrame([(0.3, True), (0.29999999999999999, False), (1.0, True), (0.7, True)], "c double, ok boolean")
    assert M.half_open_error(df, F.col("ok"), F.col("c")).first().ece == pytest.approx((2 * 0.2 + 0.3 + 0) / 4)
