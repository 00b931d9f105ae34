"""Exact percentiles by selection, threshold fits and the writers' and scorers' refusals."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import events as E
from tallyframe.operators import metrics as M
from tallyframe.operators import scoring as S
from tallyframe.operators import selection
from tallyframe.sources import sinks

SHARES = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0]


def measured(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g, n in ((None, 1), ("a", 2), ("b", 900), ("c", 6000)):
        for _ in range(n):
            x = rng.choice([rng.standard_normal(), float(rng.integers(0, 3)), 10.0 ** rng.integers(-200, 200)])
            rows.append((g, float(x), None if g == "a" else float(rng.integers(0, 2))))
    rows += [("d", None, None)] * 3
    return rows, spark.createDataFrame(rows, "g string, x double, y double").repartition(4)


@pytest.mark.parametrize("few", [20_000, 40])
def test_percentiles_of_groups_equal_numpy(spark, monkeypatch, few):
    """Wide ranges, many ties, a null key, null values; brackets are narrowed in passes where few is small."""
    monkeypatch.setattr(selection, "FEW", few)
    rows, df = measured(spark)
    narrowed, real = [], selection._narrowed
    monkeypatch.setattr(selection, "_narrowed", lambda *a: narrowed.append(1) or real(*a))
    got = {r["_key"].g: r for r in selection.percentiles(df, ["g"], {"x": "x", "y": F.col("y") * 2}, SHARES).collect()}
    assert bool(narrowed) == (few < 100) and set(got) == {None, "a", "b", "c"}
    for g, (name, at, times) in itertools.product(got, (("x", 1, 1), ("y", 2, 2))):
        v = [r[at] * times for r in rows if r[0] == g and r[at] is not None]
        assert got[g][name] == (pytest.approx(np.percentile(v, [100 * s for s in SHARES]), rel=1e-12) if v else None)


def test_percentiles_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,)], "x double")
    whole = df.agg(F.count("*").alias("n"))
    q = selection.with_percentiles(whole, df, [], {"q": "x"}, [0.0, 0.5, 1.0]).first()
    assert q.n == 3 and q.q[:2] == [1.0, 3.0] and math.isnan(q.q[2])
    assert selection.with_percentiles(df.limit(0).agg(F.count("*").alias("n")), df.limit(0), [], {"q": "x"}, [0.5]).first().asDict() == {"n": 0, "q": None}
    with pytest.raises(ValueError):
        selection.percentiles(df, [], {"q": "x"}, [1.5])


def plain_thresholds(v, y, classes):
    best = (-1.0, None, None)
    cuts = np.unique(np.percentile(v, range(1, 100)))
    for a, b in itertools.combinations_with_replacement(cuts, 2):
        said = [classes[0] if x < a else classes[1] if x < b else classes[2] for x in v]
        f = []
        for c in classes:
            hit, n = sum(s == c == t for s, t in zip(said, y, strict=True)), said.count(c) + y.count(c)
            f.append(2 * hit / n if n else 0.0)
        if sum(f) / 3 > best[0] + 1e-12:
            best = (sum(f) / 3, a, b)
    return best


def test_thresholds_may_be_equal(spark):
    classes = ("dark", "medium", "light")
    for v, y in (([4.0], ["light"]), ([float(i) for i in range(101)], ["dark"] * 50 + ["light"] * 51), ([1.0, 2, 2, 3, 5, 8, 9], ["dark", "medium", "dark", "medium", "light", "light", "medium"])):
        df = spark.createDataFrame([(float(a), b) for a, b in zip(v, y, strict=True)], "x double, y string")
        r = S.fit_thresholds(df, "x", "y", classes).first()
        f1, low, high = plain_thresholds(v, y, classes)
        assert (r.low, r.high) == (pytest.approx(low), pytest.approx(high)) and r.macro_f1 == pytest.approx(f1)


def test_clean_proportions_of_odd_shares(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, 1.0, 1.0), (inf, 1.0, 1.0), (-inf, 1.0, 0.0), (None, None, None), (0.0, -1.0, nan), (1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [tuple(r) for r in df.select(*E.clean_proportions([F.col(x) for x in "abc"])).collect()]
    assert got == [(0, 0.5, 0.5), (None,) * 3, (0, 1, 0), (None,) * 3, (None,) * 3, (0.3334, 0.3333, 0.3333)]


def test_fusion_and_pooling_refuse_bad_weights(spark):
    one = F.lit(1.0)
    for w in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            S.prior_fusion([one], [one], w)
    df = spark.createDataFrame([(1, 0.2, 0.8, 0.0, 1.0), (1, 2.0, 2.0, 4.0, 3.0)], "k int, a double, b double, c double, w double")
    got = S.geometric_pool(df, ["k"], ["a", "b", "c"], "w").first()
    p = np.array([[0.2, 0.8, 1e-12], [0.25, 0.25, 0.5]])
    want = np.exp((np.log(p) * np.array([[1], [3]])).sum(0) / 4)
    assert tuple(got)[1:] == pytest.approx(want / want.sum())
    for bad in ((1, 0.2, 0.8, 0.0, -1.0), (1, -0.2, 0.8, 0.0, 1.0), (1, 0.0, 0.0, 0.0, 1.0), (1, float("nan"), 0.8, 0.0, 1.0), (1, 0.2, 0.8, 0.0, 0.0)):
        with pytest.raises(Exception, match="pooled"):
            S.geometric_pool(spark.createDataFrame([bad], df.schema), ["k"], ["a", "b", "c"], "w").collect()


def test_strict_json_looks_inside(spark, tmp_path):
    good = spark.createDataFrame([(1, [0.5, None], {"a": 1.0}, (2.0, [(1.0,)])), (2, None, None, None)], "i int, a array<double>, m map<string,double>, s struct<x:float,l:array<struct<y:double>>>")
    sinks.write_json(good, str(tmp_path / "good"))
    assert spark.read.json(str(tmp_path / "good")).count() == 2
    nan, inf = float("nan"), float("inf")
    for i, bad in enumerate([(1, [nan], None, None), (1, None, {"a": inf}, None), (1, None, None, (-inf, None)), (1, None, None, (1.0, [(nan,)]))]):
        with pytest.raises(Exception, match="not finite"):
            sinks.write_json(spark.createDataFrame([bad], good.schema), str(tmp_path / f"bad{i}"))


def test_published_members_keep_their_types(spark):
    text = '{"confidence":1.0,"n":1,"id":"1","none":null,"on":true,"beans":[{"label":"x"}],"deep":{"beans":[1.0,"a\\"b"]}}'
    df = spark.createDataFrame([(text,)], "j string")
    compact, older = df.select(E.published(F.col("j")), E.published(F.col("j"), compact=False)).first()
    assert compact == '{"confidence":1.0,"n":1,"id":"1","none":null,"on":true,"deep":{"beans":[1.0,"a\\"b"]}}'
    assert older == text.replace('[{"label":"x"}]', "[]")


def test_bootstrap_does_not_hang_on_the_layout(spark):
    df = spark.range(500).select("id", (F.col("id") % 37).cast("double").alias("v"))
    a, b = (M.bootstrap_mean(x, "v", "id", 50).first() for x in (df.coalesce(1), df.repartition(7)))
    assert (a.low, a.high) == (pytest.approx(b.low), pytest.approx(b.high))


def optimized(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_on_results_parse_each_text_once(spark):
    """the parsed text and what the rules ask of it are columns, not copies in each rule."""
    from tallyframe.functions import results as R

    good = '{"status":"ok","label":"light","label_th":"x","message_th":"m","model":"b","confidence":0.9,"probs":{"light":0.9,"medium":0.05,"dark":0.05},"warnings":[],"n_beans":1,"proportions":{"light":1.0,"medium":0,"dark":0},"beans":[{"bbox":[0,0,2,2],"label":"light"}],"timing_ms":{"decode":1,"ml":1,"total":2},"schema_version":3,"counts":{"light":1,"medium":0,"dark":0},"count_method":"exact","image_size":[9,9]}'
    texts = [good, good.replace("[0,0,2,2]", "[0,0,2]"), good.replace("[0,0,2,2]", "[8,0,2,2]"), good.replace('"n_beans":1', '"n_beans":1.0'), good.replace('"status":"ok"', '"status":"error"'), "[1]", "{", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, result string")
    told = R.with_violations(df, "result")
    assert optimized(told).count("parseJson") == 1 and told.columns == ["i", "result", "violations"]
    got = {r.i: r.violations for r in told.collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4)] == [[], ["box_outside"], ["box_outside"], ["count_total"], ["failed_with_values"]]
    assert got[5][:3] == ["key_set", "status", "timings"] and got[6] == ["json"] and got[7] == ["json"]


def test_events_are_judged_on_members(spark):
    """One parse, and no object is written as text again to learn its keys."""
    from tallyframe.plans.events import payloads

    plan = optimized(E.validated(payloads(lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")), "payload"))
    assert plan.count("parseJson") == 1 and "json_object_keys" not in plan and "to_json" not in plan


def test_totals_and_newest_parse_each_stored_text_once_a_step(spark):
    """one scan, and a filter on what is added stays above the columns it is told from."""
    from tallyframe.plans import sequential as plans
    from tallyframe.streaming import market

    stored = plans.stored(lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet"))
    plain = optimized(stored).count("parseJson")
    for df in (market.totals(stored), market.newest(stored, 5)):
        plan = optimized(df)
        assert plan.count("parseJson") <= plain + 2 and plan.count("Relation [") == 1


def test_published_parses_each_text_once(spark):
    """two maps of one text, and neither for each member anew."""
    df = spark.createDataFrame([('{"a":"x]\\"[","beans":[1],"b":1.0,"c":null,"d":"]"}',), ("[1]",), (None,)], "j string")
    for compact, want in ((True, '{"a":"x]\\"[","b":1.0,"c":null,"d":"]"}'), (False, '{"a":"x]\\"[","beans":[],"b":1.0,"c":null,"d":"]"}')):
        told = df.select(E.published(F.col("j"), compact).alias("p"))
        assert optimized(told).count("from_json") == 2
        assert told.first()["p"] == want


def test_no_row_costs_a_logarithm(spark):
    """the terms of a model are told once for it, one smoothing to a row's code."""
    from tallyframe.operators import folds

    models = spark.createDataFrame([(1, [(4.0, [8.0], [20.0]), (0.0, [0.0], [0.0])])], "g int, model array<struct<n:double,s:array<double>,ss:array<double>>>")
    terms = folds._for_choices(models, [0.5, 2.0], ["a"], ["A", "B"])
    assert sorted((r.choice, r._t0_m0, r._t0_v0, r._t1_p, r._t1_m0) for r in terms.collect()) == [(0.5, 2.0, 1.5, -math.inf, None), (2.0, 2.0, 3.0, -math.inf, None)]
    rows = spark.createDataFrame([(1.0, 0.0, 2.0, 1.5, 0.4, -math.inf, None, None, None)], "a double, _t0_p double, _t0_m0 double, _t0_v0 double, _t0_l0 double, _t1_p double, _t1_m0 double, _t1_v0 double, _t1_l0 double")
    said = folds._with_said(rows, ["a"], ["A", "B"])
    assert said.first().said == "A" and not any(x in optimized(said).lower() for x in ("log(", "ln("))
