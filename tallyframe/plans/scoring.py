"""Queries on scoring: embeddings stand for feature vectors, their label for the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.operators import scoring as S

CLASSES = ("light", "medium", "dark")
#: Parameters of the scored models: weights by class over all components of an embedding, from a rule.
W = [[((7 * i + 5 * k) % 11 - 5) / 4 for i in range(64)] for k in range(3)]
BIAS = (0.1, 0.0, -0.1)


def logits(t):
    z = [(F.lit(b) + S.dot_array(F.col("embedding"), w)).alias(f"z{k}") for k, (w, b) in enumerate(zip(W, BIAS, strict=True))]
    truth = F.when(F.col("label") % 3 == 0, "light").when(F.col("label") % 3 == 1, "medium").otherwise("dark")
    return t("embeddings").select("vec_id", "label", truth.alias("truth"), *z)


_Z = ", ".join(f"{b}::DOUBLE + list_sum(list_transform(list_zip(embedding, {w}::DOUBLE[]), lambda p: p[1]::DOUBLE * p[2])) AS z{k}" for k, (w, b) in enumerate(zip(W, BIAS)))
_L = f"z AS (SELECT vec_id, label, CASE label % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'medium' ELSE 'dark' END AS truth, {_Z} FROM embeddings)"
_P = f"{_L}, e AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM z), p AS (SELECT vec_id, label, truth, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM e)"
_ARG = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'light' WHEN p1 >= p2 THEN 'medium' ELSE 'dark' END"


def probs(t):
    p = S.softmax([F.col(f"z{k}") for k in range(3)])
    return logits(t).select("vec_id", "label", "truth", *[c.alias(f"p{k}") for k, c in enumerate(p)])


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("q_threshold_score", "SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'dark' WHEN p_retailprice < 1500 THEN 'medium' ELSE 'light' END AS label FROM part")
def threshold_score(t, spark):
    """M01."""
    return t("part").select("p_partkey", S.ordinal(F.col("p_retailprice"), 1000, 1500, ("dark", "medium", "light")).alias("label"))


@query("q_softmax_score", f"WITH {_P} SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, {_ARG} AS label FROM p")
def softmax_score(t, spark):
    """M03, P07, M14."""
    q = [F.col(f"p{k}") for k in range(3)]
    return probs(t).select("vec_id", *_r("p0", "p1", "p2"), S.argmax(q, list(CLASSES)).alias("label"))


@query("q_status_threshold", f"WITH {_P} SELECT vec_id, CASE WHEN greatest(p0, p1, p2) >= 0.4 THEN 'ok' ELSE 'low_confidence' END AS status FROM p")
def status_threshold(t, spark):
    """On the unrounded confidence."""
    return probs(t).select("vec_id", F.when(F.greatest("p0", "p1", "p2") >= 0.4, "ok").otherwise("low_confidence").alias("status"))


_PRIOR = """m AS (SELECT label, count(*) FILTER (WHERE truth = 'light') / count(*) AS m0, count(*) FILTER (WHERE truth = 'medium') / count(*) AS m1, count(*) FILTER (WHERE truth = 'dark') / count(*) AS m2 FROM p GROUP BY label),
f AS (SELECT vec_id, p0 * power(greatest(m0, 1e-9), 0.3) AS a, p1 * power(greatest(m1, 1e-9), 0.3) AS b, p2 * power(greatest(m2, 1e-9), 0.3) AS c FROM p JOIN m USING (label))"""


@query("q_prior_fusion", f"WITH {_P}, {_PRIOR} SELECT vec_id, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM f")
def prior_fusion(t, spark):
    """The prior of a row is its label's share of each class; most shares are 0."""
    p = probs(t)
    shares = p.groupBy("label").agg(*[F.avg((F.col("truth") == c).cast("double")).alias(f"m{k}") for k, c in enumerate(CLASSES)])
    q = S.prior_fusion([F.col(f"p{k}") for k in range(3)], [F.col(f"m{k}") for k in range(3)], 0.3)
    return p.join(shares, "label").select("vec_id", *[F.round(c, 6).alias(f"p{k}") for k, c in enumerate(q)])


@query("q_ensemble", f"WITH {_P} SELECT vec_id, round((p0 + p1) / 2, 6) AS p0, round((p1 + p2) / 2, 6) AS p1, round((p2 + p0) / 2, 6) AS p2 FROM p")
def ensemble(t, spark):
    """The equal-weight mean of two models' probabilities, joined by key."""
    a = probs(t).select("vec_id", "p0", "p1", "p2")
    b = a.select("vec_id", F.col("p1").alias("q0"), F.col("p2").alias("q1"), F.col("p0").alias("q2"))
    return a.join(b, "vec_id").select("vec_id", *[F.round((F.col(f"p{k}") + F.col(f"q{k}")) / 2, 6).alias(f"p{k}") for k in range(3)])


@query("q_geometric_pool", f"""WITH {_P}, v AS (SELECT label, vec_id % 3 AS w, p0 AS a, p1 / 2 AS b, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE p2 END AS c FROM p),
g AS (SELECT label, {', '.join(f'sum(w * ln(greatest({x} / (a + b + c), 1e-12))) / sum(w) AS g{k}' for k, x in enumerate('abc'))} FROM v GROUP BY label)
SELECT label, {', '.join(f'round(exp(g{k}) / (exp(g0) + exp(g1) + exp(g2)), 6) AS p{k}' for k in range(3))} FROM g""")
def geometric_pool(t, spark):
    """Views that do not sum to one, some with a class ruled out, some of weight 0."""
    views = probs(t).select("label", "p0", (F.col("p1") / 2).alias("p1"), F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(F.col("p2")).alias("p2"), (F.col("vec_id") % 3).alias("w"))
    return S.geometric_pool(views, ["label"], ["p0", "p1", "p2"], "w").select("label", *_r("p0", "p1", "p2"))


GRID = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
_T = " UNION ALL ".join(
    f"SELECT {g}::DOUBLE AS temperature, round(avg(-ln(greatest(CASE truth WHEN 'light' THEN exp(z0 / {g}) WHEN 'medium' THEN exp(z1 / {g}) ELSE exp(z2 / {g}) END / (exp(z0 / {g}) + exp(z1 / {g}) + exp(z2 / {g})), 1e-15))), 9) AS nll FROM z" for g in GRID
)


@query("q_temperature", f"WITH {_L}, g AS ({_T}) SELECT temperature, round(nll, 6) AS nll FROM g ORDER BY g.nll, abs(temperature - 1), temperature LIMIT 1")
def temperature(t, spark):
    """M07."""
    return S.choose_temperature(logits(t), ["z0", "z1", "z2"], "truth", list(CLASSES), GRID).select("temperature", F.round("nll", 6).alias("nll"))


@query("q_fit_thresholds", """WITH d AS (SELECT p_size::DOUBLE AS x, CASE WHEN p_size < 15 THEN 0 WHEN p_size < 35 THEN 1 ELSE 2 END AS y FROM part),
c AS (SELECT DISTINCT unnest(quantile_cont(x, list_transform(range(1, 100), lambda i: i / 100))) AS t FROM d),
h AS (SELECT x, y, count(*) AS n FROM d GROUP BY ALL), k AS (SELECT a.t AS low, b.t AS high FROM c a JOIN c b ON a.t <= b.t),
s AS (SELECT low, high, y, CASE WHEN x < low THEN 0 WHEN x < high THEN 1 ELSE 2 END AS p, sum(n) AS n FROM k, h GROUP BY ALL),
f AS (SELECT low, high, v.c, 2 * coalesce(sum(n) FILTER (WHERE y = v.c AND p = v.c), 0) AS hits, coalesce(sum(n) FILTER (WHERE y = v.c), 0) + coalesce(sum(n) FILTER (WHERE p = v.c), 0) AS seen FROM s, (VALUES (0), (1), (2)) v(c) GROUP BY ALL),
m AS (SELECT low, high, round(sum(CASE WHEN seen > 0 THEN hits / seen ELSE 0 END) / 3, 9) AS macro_f1 FROM f GROUP BY ALL)
SELECT low, high, macro_f1 FROM m ORDER BY macro_f1 DESC, low, high LIMIT 1""")
def fit_thresholds(t, spark):
    """An exhaustive search over pairs of percentiles, equal ones too."""
    truth = F.when(F.col("p_size") < 15, "dark").when(F.col("p_size") < 35, "medium").otherwise("light")
    return S.fit_thresholds(t("part").select(F.col("p_size").cast("double").alias("x"), truth.alias("truth")), "x", "truth", ("dark", "medium", "light")).withColumn("macro_f1", F.round("macro_f1", 9))


@query("q_registered_scorer", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN p_retailprice < 1000 THEN 'dark' WHEN p_retailprice < 1500 THEN 'medium' ELSE 'light' END AS label FROM part) GROUP BY ALL")
def registered(t, spark):
    """§2.14: scorers by name."""
    return S.scorer("ordinal_price")(t("part")).groupBy("label").agg(F.count("*").alias("n"))


S.register_scorer("ordinal_price", lambda df: df.select(S.ordinal(F.col("p_retailprice"), 1000, 1500, ("dark", "medium", "light")).alias("label")))


@query("q_nested_select", """WITH s AS (SELECT o_orderpriority AS fold, o_orderkey % 4 AS c, round(avg((o_orderstatus = 'F')::INT), 4) AS score FROM orders GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, c) AS rn FROM s) SELECT fold, c, score FROM b WHERE rn = 1""")
def nested_select(t, spark):
    """The best parameter within each fold."""
    s = t("orders").groupBy(F.col("o_orderpriority").alias("fold"), (F.col("o_orderkey") % 4).alias("c")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 4).alias("score"))
    return s.groupBy("fold").agg(F.min(F.struct(-F.col("score"), "c")).alias("b")).select("fold", F.col("b.c").alias("c"), (-F.col("b.col1")).alias("score"))
