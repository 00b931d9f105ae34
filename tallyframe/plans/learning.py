"""Queries on fitting: a forest, and nested evaluation by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.operators import forest, models, network
from tallyframe.operators.folds import leave_one_out_sweep, nested_leave_one_out, within_source_probe

CLASSES = ["A", "N", "R"]
GRID = [0.01, 1.0, 100.0]


def shipped(t):
    """Lines with their class and the day they were shipped, in hundreds since 1992."""
    days = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) / 100
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", days.alias("days"), (F.col("l_quantity") / 10).alias("quantity"), "l_discount", "l_tax", "l_extendedprice")


_LL = " - ".join(f"(ln(greatest({q} / n - power({s} / n, 2), 0) + c) + power({x} - {s} / n, 2) / (greatest({q} / n - power({s} / n, 2), 0) + c)) / 2" for x, s, q in (("a", "sa", "qa"), ("b", "sb", "qb")))


def _f1(source: str) -> str:
    each = lambda y: f"sum(n) FILTER (WHERE truth = '{y}' AND said = '{y}') AS h{y}, sum(n) FILTER (WHERE truth = '{y}') AS t{y}, coalesce(sum(n) FILTER (WHERE said = '{y}'), 0) AS s{y}"
    share = lambda y: f"coalesce(2 * coalesce(h{y}, 0) / (t{y} + s{y}), 0)"
    present = " + ".join(f"(t{y} IS NOT NULL)::INT" for y in CLASSES)
    return f"SELECT * EXCLUDE (nn, hits), nn AS rows, hits / nn AS acc, ({' + '.join(map(share, CLASSES))}) / ({present}) AS f FROM (SELECT held, c, sum(n) AS nn, coalesce(sum(n) FILTER (WHERE truth = said), 0) AS hits, {', '.join(map(each, CLASSES))} FROM {source} GROUP BY held, c)"


@query("q_nested_leave_one_out", f"""WITH r AS (SELECT row_number() OVER () AS id, l_linenumber AS source, (('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 3)::INT AS k, l_returnflag AS truth,
date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 100 AS a, l_quantity / 10 AS b, l_discount < 0.09 AS u FROM lineitem),
g AS (SELECT unnest({GRID}::DOUBLE[]) AS c), h AS (SELECT DISTINCT source AS held FROM r), i AS (SELECT unnest(range(3)) AS k),
m AS (SELECT held, i.k, truth AS said, count(*) AS n, sum(a) AS sa, sum(a * a) AS qa, sum(b) AS sb, sum(b * b) AS qb FROM r, h, i WHERE u AND source <> held AND r.k <> i.k GROUP BY ALL),
v AS (SELECT held, c, id, truth, said, row_number() OVER (PARTITION BY held, c, id ORDER BY ln(n) - {_LL} DESC, said) AS rn FROM r JOIN m ON r.k = m.k AND source <> held, g WHERE u),
vc AS (SELECT held, c, truth, said, count(*) AS n FROM v WHERE rn = 1 GROUP BY ALL), vf AS ({_f1("vc")}), best AS (SELECT held, c, f AS inner_f1 FROM vf QUALIFY row_number() OVER (PARTITION BY held ORDER BY round(f, 9) DESC, c) = 1),
o AS (SELECT held, truth AS said, count(*) AS n, sum(a) AS sa, sum(a * a) AS qa, sum(b) AS sb, sum(b * b) AS qb FROM r, h WHERE u AND source <> held GROUP BY ALL),
w AS (SELECT held, c, id, truth, said, row_number() OVER (PARTITION BY id ORDER BY ln(n) - {_LL} DESC, said) AS rn FROM r JOIN best ON source = held JOIN o USING (held)),
wc AS (SELECT held, c, truth, said, count(*) AS n FROM w WHERE rn = 1 GROUP BY ALL), wf AS ({_f1("wc")}), s AS (SELECT held, sum(n)::BIGINT AS train FROM o GROUP BY held)
SELECT held AS fold, train, rows::BIGINT AS test, c AS choice, round(inner_f1, 6) AS inner_f1, round(acc, 6) AS acc, round(f, 6) AS macro_f1 FROM wf JOIN best USING (held, c) JOIN s USING (held)""")
def nested(t, spark):
    """Each line number is a source and each order a group; the smoothing is chosen inside."""
    out = nested_leave_one_out(shipped(t), "l_linenumber", F.col("l_orderkey"), "l_returnflag", CLASSES, ["days", "quantity"], GRID, 3, F.col("l_discount") < 0.09)
    return out.select("fold", "train", "test", "choice", *[F.round(c, 6).alias(c) for c in ("inner_f1", "acc", "macro_f1")])


@query("q_forest_fit")
def forest_fit(t, spark):
    """A forest fitted on all lines and what it says of them, counted; the tests grow the same trees in a loop."""
    rows = shipped(t)
    features = ["days", "quantity", "l_discount", "l_tax"]
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    spec = forest.fit_forest(rows, features, "l_returnflag", CLASSES, key, forest.ForestShape(trees=8, depth=4, bins=16, tried=2))
    told = models.score_model(rows.select("l_returnflag", *features), spec)
    return told.groupBy(F.col("l_returnflag").alias("truth"), F.col("label_pred").alias("said")).agg(F.count("*").alias("n"))


@query("q_softmax_fit")
def softmax_fit(t, spark):
    """A softmax fitted on all lines, each weighed by its quantity, and what it says of them, counted; the tests hold
    the gradient of such a fit against zero."""
    rows, features = shipped(t), ["days", "l_discount", "l_tax"]
    spec = models.fit_softmax(rows, features, "l_returnflag", CLASSES, c=1.0, weight="quantity")
    told = models.score_model(rows.select("l_returnflag", *features), spec)
    return told.groupBy(F.col("l_returnflag").alias("truth"), F.col("label_pred").alias("said")).agg(F.count("*").alias("n"))


@query("q_mlp_fit")
def mlp_fit(t, spark):
    """A small network fitted on all lines and what it says of them, counted; the tests run the same steps in
    a plain loop."""
    rows, features = shipped(t), ["days", "quantity", "l_discount", "l_tax"]
    spec, _ = network.fit_mlp(rows, features, "l_returnflag", CLASSES, hidden=8, epochs=12, rate=0.05)
    told = models.score_model(rows.select("l_returnflag", *features), spec)
    return told.groupBy(F.col("l_returnflag").alias("truth"), F.col("label_pred").alias("said")).agg(F.count("*").alias("n"))


BELOW = [0.0001, 0.001]


@query("q_sweep", f"""WITH r AS (SELECT row_number() OVER () AS id, l_linenumber AS source, l_returnflag AS truth, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 100 AS a, l_quantity / 10 AS b FROM lineitem),
g AS (SELECT unnest({GRID + BELOW}::DOUBLE[]) AS c), h AS (SELECT DISTINCT source AS held FROM r),
o AS (SELECT held, truth AS said, count(*) AS n, sum(a) AS sa, sum(a * a) AS qa, sum(b) AS sb, sum(b * b) AS qb FROM r, h WHERE source <> held GROUP BY ALL),
w AS (SELECT held, c, id, truth, said, row_number() OVER (PARTITION BY c, id ORDER BY ln(n) - {_LL} DESC, said) AS rn FROM r JOIN o ON source = held, g),
wc AS (SELECT held, c, truth, said, count(*) AS n FROM w WHERE rn = 1 GROUP BY ALL), pc AS (SELECT 0 AS held, c, truth, said, n FROM wc), f AS ({_f1("wc")}), p AS ({_f1("pc")}),
m AS (SELECT c, avg(f) AS mean_f1, min(f) AS worst_f1 FROM f GROUP BY c), x AS (SELECT m.c AS choice, mean_f1, worst_f1, p.f AS pooled_f1 FROM m JOIN p USING (c)),
e AS (SELECT (SELECT choice FROM x WHERE choice IN {tuple(GRID)} ORDER BY round(mean_f1, 9) DESC, choice LIMIT 1) = {min(GRID)} AS extended)
SELECT choice, round(mean_f1, 6) AS mean_f1, round(worst_f1, 6) AS worst_f1, round(pooled_f1, 6) AS pooled_f1, extended, row_number() OVER (ORDER BY round(mean_f1, 9) DESC, choice) = 1 AS best FROM x, e WHERE extended OR choice IN {tuple(GRID)}""")
def sweep(t, spark):
    """The smoothings of the grid, and below it if the best is at its lower end."""
    out = leave_one_out_sweep(shipped(t), "l_linenumber", "l_returnflag", CLASSES, ["days", "quantity"], GRID, BELOW)
    return out.select("choice", *[F.round(c, 6).alias(c) for c in ("mean_f1", "worst_f1", "pooled_f1")], "extended", "best")


@query("q_shortcut_probe", f"""WITH r AS (SELECT row_number() OVER () AS id, l_linenumber AS source, l_suppkey::VARCHAR AS g, (('0x' || substr(md5(l_suppkey::VARCHAR), 1, 8))::BIGINT % 3)::INT AS k, l_returnflag AS truth,
date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 100 AS a, l_quantity / 10 AS b FROM lineitem), i AS (SELECT unnest(range(3)) AS k), d AS (SELECT unnest(range(11)) AS d), e AS (SELECT 0.01::DOUBLE AS c),
gl AS (SELECT source, g, truth AS y FROM r GROUP BY source, g, truth QUALIFY row_number() OVER (PARTITION BY source, g ORDER BY count(*) DESC, truth) = 1),
sh AS (SELECT source, count(*) AS groups, count(*) FILTER (WHERE y = 'A') AS ca, count(*) FILTER (WHERE y = 'N') AS cn FROM gl GROUP BY source),
u AS (SELECT source, g, d, ('0x' || substr(md5(concat_ws(':', 7, d, source, g)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * groups AS u, ca, cn FROM gl JOIN sh USING (source), d),
x AS (SELECT id, source, k, d, CASE WHEN d = 0 THEN truth WHEN u < ca THEN 'A' WHEN u < ca + cn THEN 'N' ELSE 'R' END AS truth, a, b FROM r JOIN u USING (source, g)),
m AS (SELECT source, d, i.k, truth AS said, count(*) AS n, sum(a) AS sa, sum(a * a) AS qa, sum(b) AS sb, sum(b * b) AS qb FROM x, i WHERE x.k <> i.k GROUP BY ALL),
v AS (SELECT source, d, id, truth, said, row_number() OVER (PARTITION BY source, d, id ORDER BY ln(n) - {_LL} DESC, said) AS rn FROM x JOIN m USING (source, d, k), e),
vc AS (SELECT source AS held, d AS c, truth, said, count(*) AS n FROM v WHERE rn = 1 GROUP BY ALL), vf AS ({_f1("vc")}), re AS (SELECT held, rows, acc, f FROM vf WHERE c = 0)
SELECT held AS source, any_value(re.rows)::BIGINT AS rows, any_value(groups) AS groups, round(any_value(re.acc), 6) AS acc, round(any_value(re.f), 6) AS macro_f1, round(avg(vf.f) FILTER (WHERE c > 0), 6) AS null_mean,
round(min(vf.f) FILTER (WHERE c > 0), 6) AS null_low, round(max(vf.f) FILTER (WHERE c > 0), 6) AS null_high, round(count(*) FILTER (WHERE round(vf.f, 9) >= round(re.f, 9)) / 11, 6) AS p_value
FROM vf JOIN re USING (held) JOIN sh ON source = held GROUP BY held""")
def shortcut_probe(t, spark):
    """Within each line number, what day and quantity say of the class, suppliers being the groups."""
    out = within_source_probe(shipped(t), "l_linenumber", "l_suppkey", "l_returnflag", CLASSES, ["days", "quantity"], 0.01, 3, 10)
    return out.select("source", "rows", "groups", *[F.round(c, 6).alias(c) for c in ("acc", "macro_f1", "null_mean", "null_low", "null_high", "p_value")])
