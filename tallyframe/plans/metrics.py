"""Queries on metrics: truth is an order's status, prediction a line's return flag, folds the order priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.operators import metrics as M
from tallyframe.operators.selection import with_percentiles

CLASSES = ["F", "O", "P"]
_PRED = "CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END"
_ROWS = f"rows_ AS (SELECT o_orderkey, o_orderstatus AS truth, {_PRED} AS pred, o_orderpriority AS fold, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_SPINE = "cls(class) AS (VALUES ('F'), ('O'), ('P')), cell AS (SELECT a.class AS truth, b.class AS pred FROM cls a, cls b)"
_CM = f"WITH {_ROWS}, {_SPINE}, cm AS (SELECT c.truth, c.pred, count(r.truth) AS n FROM cell c LEFT JOIN rows_ r ON r.truth = c.truth AND r.pred = c.pred GROUP BY ALL)"
_PRF = """prf AS (SELECT class, sum(CASE WHEN truth = class AND pred = class THEN n ELSE 0 END) AS tp, sum(CASE WHEN truth = class THEN n ELSE 0 END) AS support,
sum(CASE WHEN pred = class THEN n ELSE 0 END) AS predicted FROM cm, cls GROUP BY class)"""


def labelled(t):
    pred = F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").otherwise("P")
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", F.col("o_orderstatus").alias("truth"), pred.alias("pred"), F.col("o_orderpriority").alias("fold"), "l_quantity"
    )


def matrix(t, by=()):
    return M.confusion(labelled(t), "truth", "pred", CLASSES, by)


@query("q_confusion", f"{_CM} SELECT truth, pred, n FROM cm")
def confusion(t, spark):
    """A05."""
    return matrix(t)


@query("q_confusion_pivot", f"""{_CM} SELECT truth, CAST(sum(n) FILTER (WHERE pred = 'F') AS BIGINT) AS "F", CAST(sum(n) FILTER (WHERE pred = 'O') AS BIGINT) AS "O",
CAST(sum(n) FILTER (WHERE pred = 'P') AS BIGINT) AS "P" FROM cm GROUP BY truth""")
def confusion_pivot(t, spark):
    """K09."""
    return matrix(t).groupBy("truth").pivot("pred", CLASSES).agg(F.sum("n"))


@query("q_prf", f"""{_CM}, {_PRF} SELECT class, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
round(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM prf""")
def prf(t, spark):
    """A06."""
    r = lambda c: F.round(c, 6).alias(c)
    return M.class_scores(matrix(t)).select("class", r("precision"), r("recall"), r("f1"), "support")


_FOLD = f"""WITH {_ROWS}, {_SPINE}, keys AS (SELECT DISTINCT fold FROM rows_), cm AS (SELECT k.fold, c.truth, c.pred, count(r.truth) AS n FROM keys k CROSS JOIN cell c
LEFT JOIN rows_ r ON r.fold = k.fold AND r.truth = c.truth AND r.pred = c.pred GROUP BY ALL),
prf AS (SELECT fold, class, sum(CASE WHEN truth = class AND pred = class THEN n ELSE 0 END) AS tp, sum(CASE WHEN truth = class THEN n ELSE 0 END) AS support,
sum(CASE WHEN pred = class THEN n ELSE 0 END) AS predicted FROM cm, cls GROUP BY fold, class),
macro AS (SELECT fold, avg(CASE WHEN support > 0 THEN CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END END) AS macro_f1 FROM prf GROUP BY fold),
tot AS (SELECT fold, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hit, CAST(sum(CASE WHEN (truth = 'F' AND pred = 'P') OR (truth = 'P' AND pred = 'F') THEN n ELSE 0 END) AS BIGINT) AS cross_step FROM cm GROUP BY fold),
m AS (SELECT tot.fold, tot.n, tot.hit / tot.n AS acc, macro_f1, cross_step, cross_step / tot.n AS cross_step_rate FROM tot JOIN macro USING (fold))"""


@query("q_metrics_by_fold", f"{_FOLD} SELECT fold, n, round(acc, 6) AS acc, round(macro_f1, 6) AS macro_f1, cross_step, round(cross_step_rate, 6) AS cross_step_rate FROM m")
def metrics_by_fold(t, spark):
    """A07, A32."""
    r = lambda c: F.round(c, 6).alias(c)
    return M.summary(matrix(t, ("fold",)), ("F", "P"), ("fold",)).select("fold", "n", r("acc"), r("macro_f1"), "cross_step", r("cross_step_rate"))


@query("q_metrics", _FOLD.replace("o_orderpriority AS fold", "1 AS fold") + " SELECT n, round(acc, 6) AS acc, round(macro_f1, 6) AS macro_f1, cross_step, round(cross_step_rate, 6) AS cross_step_rate FROM m")
def metrics(t, spark):
    """A07, pooled."""
    r = lambda c: F.round(c, 6).alias(c)
    return M.summary(matrix(t), ("F", "P")).select("n", r("acc"), r("macro_f1"), "cross_step", r("cross_step_rate"))


@query("q_fold_table", f"{_FOLD} SELECT count(*) AS folds, round(avg(acc), 6) AS mean_acc, round(avg(macro_f1), 6) AS mean_macro_f1, round(sum(acc * n) / sum(n), 6) AS pooled_acc FROM m")
def fold_table(t, spark):
    """The unweighted mean of folds beside the pooled figure."""
    m = M.summary(matrix(t, ("fold",)), ("F", "P"), ("fold",))
    return m.agg(F.count("*").alias("folds"), F.round(F.avg("acc"), 6).alias("mean_acc"), F.round(F.avg("macro_f1"), 6).alias("mean_macro_f1"), F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("pooled_acc"))


@query("q_weighted_confusion", f"""WITH {_ROWS}, w AS (SELECT truth, pred, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderkey) AS w FROM rows_), {_SPINE}
SELECT c.truth, c.pred, round(coalesce(sum(w.w), 0), 6) AS n FROM cell c LEFT JOIN w ON w.truth = c.truth AND w.pred = c.pred GROUP BY ALL""")
def weighted_confusion(t, spark):
    """Every image weighs one, its detections share it."""
    return _weighted(t).withColumn("n", F.round("n", 6))


def _weighted(t):
    per = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    rows = labelled(t).join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    return M.confusion(rows, "truth", "pred", CLASSES, weight=F.lit(1.0) / F.col("k"))


@query("q_extreme_rate", f"""WITH {_ROWS}, w AS (SELECT truth, pred, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderkey) AS w FROM rows_)
SELECT round(sum(CASE WHEN (truth = 'F' AND pred = 'P') OR (truth = 'P' AND pred = 'F') THEN w ELSE 0 END) / sum(CASE WHEN truth IN ('F', 'P') THEN w END), 6) AS light_dark_rate, round(sum(w), 4) AS image_weight_sum FROM w""")
def extreme_rate(t, spark):
    """Crossings of the two end classes, over rows whose truth is one of them."""
    n, a, b = F.col("n"), F.col("truth"), F.col("pred")
    cross = ((a == "F") & (b == "P")) | ((a == "P") & (b == "F"))
    return _weighted(t).agg(F.round(F.sum(F.when(cross, n).otherwise(0.0)) / F.sum(F.when(a.isin("F", "P"), n)), 6).alias("light_dark_rate"), F.round(F.sum("n"), 4).alias("image_weight_sum"))


@query("q_vote_tie_null", """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey, max(n) AS top, count(*) AS k FROM c GROUP BY ALL)
SELECT r.l_orderkey, CASE WHEN count(*) = 1 THEN min(c.l_returnflag) END AS vote FROM r JOIN c ON r.l_orderkey = c.l_orderkey AND c.n = r.top GROUP BY ALL""")
def vote(t, spark):
    """The commonest class of each image; null where two are equally common."""
    n = {c: F.count_if(F.col("l_returnflag") == c).alias(c) for c in "ANR"}
    per = t("lineitem").groupBy("l_orderkey").agg(*n.values())
    top = F.greatest("A", "N", "R")
    ties = sum((F.col(c) == top).cast("int") for c in "ANR")
    return per.select("l_orderkey", F.when(ties == 1, F.when(F.col("A") == top, "A").when(F.col("N") == top, "N").otherwise("R")).alias("vote"))


@query("q_majority_label", """WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, avg(l_discount) AS p FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS label, round(0.999 * greatest(a, n, r) / (a + n + r) + 0.001 * p, 9) AS prob FROM c""")
def majority_label(t, spark):
    """The majority with ties to the first class, and its smoothed share."""
    n = [F.count_if(F.col("l_returnflag") == c).alias(c.lower()) for c in "ANR"]
    per = t("lineitem").groupBy("l_orderkey").agg(*n, F.avg("l_discount").alias("p"))
    a, b, c = F.col("a"), F.col("n"), F.col("r")
    label = F.when((a >= b) & (a >= c), "A").when(b >= c, "N").otherwise("R")
    return per.select("l_orderkey", label.alias("label"), F.round(0.999 * F.greatest(a, b, c) / (a + b + c) + 0.001 * F.col("p"), 9).alias("prob"))


@query("q_proportions", "SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY ALL")
def proportions(t, spark):
    """A37."""
    per = t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    return per.join(F.broadcast(total)).select("l_returnflag", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("q_class_weights", "SELECT o_orderstatus AS class, count(*) AS n, round((SELECT count(*) FROM orders) / (3.0::DOUBLE * count(*)), 6) AS weight FROM orders GROUP BY ALL")
def class_weights(t, spark):
    """N / (k * count)."""
    per = t("orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    checked = F.when(F.col("k") < len(CLASSES), F.raise_error("a class is missing")).otherwise(F.col("all") / (F.col("k") * F.col("n")))
    return per.join(F.broadcast(total)).select("class", "n", F.round(checked, 6).alias("weight"))


_CAL = "p AS (SELECT l_discount * 10 AS conf, l_returnflag = 'N' AS correct FROM lineitem)"


@query("q_calibration_bins", f"""WITH {_CAL}, b AS (SELECT least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg(correct::INT) AS accuracy, avg(conf) AS confidence FROM p GROUP BY 1),
s AS (SELECT unnest(range(10))::INT AS bin) SELECT s.bin, round(s.bin / 10.0::DOUBLE, 6) AS lower, round((s.bin + 1) / 10.0::DOUBLE, 6) AS upper, coalesce(n, 0) AS n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM s LEFT JOIN b USING (bin)""")
def calibration(t, spark):
    """Empty bins stay, the last is closed."""
    b = M.calibration_bins(t("lineitem").withColumn("conf", F.col("l_discount") * 10), F.col("l_returnflag") == "N", F.col("conf"))
    r = lambda c: F.round(c, 6).alias(c)
    return b.select("bin", r("lower"), r("upper"), "n", r("accuracy"), r("confidence"))


@query("q_ece", f"""WITH {_CAL}, b AS (SELECT least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg(correct::INT) AS accuracy, avg(conf) AS confidence FROM p GROUP BY 1)
SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""")
def ece(t, spark):
    """A15."""
    b = M.calibration_bins(t("lineitem").withColumn("conf", F.col("l_discount") * 10), F.col("l_returnflag") == "N", F.col("conf"))
    return M.expected_calibration_error(b).select(F.round("ece", 6).alias("ece"), "n")


@query("q_nll_brier", """SELECT round(avg(-ln(greatest(CASE WHEN l_returnflag = 'N' THEN l_discount * 10 ELSE 1 - l_discount * 10 END, 1e-15))), 6) AS nll,
round(avg(2 * power((l_returnflag = 'N')::INT - l_discount * 10, 2)), 6) AS brier FROM lineitem""")
def nll_brier(t, spark):
    """A15, A17."""
    p = F.col("l_discount") * 10
    hit = (F.col("l_returnflag") == "N").cast("int")
    return t("lineitem").agg(F.round(M.log_loss(F.when(hit == 1, p).otherwise(1 - p)), 6).alias("nll"), F.round(F.avg(2 * F.power(hit - p, 2)), 6).alias("brier"))


@query("q_wilson", """WITH g AS (SELECT l_linestatus, l_linenumber, count(*) FILTER (WHERE l_linenumber < 7)::DOUBLE AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber < 7)::DOUBLE AS k FROM lineitem GROUP BY ALL)
SELECT l_linestatus, l_linenumber, CASE WHEN n = 0 THEN 0 ELSE round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) END AS low,
CASE WHEN n = 0 THEN 0 ELSE round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) END AS high FROM g""")
def wilson(t, spark):
    """Lines 7 stand for groups of which nothing was tried."""
    tried = F.col("l_linenumber") < 7
    g = t("lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.count_if(tried).alias("n"), F.count_if(tried & (F.col("l_returnflag") == "R")).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("l_linestatus", "l_linenumber", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_COUNTS = "c AS (SELECT o_orderkey, CAST(1 + o_orderkey % 7 AS BIGINT) AS gt, count(l_orderkey) AS raw FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), p AS (SELECT o_orderkey, gt, CASE WHEN raw > 0 THEN raw END AS n FROM c)"


def counted(t):
    per = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t("orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", (1 + F.col("o_orderkey") % 7).cast("long").alias("gt"), "n")


@query("q_count_error_block", f"""WITH {_COUNTS} SELECT count(*) AS rows, round(avg(abs(coalesce(n, 0) - gt)), 6) AS mae, round(avg(abs(coalesce(n, 0) - gt) / greatest(gt, 1)), 6) AS mape,
round(avg((n IS NULL)::INT), 6) AS null_rate, round(avg((coalesce(n, 0) > gt)::INT), 6) AS over_rate, round(avg((coalesce(n, 0) < gt)::INT), 6) AS under_rate,
CAST(median(abs(coalesce(n, 0) - gt)) AS DOUBLE) AS median_error, max(abs(coalesce(n, 0) - gt)) AS max_error FROM p""")
def count_error_block(t, spark):
    """A missing count is 0 in the errors, and a rate of its own."""
    n = F.coalesce(F.col("n"), F.lit(0))
    e = F.abs(n - F.col("gt"))
    r = lambda c, a: F.round(c, 6).alias(a)
    share = lambda c: F.avg(c.cast("int"))
    block = counted(t).agg(
        F.count("*").alias("rows"), r(F.avg(e), "mae"), r(F.avg(e / F.greatest("gt", F.lit(1))), "mape"), r(share(F.col("n").isNull()), "null_rate"),
        r(share(n > F.col("gt")), "over_rate"), r(share(n < F.col("gt")), "under_rate"), F.max(e).alias("max_error"),
    )
    return with_percentiles(block, counted(t), [], {"_q": e}, [0.5]).withColumn("median_error", F.col("_q")[0]).drop("_q")


@query("q_count_stats", f"""WITH {_COUNTS} SELECT round(median(abs(n - gt) / gt), 6) AS median_rel, round(avg((coalesce(abs(n - gt) <= greatest(2, 0.2 * gt), false))::INT), 6) AS within FROM p""")
def count_stats(t, spark):
    """A19."""
    e = F.abs(F.col("n") - F.col("gt"))
    near = counted(t).agg(F.round(F.avg(F.coalesce(e <= F.greatest(F.lit(2.0), 0.2 * F.col("gt")), F.lit(False)).cast("int")), 6).alias("within"))
    return with_percentiles(near, counted(t), [], {"_q": e / F.col("gt")}, [0.5]).select(F.round(F.col("_q")[0], 6).alias("median_rel"), "within")


@query("q_count_histogram", f"""WITH {_COUNTS} SELECT CASE WHEN n IS NULL THEN 'null' WHEN n > 20 THEN '>20' WHEN n > 5 THEN '>5' ELSE CAST(n AS VARCHAR) END AS bucket, count(*) AS images FROM p GROUP BY 1""")
def count_histogram(t, spark):
    """A20."""
    b = F.when(F.col("n").isNull(), "null").when(F.col("n") > 20, ">20").when(F.col("n") > 5, ">5").otherwise(F.col("n").cast("string"))
    return counted(t).groupBy(b.alias("bucket")).agg(F.count("*").alias("images"))


_PAIR = "a AS (SELECT o_orderkey, o_orderpriority AS fold, o_orderstatus = 'F' AS ok FROM orders), b AS (SELECT o_orderkey, o_totalprice > 150000 AS ok FROM orders)"


@query("q_complementarity", f"""WITH {_PAIR} SELECT fold, round(avg((a.ok AND NOT b.ok)::INT), 6) AS only_a, round(avg((b.ok AND NOT a.ok)::INT), 6) AS only_b, round(avg((a.ok AND b.ok)::INT), 6) AS both, round(avg((a.ok OR b.ok)::INT), 6) AS either
FROM a JOIN b USING (o_orderkey) GROUP BY GROUPING SETS ((fold), ())""")
def complementarity(t, spark):
    """By fold and pooled (null fold)."""
    o = t("orders")
    a = o.select("o_orderkey", F.col("o_orderpriority").alias("fold"), (F.col("o_orderstatus") == "F").alias("a"))
    b = o.select("o_orderkey", (F.col("o_totalprice") > 150000).alias("b"))
    r = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    x, y = F.col("a"), F.col("b")
    return a.join(b, "o_orderkey").rollup("fold").agg(r(x & ~y, "only_a"), r(y & ~x, "only_b"), r(x & y, "both"), r(x | y, "either"))


@query("q_err_delta", f"""WITH {_COUNTS}, d AS (SELECT abs(coalesce(n, 0) - gt) AS old, abs(coalesce(n, 0) + o_orderkey % 2 - gt) AS new FROM p)
SELECT count(*) FILTER (WHERE new > old) AS worse, count(*) FILTER (WHERE new < old) AS better, count(*) FILTER (WHERE new = old) AS same FROM d""")
def err_delta(t, spark):
    """A43."""
    n = F.coalesce(F.col("n"), F.lit(0))
    d = counted(t).select(F.abs(n - F.col("gt")).alias("old"), F.abs(n + F.col("o_orderkey") % 2 - F.col("gt")).alias("new"))
    return d.agg(F.count_if(F.col("new") > F.col("old")).alias("worse"), F.count_if(F.col("new") < F.col("old")).alias("better"), F.count_if(F.col("new") == F.col("old")).alias("same"))


@query("q_parity", """SELECT round(max(abs(l_extendedprice * (1 - l_discount) - round(l_extendedprice * (1 - l_discount), 1))), 6) AS max_abs, count(*) FILTER (WHERE (l_quantity > 25) <> (round(l_quantity, -1) > 25)) AS changed, round(avg(((l_quantity > 25) = (round(l_quantity, -1) > 25))::INT), 6) AS agreement FROM lineitem""")
def parity(t, spark):
    """Largest difference and agreement of two exports of one score."""
    s = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    same = (F.col("l_quantity") > 25) == (F.round("l_quantity", -1) > 25)
    return t("lineitem").agg(F.round(F.max(F.abs(s - F.round(s, 1))), 6).alias("max_abs"), F.count_if(~same).alias("changed"), F.round(F.avg(same.cast("int")), 6).alias("agreement"))


@query("q_seed_aggregate", """WITH s AS (SELECT o_orderpriority AS fold, o_orderkey % 3 AS seed, avg((o_orderstatus = 'F')::INT) AS acc FROM orders GROUP BY ALL), m AS (SELECT seed, avg(acc) AS mean_acc FROM s GROUP BY seed)
SELECT (SELECT round(avg(mean_acc), 6) FROM m) AS mean, (SELECT round(stddev_samp(mean_acc), 6) FROM m) AS sd, round(min(f), 6) AS worst, arg_min(fold, f) AS worst_fold FROM (SELECT fold, avg(acc) AS f FROM s GROUP BY fold)""")
def seed_aggregate(t, spark):
    """Mean and sample deviation over seeds, and the worst fold."""
    s = t("orders").groupBy(F.col("o_orderpriority").alias("fold"), (F.col("o_orderkey") % 3).alias("seed")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("acc"))
    m = s.groupBy("seed").agg(F.avg("acc").alias("a")).agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_samp("a"), 6).alias("sd"))
    w = s.groupBy("fold").agg(F.avg("acc").alias("f")).agg(F.round(F.min("f"), 6).alias("worst"), F.min_by("fold", "f").alias("worst_fold"))
    return m.join(F.broadcast(w))


@query("q_mixed_count_error", """WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r,
count(*) FILTER (WHERE l_linenumber <= 2) AS ga, count(*) FILTER (WHERE l_linenumber BETWEEN 3 AND 4) AS gn, count(*) FILTER (WHERE l_linenumber > 4) AS gr FROM lineitem GROUP BY ALL)
SELECT count(*) AS images, CAST(sum(abs(a - ga) + abs(n - gn) + abs(r - gr)) AS BIGINT) AS error FROM c WHERE (ga > 0)::INT + (gn > 0)::INT + (gr > 0)::INT > 1""")
def mixed_count_error(t, spark):
    """Over images of more than one true class, the sum of count differences."""
    f, k = F.col("l_returnflag"), F.col("l_linenumber")
    n = dict(a=f == "A", n=f == "N", r=f == "R", ga=k <= 2, gn=k.between(3, 4), gr=k > 4)
    c = t("lineitem").groupBy("l_orderkey").agg(*[F.count_if(v).alias(x) for x, v in n.items()])
    mixed = sum((F.col(x) > 0).cast("int") for x in ("ga", "gn", "gr")) > 1
    error = sum((F.abs(F.col(x) - F.col("g" + x)) for x in ("a", "n", "r")), F.lit(0))
    return c.where(mixed).agg(F.count("*").alias("images"), F.sum(error).cast("long").alias("error"))


@query("q_agtron_breakdown", """SELECT o_orderpriority AS original, CAST(split_part(o_orderpriority, '-', 1) AS INT) AS level, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY ALL""")
def original_breakdown(t, spark):
    """Classes by original value, ordered by the number in it."""
    level = F.split("o_orderpriority", "-")[0].cast("int")
    n = [F.count_if(F.col("o_orderstatus") == c).alias(c.lower()) for c in CLASSES]
    return t("orders").groupBy(F.col("o_orderpriority").alias("original"), level.alias("level")).agg(*n).orderBy(F.desc("level"))
