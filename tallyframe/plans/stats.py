"""Queries on grouped statistics, summaries and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.operators import stats as S
from tallyframe.operators.selection import percentiles, with_percentiles


def r(c, name=None, digits=6):
    return F.round(c, digits).alias(name or c)


@query("q_grouped_percentiles", """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_quantity, 0.05), 6) AS p5, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95 FROM lineitem GROUP BY ALL""")
def grouped_percentiles(t, spark):
    """Exact, linear interpolation."""
    q = percentiles(t("lineitem"), ["l_returnflag", "l_linestatus"], {"q": "l_quantity"}, [0.05, 0.5, 0.95])
    return q.select("_key.*", *[r(F.col("q")[i], n) for i, n in enumerate(("p5", "p50", "p95"))])


_F = ", ".join(f"round(quantile_cont(l, {q}), 6) AS {n}" for q, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95")))
_H = ", ".join(f"round(count(*) FILTER (WHERE least(floor(l * 8 / 100), 7) = {k}) / count(l), 6) AS h{k}" for k in range(8))
_FEATURES = f"""WITH px AS (SELECT l_returnflag AS g, l_linestatus AS s, l_quantity * 2 AS l, l_discount * 100 AS a, l_tax * 100 AS b FROM lineitem)
SELECT {{keys}}{_F}, round(avg(l), 6) AS mean, round(stddev_pop(l), 6) AS std, round(quantile_cont(l, 0.75) - quantile_cont(l, 0.25), 6) AS iqr, round(median(a), 6) AS a_med, round(median(b), 6) AS b_med,
round(median(sqrt(a * a + b * b)), 6) AS c_med, round(degrees(atan2(median(b), median(a))), 6) AS hue, {_H} FROM px {{group}}"""


def _pixels(t):
    return t("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("s"), (F.col("l_quantity") * 2).alias("l"), (F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"))


@query("q_grouped_features", _FEATURES.format(keys="g, s, ", group="GROUP BY g, s"))
def grouped_features(t, spark):
    """The 20-feature vector of each group."""
    f = S.feature_vector(_pixels(t), ["g", "s"], "l", "a", "b")
    return f.select("g", "s", *[r(c) for c in f.columns if c not in ("g", "s")])


@query("q_single_features", _FEATURES.format(keys="", group=""))
def single_features(t, spark):
    """The same over all rows."""
    f = S.feature_vector(_pixels(t), [], "l", "a", "b")
    return f.select(*[r(c) for c in f.columns])


@query("q_border_features", """SELECT l_returnflag, round(avg(l_quantity * 2), 6) AS mean, round(stddev_pop(l_quantity * 2), 6) AS std, count(*) AS n FROM lineitem WHERE l_linenumber = 1 OR l_linenumber >= 6 GROUP BY ALL""")
def border_features(t, spark):
    """Statistics of the rows at the edge."""
    edge = t("lineitem").where((F.col("l_linenumber") == 1) | (F.col("l_linenumber") >= 6))
    return edge.groupBy("l_returnflag").agg(r(F.avg(F.col("l_quantity") * 2), "mean"), r(F.stddev_pop(F.col("l_quantity") * 2), "std"), F.count("*").alias("n"))


@query("q_hist8", "SELECT l_returnflag, least(floor(l_quantity * 8 / 50), 7)::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def hist8(t, spark):
    """Bins with a closed last one."""
    return t("lineitem").groupBy("l_returnflag", S.histogram_bin(F.col("l_quantity"), 0, 50, 8).alias("bin")).agg(F.count("*").alias("n"))


@query("q_five_number", "SELECT event_type, count(*) AS n, round(min(value), 6) AS lo, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS hi FROM events GROUP BY ALL")
def five_number(t, spark):
    """A23."""
    g = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return with_percentiles(g, t("events"), ["event_type"], {"q": "value"}, [0.0, 0.25, 0.5, 0.75, 1.0]).select("event_type", "n", *[r(F.col("q")[i], n) for i, n in enumerate(("lo", "q1", "q2", "q3", "hi"))])


@query("q_latency", "SELECT event_type, count(value) AS n, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def latency(t, spark):
    """A26."""
    return S.latency(t("events"), ["event_type"], "value").select("event_type", "n", r("p50"), r("p95"), r("max"), r("mean"))


@query("q_latency_rollup", """WITH s AS (SELECT l_shipmode, stage, ms FROM (SELECT l_returnflag AS l_shipmode, l_quantity AS decode, l_discount * 100 AS segment, l_tax * 100 AS features FROM lineitem) UNPIVOT (ms FOR stage IN (decode, segment, features)))
SELECT CASE WHEN grouping(l_shipmode) = 1 THEN 'ALL' ELSE l_shipmode END AS source, stage, count(*) AS n, round(median(ms), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(max(ms), 6) AS max FROM s GROUP BY GROUPING SETS ((l_shipmode, stage), (stage))""")
def latency_rollup(t, spark):
    """A27."""
    rows = t("lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("decode"), (F.col("l_discount") * 100).alias("segment"), (F.col("l_tax") * 100).alias("features"))
    return S.latency_rollup(rows, "source", ["decode", "segment", "features"]).select("source", "stage", "n", r("p50"), r("p95"), r("max"))


@query("q_percentile_triple", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.1), 2) AS p10, round(median(c_acctbal), 2) AS p50, round(quantile_cont(c_acctbal, 0.9), 2) AS p90 FROM customer GROUP BY ALL")
def percentile_triple(t, spark):
    """A28."""
    return percentiles(t("customer"), ["c_mktsegment"], {"q": "c_acctbal"}, [0.1, 0.5, 0.9]).select("_key.*", *[r(F.col("q")[i], n, 2) for i, n in enumerate(("p10", "p50", "p90"))])


@query("q_inventory", """SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars <= 500) AS small, count(*) FILTER (WHERE n_chars > 5000) AS large, round(median(n_chars), 2) AS median_chars, count(DISTINCT lang) AS langs, count(*) FILTER (WHERE contains(text, '|')) > 0 AS has_tables FROM documents GROUP BY ALL""")
def inventory(t, spark):
    """Per source counts, sizes, kinds and a cluster flag."""
    c = F.col("n_chars")
    g = t("documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(c <= 500).alias("small"), F.count_if(c > 5000).alias("large"),
        F.count_distinct("lang").alias("langs"), (F.count_if(F.contains("text", F.lit("|"))) > 0).alias("has_tables"),
    )
    return with_percentiles(g, t("documents"), ["source"], {"_q": "n_chars"}, [0.5]).withColumn("median_chars", r(F.col("_q")[0], "median_chars", 2)).drop("_q")


@query("q_manifest_summary", "SELECT source, lang, count(*) AS n, count(DISTINCT md5(text)) AS distinct_texts FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def manifest_summary(t, spark):
    """Source x label cube with totals; distinct texts of each cell."""
    return t("documents").select("source", "lang", F.md5("text").alias("m")).cube("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("m").alias("distinct_texts"))


@query("q_source_stats", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, max(n_chars) AS largest, count(DISTINCT doc_id // 10) AS stems FROM documents GROUP BY ALL)
SELECT c.source, c.lang, c.n, s.largest, s.stems FROM c JOIN s USING (source)""")
def source_stats(t, spark):
    """A24."""
    d = t("documents")
    c = d.groupBy("source", "lang").agg(F.count("*").alias("n"))
    s = d.groupBy("source").agg(F.max("n_chars").alias("largest"), F.count_distinct(F.floor(F.col("doc_id") / 10)).alias("stems"))
    return c.join(s, "source")


@query("q_source_sizes", """WITH s AS (SELECT coalesce(source, '?') AS source, n_chars, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents)
SELECT source, place::INT AS place, n_chars, doc_id FROM s WHERE place <= 5""")
def source_sizes(t, spark):
    """The five largest of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = t("documents").select("source", "n_chars", "doc_id").withColumn("place", F.row_number().over(w)).where("place <= 5")
    return top.withColumn("source", F.coalesce("source", F.lit("?")))


@query("q_split_labels", """SELECT source, lang, count(*) FILTER (WHERE k = 0) AS test, count(*) FILTER (WHERE k = 1) AS dev, count(*) FILTER (WHERE k > 1) AS train FROM (SELECT source, lang, ('0x' || substr(md5(coalesce(source, '?') || ':' || doc_id // 10), 1, 8))::BIGINT % 5 AS k FROM documents) GROUP BY source, lang""")
def split_labels(t, spark):
    """Labels by split, where the split of a group of documents follows from a hash of its name."""
    name = F.concat(F.coalesce("source", F.lit("?")), F.lit(":"), F.floor(F.col("doc_id") / 10).cast("string"))
    k = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % 5
    d = t("documents").select("source", "lang", k.alias("k"))
    return d.groupBy("source", "lang").agg(F.count_if(F.col("k") == 0).alias("test"), F.count_if(F.col("k") == 1).alias("dev"), F.count_if(F.col("k") > 1).alias("train"))


@query("q_crosstab", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY ALL")
def crosstab(t, spark):
    """A25."""
    return t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0, ["F", "O"])


@query("q_group_size_histogram", "SELECT k, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY ALL) GROUP BY k")
def group_size_histogram(t, spark):
    """How many groups have each size."""
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("orders"))


@query("q_audit_blocks", """SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, count(*) FILTER (WHERE n_chars > 2000) AS long FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""")
def audit_blocks(t, spark):
    """One summary with a block for each mode, source and both."""
    d = t("documents").cube("lang", "source").agg(F.grouping("lang").alias("g"), F.grouping("source").alias("h"), F.count("*").alias("n"), r(F.avg("n_chars"), "mean_chars", 4), F.count_if(F.col("n_chars") > 2000).alias("long"))
    return d.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("lang")).alias("lang"), F.when(F.col("h") == 1, "ALL").otherwise(F.col("source")).alias("source"), "n", "mean_chars", "long")


@query("q_set_digest", "SELECT source, sha256(string_agg(DISTINCT CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM documents GROUP BY ALL")
def set_digest(t, spark):
    """A45."""
    return S.set_digest(t("documents"), ["source"], "doc_id")


@query("q_mode_config", """WITH c AS (SELECT p_brand AS config, count(*) AS n FROM part GROUP BY ALL) SELECT (SELECT config FROM c ORDER BY n DESC, config LIMIT 1) AS config, round(median(p_retailprice), 6) AS temperature FROM part""")
def mode_config(t, spark):
    """The commonest choice and the median parameter."""
    p = t("part")
    c = p.groupBy("p_brand").agg(F.count("*").alias("n")).agg(F.min_by("p_brand", F.struct(-F.col("n"), F.col("p_brand"))).alias("config"))
    return with_percentiles(c, p, [], {"_q": "p_retailprice"}, [0.5]).select("config", r(F.col("_q")[0], "temperature"))


@query("q_weight_share", """WITH g AS (SELECT lang, source, least(count(*), 10) AS n FROM documents GROUP BY ALL) SELECT lang, source, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM g""")
def weight_share(t, spark):
    """Each source's share of a class once groups are capped."""
    g = t("documents").groupBy("lang", "source").agg(F.least(F.count("*"), F.lit(10)).alias("n"))
    return g.select("lang", "source", r(F.col("n") / F.expr("sum(n) over (partition by lang)"), "share"))


@query("q_status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def status_counts(t, spark):
    """A20 over statuses."""
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("q_latency_gate", """WITH g AS (SELECT event_type, quantile_cont(value, 0.95) AS p95, count(value) AS n FROM events GROUP BY ALL) SELECT event_type, CASE WHEN n = 0 THEN NULL ELSE p95 <= 190 END AS passed, n < 150 AS crossing FROM g""")
def gates(t, spark):
    """Value against threshold; unmeasured is null, not failed."""
    g = S.latency(t("events"), ["event_type"], "value")
    return g.select("event_type", F.when(F.col("n") > 0, F.col("p95") <= 190).alias("passed"), (F.col("n") < 150).alias("crossing"))
