"""Queries on operators without SQL twins (steps depend on one another); the tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.operators import metrics as M
from tallyframe.operators import sequential as S
from tallyframe.plans.relations import boxes
from tallyframe.streaming import market


@query("q_suppress")
def suppress(t, spark):
    """L17, L18."""
    return S.suppress(boxes(t).withColumn("score", F.col("x1") - F.col("x0")), "image", "box", "score", 0.5, 300)


@query("q_label_groups")
def label_groups(t, spark):
    """Lightness groups of each image and their classes."""
    li = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("bean"), F.col("l_quantity").alias("value"), (0.2 + F.col("l_discount") * 4).alias("p0"), (0.2 + F.col("l_tax") * 4).alias("p1"), F.lit(0.3).alias("p2"))
    return S.label_groups(li, "l_orderkey", "bean", "value", ["p0", "p1", "p2"])


@query("q_diverse_rows")
def diverse(t, spark):
    """Examples of each source that show all flags early; at most 12, which is the feature."""
    from tallyframe.functions.paths import flags

    n = F.col("n_chars")
    f = flags(short=n < 500, long=n > 5000, table=F.contains("text", F.lit("|")), symbols=F.contains("text", F.lit("###")))
    return S.diverse_rows(t("documents").select("source", "doc_id", f.alias("flags")), "source", "doc_id", "flags", 12)


@query("q_group_split", """WITH RECURSIVE g AS MATERIALIZED (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY md5('3:' || o_custkey::VARCHAR), o_custkey::VARCHAR) AS i FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey), most AS MATERIALIZED (SELECT count(*) // 3 AS most FROM orders),
w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, false AS dev UNION ALL SELECT g.i, used + CASE WHEN used + n <= most THEN n ELSE 0 END, used + n <= most FROM w JOIN g ON g.i = w.i + 1, most)
SELECT o_custkey, CASE WHEN dev THEN 'dev' ELSE 'frozen' END AS half FROM w JOIN g USING (i)""")
def group_split(t, spark):
    """Whole customers into a third of the orders, as far as they fill it."""
    orders = t("orders").select("o_custkey")
    return S.group_split(orders, "o_custkey", orders.count() // 3, 3, exact=False)


@query("q_stratified_folds")
def stratified_folds(t, spark):
    """L11."""
    return S.stratified_folds(t("documents").select("source", "lang"), "source", "lang", 5)


@query("q_bootstrap_mean")
def bootstrap(t, spark):
    """10,000 resamples, as many as the reference draws."""
    return M.bootstrap_mean(t("events").select("event_id", "value"), "value", "event_id", 10_000)


def stored(t):
    """Valid events as stored predictions."""
    from tallyframe.functions import events as E
    from tallyframe.plans.events import payloads

    return market.project(E.validated(payloads(t).withColumnRenamed("event_id", "ingest_seq"), "payload").where("error is null"))


#: Of every 18 events those with remainder 0 and 15 add light 2, medium 1; remainder 16 has no counts.
@query("q_market_snapshot", "SELECT CAST(2 * sum((event_id % 18 IN (0, 15))::INT) AS BIGINT) AS light, CAST(sum((event_id % 18 IN (0, 15))::INT) AS BIGINT) AS medium, 0::BIGINT AS dark, 0::BIGINT AS estimated, 0::BIGINT AS visible_only, CAST(sum((event_id % 18 IN (0, 15))::INT) AS BIGINT) AS results, count(*) FILTER (WHERE event_id % 18 IN (0, 15, 16)) AS n_rows FROM events")
def snapshot(t, spark):
    """Totals over stored predictions."""
    return market.totals(stored(t))


@query("q_market_newest", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, event_id AS ingest_seq, 2::BIGINT AS light, 1::BIGINT AS medium, 0::BIGINT AS dark, false AS estimated, false AS visible_only FROM events WHERE event_id % 18 IN (0, 15) ORDER BY created_at DESC, ingest_seq DESC LIMIT 50")
def newest(t, spark):
    """The snapshot's list of results."""
    return market.newest(stored(t), 50)
