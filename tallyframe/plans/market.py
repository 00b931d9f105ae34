"""Market totals over image results (orders) and their detections (lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query


def class_counts(orders, lineitem):
    """Per image its detections of each class; images without any keep zeros. Pre-aggregated before the join."""
    one = lambda c: F.count_if(F.col("l_returnflag") == c)
    per = lineitem.groupBy("l_orderkey").agg(one("A").alias("a"), one("N").alias("n"), one("R").alias("r"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return orders.join(per, orders["o_orderkey"] == per["l_orderkey"], "left").select("o_orderkey", "o_orderstatus", "o_orderdate", z("a"), z("n"), z("r"))


@query(
    "q_market_totals",
    """SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(n) AS BIGINT) AS n_n, CAST(sum(r) AS BIGINT) AS n_r,
    count(*) FILTER (WHERE (a > 0)::INT + (n > 0)::INT + (r > 0)::INT > 1) AS n_mixed, count(*) AS n_results
    FROM (SELECT o_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') a, count(*) FILTER (WHERE l_returnflag = 'N') n,
    count(*) FILTER (WHERE l_returnflag = 'R') r FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)""",
)
def market_totals(t, spark):
    """Sums of each class, images of more than one class, all images."""
    c = class_counts(t("orders"), t("lineitem"))
    classes = sum((F.col(x) > 0).cast("int") for x in ("a", "n", "r"))
    return c.agg(F.sum("a").alias("n_a"), F.sum("n").alias("n_n"), F.sum("r").alias("n_r"), F.count_if(classes > 1).alias("n_mixed"), F.count("*").alias("n_results"))
