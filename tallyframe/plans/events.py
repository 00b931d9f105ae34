"""Queries on events: the events table, written as prediction events with every kind of fault."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.functions import events as E
from tallyframe.plans.market import class_counts

#: What is wrong with the event whose id leaves this remainder; None: nothing.
FAULTS = [
    None, "not_object", "msg_id", "created_at", "result_not_object", "key_set", "status",
    "label", "failed_with_label", "n_beans", "counts", "method_warning", "label_not_majority",
    "count_warning", "bean_counts", None, None, "uncounted_with_values",
]


def payloads(t):
    """Events as JSON text; every 18th kind by FAULTS."""
    k = F.col("event_id") % len(FAULTS)
    good = dict(
        status='"ok"', label='"light"', label_th='"x"', message_th='"m"', model='"b1"', confidence="0.9", probs='{"light":0.9,"medium":0.05,"dark":0.05}', warnings='["mixed_roast"]', n_beans="3",
        proportions='{"light":0.67,"medium":0.33,"dark":0.0}', beans='[{"label":"light"},{"label":"light"},{"label":"medium"}]', timing_ms="{}", schema_version="3",
        counts='{"light":2,"medium":1,"dark":0}', count_method='"exact"', image_size="[640,480]",
    )
    changed = {
        5: {"extra": "1"}, 6: {"status": '"odd"'}, 7: {"label": '"blue"'}, 8: {"status": '"error"'}, 9: {"n_beans": "true"}, 10: {"counts": '{"light":2,"medium":1,"dark":1}'},
        11: {"warnings": '["mixed_roast","bean_count_estimated"]'}, 12: {"label": '"medium"'}, 13: {"warnings": "[]"}, 14: {"beans": '[{"label":"light"},{"label":"dark"},{"label":"medium"}]'},
        15: {"beans": None}, 16: {"counts": "null", "n_beans": "null", "count_method": "null", "beans": "[]"}, 17: {"counts": "null", "n_beans": "null"},
    }
    body = lambda d: "{" + ",".join(f'"{a}":{b}' for a, b in d.items() if b is not None) + "}"
    result = F.lit(body(good))
    for i, d in changed.items():
        result = F.when(k == i, body(good | d)).otherwise(result)
    result = F.when(k == 4, "[1]").otherwise(result)
    msg = F.when(k == 2, F.lit("no-uuid")).otherwise(F.format_string("%08x-0000-4000-8000-000000000000", F.col("event_id")))
    stamp = F.when(k == 3, F.lit("12")).otherwise(F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"')))
    whole = F.concat(F.lit('{"msg_id":"'), msg, F.lit('","created_at":'), stamp, F.lit(',"result":'), result, F.lit("}"))
    return t("events").select("event_id", F.when(k == 1, "[]").otherwise(whole).alias("payload"))


_CASE = "CASE event_id % 18 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAULTS) if f) + " END"


@query("q_event_validate", f"SELECT event_id, {_CASE} AS error FROM events")
def event_validate(t, spark):
    """The first rule that an event breaks."""
    return E.validated(payloads(t), "payload").select("event_id", "error")


@query("q_event_reject_reasons", f"SELECT error, count(*) AS n FROM (SELECT {_CASE} AS error FROM events) WHERE error IS NOT NULL GROUP BY error")
def reject_reasons(t, spark):
    """Refused events by reason."""
    return E.validated(payloads(t), "payload").where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


@query("q_event_keyset", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def keyset(t, spark):
    """P02."""
    return t("events").select("event_id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"))


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("q_apportion_largest_remainder", f"""WITH e AS (SELECT event_id, {_K} AS n FROM events), r AS (SELECT event_id, n, [n * 0.5::DOUBLE / 1.0, n * 0.3::DOUBLE / 1.0, n * 0.2::DOUBLE / 1.0] AS raw FROM e WHERE n > 0),
b AS (SELECT event_id, n, raw, list_transform(raw, lambda x: floor(x)::BIGINT) AS base FROM r),
p AS (SELECT event_id, base, n - list_sum(base) AS rest, unnest([1, 2, 3]) AS i, unnest(list_transform(list_zip(raw, base), lambda z: z[1] - z[2])) AS part FROM b),
q AS (SELECT event_id, i, base[i] + (row_number() OVER (PARTITION BY event_id ORDER BY part DESC, i) <= rest)::BIGINT AS c FROM p)
SELECT event_id, CAST(sum(c) FILTER (WHERE i = 1) AS BIGINT) AS light, CAST(sum(c) FILTER (WHERE i = 2) AS BIGINT) AS medium, CAST(sum(c) FILTER (WHERE i = 3) AS BIGINT) AS dark FROM q GROUP BY event_id""")
def apportion(t, spark):
    """A03, T02."""
    n = F.get_json_object("props", "$.k").cast("long")
    a = E.apportion(n, [F.lit(0.5), F.lit(0.3), F.lit(0.2)])
    return t("events").where(n > 0).select("event_id", a.alias("c")).select("event_id", "c.light", "c.medium", "c.dark")


#: Stored results of each branch of the contribution, and what they add.
_RESULTS = [
    ('{"counts":{"light":1,"medium":2,"dark":3},"n_beans":6}', (1, 2, 3)), ('{"counts":null,"n_beans":5,"proportions":{"light":1,"medium":0,"dark":0}}', None), ('{"counts":{"light":true,"medium":0,"dark":0},"n_beans":1}', None),
    ('{"beans":[{"label":"dark"},{"label":"odd"}]}', (0, 0, 1)), ('{"n_beans":6,"proportions":{"light":0.5,"medium":0.25,"dark":0.25}}', (3, 2, 1)),
    ('{"n_beans":2,"proportions":{"light":0.9,"medium":0.1,"dark":0},"beans":[{"label":"dark"},{"label":"dark"}]}', (0, 0, 2)), ('{"n_beans":4,"proportions":{"light":1,"medium":0,"dark":0},"beans":[{"label":"dark"}]}', (4, 0, 0)),
    ('{"n_beans":true}', None), ("{}", None), ("nonsense", None),
]
_ADD = lambda i: "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN {c[i]}" for k, (_, c) in enumerate(_RESULTS) if c) + " END"


def stored(t):
    r = F.lit(_RESULTS[0][0])
    for k, (text, _) in enumerate(_RESULTS[1:], 1):
        r = F.when(F.col("event_id") % 10 == k, text).otherwise(r)
    return t("events").select("event_id", r.alias("result_json"))


@query("q_contribution", f"SELECT event_id, CAST({_ADD(0)} AS BIGINT) AS light, CAST({_ADD(1)} AS BIGINT) AS medium, CAST({_ADD(2)} AS BIGINT) AS dark FROM events")
def contribution(t, spark):
    """Which of counts, detections and shares adds to the totals."""
    return E.contributions(stored(t), "result_json").select("event_id", "added.light", "added.medium", "added.dark")


@query("q_estimated_flag", "SELECT event_id, event_id % 3 = 0 OR event_id % 5 = 0 AS estimated FROM events")
def estimated(t, spark):
    """P06."""
    i = F.col("event_id")
    j = F.concat(F.lit('{"count_method":'), F.when(i % 3 == 0, '"estimated"').otherwise("null"), F.lit(',"warnings":'), F.when(i % 5 == 0, '["bean_count_estimated"]').otherwise("null"), F.lit("}"))
    told = t("events").select("event_id", E.members(E.variant(j)).alias("_m"))
    return told.select("event_id", E.estimated(F.col("_m")).alias("estimated"))


@query("q_clean_warnings", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'mixed_roast,blurry' ELSE 'blurry' END AS warnings FROM events")
def clean_warnings(t, spark):
    """P10."""
    w = F.when(F.col("event_id") % 2 == 0, F.array(*map(F.lit, ("mixed_roast", "odd", "blurry", "mixed_roast")))).otherwise(F.array(F.lit("blurry"), F.lit("odd")))
    return t("events").select("event_id", F.array_join(E.clean_warnings(w), ",").alias("warnings"))


_RAW = "greatest(l_discount - 0.02, 0) AS a, l_tax AS b, 0.03::DOUBLE AS c"


_SHARES = "CASE l_linenumber WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN 'infinity'::DOUBLE WHEN 4 THEN '-infinity'::DOUBLE ELSE l_discount - 0.02 END"


@query("q_clean_proportions", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SHARES} AS a, l_tax AS b, l_discount AS c FROM lineitem),
p AS (SELECT * REPLACE (CASE WHEN a IS NULL OR isnan(a) OR a < 0 THEN 0 ELSE a END AS a) FROM s), t AS (SELECT *, CASE WHEN a + b + c > 0 AND NOT isinf(a + b + c) THEN a + b + c END AS total FROM p),
q AS (SELECT *, round(a / total, 4) AS x, round(b / total, 4) AS y, round(c / total, 4) AS z FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN x = greatest(x, y, z) THEN round(x + round(1 - (x + y + z), 4), 4) ELSE x END AS light, CASE WHEN y = greatest(x, y, z) AND x <> y THEN round(y + round(1 - (x + y + z), 4), 4) ELSE y END AS medium,
CASE WHEN z = greatest(x, y, z) AND x <> z AND y <> z THEN round(z + round(1 - (x + y + z), 4), 4) ELSE z END AS dark FROM q""")
def clean_proportions(t, spark):
    """Lines 1 to 4 have a share that is NaN, null, infinite or below every number; some have no share at all."""
    line = F.col("l_linenumber")
    odd = F.when(line == 1, float("nan")).when(line == 2, F.lit(None)).when(line == 3, float("inf")).when(line == 4, float("-inf")).otherwise(F.col("l_discount") - 0.02)
    q = E.clean_proportions([odd, F.col("l_tax"), F.col("l_discount")])
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for c, n in zip(q, E.LABELS, strict=True)])


@query("q_checked_probs", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(value / (value + 100), 6) END AS light, CASE WHEN event_id % 4 = 0 THEN NULL WHEN value >= 50 THEN 'light' ELSE 'medium' END AS label FROM events""")
def checked_probs(t, spark):
    """Ties go to the first class; NaN makes all null."""
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    p, label = E.checked_probs([x, F.lit(50.0), F.lit(50.0)])
    return t("events").select("event_id", F.round(p[0], 6).alias("light"), label.alias("label"))


@query("q_count_summary", """WITH c AS (SELECT o_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderkey, a + n + r AS total, array_to_string(list_filter([CASE WHEN a + n + r = 0 THEN 'no_beans_detected' END, CASE WHEN (a > 0)::INT + (n > 0)::INT + (r > 0)::INT > 1 THEN 'mixed_roast' END, CASE WHEN a + n + r > 8 THEN 'bean_count_estimated' END], lambda x: x IS NOT NULL), ',') AS warnings FROM c""")
def count_summary(t, spark):
    """A count and the warnings that follow from it."""
    c = class_counts(t("orders"), t("lineitem"))
    total = F.col("a") + F.col("n") + F.col("r")
    several = sum(((F.col(x) > 0).cast("int") for x in ("n", "r")), (F.col("a") > 0).cast("int")) > 1
    w = F.array_compact(F.array(F.when(total == 0, "no_beans_detected"), F.when(several, "mixed_roast"), F.when(total > 8, "bean_count_estimated")))
    return c.select("o_orderkey", total.alias("total"), F.array_join(w, ",").alias("warnings"))


@query("q_box_clean", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + l_linenumber <= 50 AS good FROM lineitem")
def box_clean(t, spark):
    """P11."""
    b = F.array(F.array(F.col("l_linenumber").cast("double"), F.lit(0.0), F.col("l_quantity"), F.lit(5.0)))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", E.clean_boxes(b, F.lit(50), F.lit(50)).isNotNull().alias("good"))


_MEMBERS = """"label":"' || event_type || '","n_beans":' || CAST(event_id % 7 AS VARCHAR) || ',"confidence":1.0,"value":' || CAST(event_id AS VARCHAR) || '.5' || ',"note":"1.0 \\"beans\\"","probs":{"light":0.5,"beans":[1]},"none":null,"warnings":["' || event_type || '"]}'"""


@query("q_publish_projection", f"""SELECT event_id, '{{{_MEMBERS} AS compact, '{{"beans":[],{_MEMBERS} AS older FROM events""")
def publish(t, spark):
    """Beans stay behind (or are emptied, in the older form); all other members keep their values and types, 1.0 too."""
    kind = F.col("event_type")
    beans = F.concat(F.lit('"beans":[{"label":"x","conf":'), F.round("value", 2), F.lit("}],"))
    rest = F.concat(
        F.lit('"label":"'), kind, F.lit('","n_beans":'), F.col("event_id") % 7, F.lit(',"confidence":1.0,"value":'), F.concat(F.col("event_id").cast("string"), F.lit(".5")),
        F.lit(r',"note":"1.0 \"beans\"","probs":{"light":0.5,"beans":[1]},"none":null,"warnings":["'), kind, F.lit('"]}'),
    )
    j = F.concat(F.lit("{"), beans, rest)
    return t("events").select("event_id", E.published(j).alias("compact"), E.published(j, compact=False).alias("older"))


@query("q_invariants", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 1000 THEN 'price_low' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status_open' END, CASE WHEN o_orderpriority IS NULL THEN 'no_priority' END], lambda x: x IS NOT NULL), ',') AS violations FROM orders""")
def invariants(t, spark):
    """The violations of each row as a list."""
    from tallyframe.functions.paths import flags

    f = flags(price_low=F.col("o_totalprice") < 1000, status_open=~F.col("o_orderstatus").isin("F", "O"), no_priority=F.col("o_orderpriority").isNull())
    return t("orders").select("o_orderkey", F.array_join(f, ",").alias("violations"))


@query("q_topk_recent", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at FROM orders ORDER BY created_at DESC, o_orderkey DESC LIMIT 50""")
def topk_recent(t, spark):
    """Newest by text, ties by arrival."""
    o = t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return o.orderBy(F.desc("created_at"), F.desc("o_orderkey")).limit(50)


@query("q_topk_recent_beans", """WITH b AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created_at, l_returnflag AS label, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, created_at, idx::INT AS idx, label FROM b WHERE idx <= 50 ORDER BY created_at DESC, o_orderkey DESC, idx LIMIT 50""")
def topk_beans(t, spark):
    """The newest results' detections, numbered from 1. Only the detections of the 50 newest results that have
    any can appear, so those are found first."""
    o = t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    newest = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at")).orderBy(F.desc("created_at"), F.desc("o_orderkey")).limit(50)
    rows = t("lineitem").join(F.broadcast(newest), F.col("l_orderkey") == F.col("o_orderkey"))  # 50 rows
    idx = F.expr("row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
    return rows.select("o_orderkey", "created_at", idx.alias("idx"), F.col("l_returnflag").alias("label")).where("idx <= 50").orderBy(F.desc("created_at"), F.desc("o_orderkey"), "idx").limit(50)


@query("q_mixed_flag", "SELECT l_orderkey, count(DISTINCT l_returnflag) > 1 AS mixed FROM lineitem GROUP BY ALL")
def mixed(t, spark):
    """P12."""
    return t("lineitem").groupBy("l_orderkey").agg((F.min("l_returnflag") != F.max("l_returnflag")).alias("mixed"))


@query("q_zero_detection", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def zero_detection(t, spark):
    """Results without detections."""
    return t("orders").select("o_orderkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("q_market_mark", "SELECT count(*) AS n, coalesce(max(event_id), 0) AS last_seq, arg_max(event_type, event_id) AS last_type FROM events")
def market_mark(t, spark):
    """§2.13: the mark that tells an append from a rebuild."""
    return t("events").agg(F.count("*").alias("n"), F.coalesce(F.max("event_id"), F.lit(0)).alias("last_seq"), F.max_by("event_type", "event_id").alias("last_type"))


@query("q_incremental_scan", "SELECT event_id, event_type FROM events WHERE event_id > 900")
def incremental(t, spark):
    """§2.13, A04: rows behind a mark, pushed to the scan."""
    return t("events").where("event_id > 900").select("event_id", "event_type")
