"""Queries on single results, gates, benchmark records, folds by source, and files written and read back."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.functions import results as R
from tallyframe.operators import metrics as M
from tallyframe.sources import archives, manifest, sinks
from tallyframe.storage import scratch

_PER = "SELECT o_orderkey, count(l_orderkey) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, o_orderkey % 5 AS k FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


def detections(t) -> DataFrame:
    """Of each order its lines' classes as labels, in the order of the contract's classes."""
    name = F.when(F.col("l_returnflag") == "A", "light").when(F.col("l_returnflag") == "N", "medium").otherwise("dark")
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(name).alias("labels"))
    return t("orders").select("o_orderkey").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


@query("q_count_method", f"""WITH c AS ({_PER}) SELECT o_orderkey, CASE WHEN k = 3 THEN NULL ELSE a END AS light, CASE WHEN k = 3 THEN NULL WHEN k IN (1, 2) THEN 'estimated' ELSE 'exact' END AS count_method,
CASE WHEN k = 3 THEN NULL ELSE array_to_string(list_filter([CASE WHEN k = 4 THEN 'blurry' END, CASE WHEN total = 0 THEN 'no_beans_detected' END, CASE WHEN (a > 0)::INT + (n > 0)::INT + (r > 0)::INT > 1 THEN 'mixed_roast' END, CASE WHEN k IN (1, 2) THEN 'bean_count_estimated' END], lambda x: x IS NOT NULL), ',') END AS warnings FROM c""")
def count_method(t, spark):
    """Counts, method and warnings of each result; a count that is not that of its detections has none."""
    k = F.col("o_orderkey") % 5
    given = F.when(k == 1, F.array(F.lit("bean_count_estimated"))).when(k == 4, F.array(F.lit("blurry"), F.lit("odd"), F.lit("mixed_roast"))).otherwise(F.array().cast("array<string>"))
    n = F.size("labels") + F.when(k == 3, 1).otherwise(0)
    s = detections(t).select("o_orderkey", R.count_summary(n, F.col("labels"), F.when(k == 2, "estimated"), given).alias("s"))
    return s.select("o_orderkey", F.col("s.counts.light").alias("light"), F.col("s.count_method").alias("count_method"), F.array_join("s.warnings", ",").alias("warnings"))


@query("q_detection_rules", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' AND l_quantity + l_linenumber <= 50 AND l_tax * 15 <= 1 AS good FROM lineitem""")
def detection_rules(t, spark):
    """Boxes, labels and confidences that the contract allows."""
    box = F.array(F.col("l_linenumber").cast("double"), F.lit(0.0), F.col("l_quantity").cast("double"), F.lit(5.0))
    label = F.when(F.col("l_returnflag") == "A", "light").when(F.col("l_returnflag") == "N", "dark").otherwise("green")
    d = F.array(F.struct(box.alias("bbox"), label.alias("label"), (F.col("l_tax") * 15).cast("double").alias("conf")))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.clean_detections(d, F.lit(50), F.lit(50)).isNotNull().alias("good"))


@query("q_result_violations", """WITH e AS (SELECT event_id, event_id % 9 AS k, round(value, 2) AS v FROM events) SELECT event_id, array_to_string(list_filter([CASE WHEN k = 1 THEN 'key_set' END, CASE WHEN k = 2 THEN 'status' END, CASE WHEN k = 3 THEN 'unknown_warning' END, CASE WHEN k = 4 THEN 'failed_with_values' END,
CASE WHEN k = 5 THEN 'probability_sum' END, CASE WHEN k = 6 THEN 'count_by_class' END, CASE WHEN k <> 4 AND (v < 0 OR v + 10 > 100) THEN 'box_outside' END, CASE WHEN k = 7 THEN 'mixed_warning' END, CASE WHEN k = 8 THEN 'estimate_warning' END], lambda x: x IS NOT NULL), ',') AS violations FROM e""")
def result_violations(t, spark):
    """The codes that results break; where a box ends follows the event's value."""
    k, v = F.col("event_id") % 9, F.round("value", 2)
    at = lambda i, yes, no: F.when(k == i, yes).otherwise(no)
    bean = lambda label: F.concat(F.lit('{"bbox":['), v.cast("string"), F.lit(f',1,10,10],"label":"{label}","conf":0.9}}'))
    parts = [
        at(1, "{", '{"model":"m",'), at(2, '"status":"odd"', at(4, '"status":"error"', '"status":"ok"')), ',"label":"light","label_th":"x","message_th":"m","confidence":0.9,', at(5, '"probs":{"light":0.9,"medium":0.2,"dark":0.1}', '"probs":{"light":0.9,"medium":0.05,"dark":0.05}'),
        at(3, ',"warnings":["odd"]', at(7, ',"warnings":["mixed_roast"]', ',"warnings":[]')), ',"n_beans":2,"proportions":{"light":1.0,"medium":0.0,"dark":0.0},"beans":[', bean("light"), ",", at(6, bean("dark"), bean("light")),
        '],"timing_ms":{"decode":1,"ml":2,"total":3},"schema_version":3,"counts":{"light":2,"medium":0,"dark":0},', at(8, '"count_method":"estimated"', '"count_method":"exact"'), ',"image_size":[100,100]}',
    ]
    text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    told = R.with_violations(t("events").select("event_id", text.alias("result")), "result")
    return told.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("q_failure_rows", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'bad_image' ELSE 'error' END AS status, true AS empty, greatest(0.0, floor(abs(value)) - 1.5) AS ml, 16 AS n_keys FROM events""")
def failure_rows(t, spark):
    """P28."""
    row = R.failure_row(F.when(F.col("event_id") % 2 == 0, "bad_image").otherwise("error"), F.lit("m"), F.lit("b1"), F.lit(1.5), F.floor(F.abs("value")).cast("double"), F.array(F.lit(1), F.lit(2)))
    x = t("events").select("event_id", row.alias("r"))
    empty = F.coalesce("r.label", F.to_json("r.probs"), F.to_json("r.counts"), F.col("r.n_beans").cast("string")).isNull() & (F.size("r.beans") == 0)
    n_keys = F.size(F.json_object_keys(F.to_json("r", {"ignoreNullFields": "false"})))
    return x.select("event_id", F.col("r.status").alias("status"), empty.alias("empty"), F.col("r.timing_ms.ml").alias("ml"), n_keys.alias("n_keys"))


@query("q_messages", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Light' ELSE 'Dark' END || CASE WHEN event_id % 3 = 0 THEN ' (' ELSE '? (' END || CAST(event_id % 100 AS VARCHAR) || '%)' || CASE WHEN event_id % 5 = 0 THEN ' · more light · hold still' ELSE '' END AS message FROM events""")
def messages(t, spark):
    """P29."""
    i = F.col("event_id")
    w = F.when(i % 5 == 0, F.array(F.lit("low_light"), F.lit("blurry"))).otherwise(F.array().cast("array<string>"))
    m = R.message(F.when(i % 3 == 0, "ok").otherwise("low_confidence"), F.when(i % 2 == 0, "light").otherwise("dark"), (i % 100) / 100.0, w, "{label} ({percent})", "{label}? ({percent})", {"light": "Light", "dark": "Dark"}, {"low_light": "more light", "blurry": "hold still"})
    return t("events").select("event_id", m.alias("message"))


@query("q_variants", """WITH v AS (SELECT p_size AS card, CASE WHEN p_partkey % 23 = 0 THEN '__' ELSE 'v_' || (p_partkey % 4) END AS variant, round(avg(p_retailprice), 2) AS w, p_size % 5 AS k FROM part WHERE p_size % 7 > 0 AND p_size <= 40 GROUP BY ALL),
c AS (SELECT DISTINCT p_size AS card, CASE WHEN p_size % 6 = 0 THEN 'group' ELSE 'image_prior' END AS mode, CASE WHEN p_size % 7 > 0 AND p_size <= 40 THEN 'v_' || (p_size % 4) END AS d FROM part),
o AS (SELECT c.*, CASE WHEN c.card % 8 = 0 THEN 1 ELSE w END AS own FROM c LEFT JOIN v ON c.card = v.card AND variant = d),
q AS (SELECT p_partkey, p_size AS card, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'v_' || (p_partkey % 5) END AS requested FROM part),
x AS (SELECT q.*, mode, coalesce(own, 0) AS own, v.w, coalesce(q.requested, d) AS variant, (SELECT count(*) FROM v WHERE v.card = q.card) AS n, (SELECT count(*) FROM v WHERE v.card = q.card AND variant = '__') AS bad, (SELECT any_value(w) FROM v WHERE v.card = q.card AND variant = d) AS dw
FROM q JOIN o ON q.card = o.card LEFT JOIN v ON q.card = v.card AND v.variant = coalesce(requested, d)),
f AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN variant IS NOT NULL THEN 'undeclared' END WHEN mode <> 'image_prior' THEN 'mode' WHEN bad > 0 THEN 'malformed' WHEN dw IS NULL OR dw <> own THEN 'default' WHEN w IS NULL THEN 'unknown' END AS fault FROM x)
SELECT p_partkey, CASE WHEN fault IS NULL THEN variant END AS chosen, CASE WHEN fault IS NULL THEN CASE WHEN n = 0 THEN own ELSE w END END AS prior_weight, fault FROM f""")
def variants(t, spark):
    """Each part asks the card of its size for a variant, or for the default."""
    p = t("part")
    k, some = F.col("p_size"), (F.col("p_size") % 7 > 0) & (F.col("p_size") <= 40)
    name = lambda x: F.concat(F.lit("v_"), x.cast("string"))
    own = F.when(F.col("p_partkey") % 23 == 0, "__").otherwise(name(F.col("p_partkey") % 4))
    told = p.where(some).groupBy(k.alias("card"), own.alias("variant")).agg(F.round(F.avg("p_retailprice"), 2).alias("prior_weight")).withColumn("label", F.col("variant"))
    cards = p.select(k.alias("card"), F.when(k % 6 == 0, "group").otherwise("image_prior").alias("mode"), F.when(some, name(k % 4)).alias("default_variant")).distinct()
    default = told.select("card", F.col("variant").alias("default_variant"), "prior_weight")
    cards = cards.join(default, ["card", "default_variant"], "left").withColumn("prior_weight", F.when(F.col("card") % 8 == 0, 1.0).otherwise(F.col("prior_weight")))
    asked = p.select("p_partkey", k.alias("card"), F.when(F.col("p_partkey") % 3 > 0, name(F.col("p_partkey") % 5)).alias("requested"))
    # a card and name asked for by several parts is resolved once
    found = R.resolved_variants(cards, told, asked.select("card", "requested").distinct())
    met = asked.join(found.withColumnRenamed("card", "_card").withColumnRenamed("requested", "_requested"), (F.col("card") == F.col("_card")) & F.col("requested").eqNullSafe(F.col("_requested")))
    return met.select("p_partkey", "chosen", "prior_weight", "fault")


@query("q_gate_interval", """WITH g AS (SELECT l_linestatus, count(*)::DOUBLE AS n, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS k FROM lineitem GROUP BY ALL), w AS (SELECT l_linestatus, k / n AS v, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS half FROM g)
SELECT l_linestatus, v >= 0.25 AS passed, mid - half < 0.25 AS crosses FROM w""")
def gate_interval(t, spark):
    """A share against its gate, and whether its Wilson interval reaches over."""
    g = t("lineitem").groupBy("l_linestatus").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("k"))
    v, n, z = F.col("k") / F.col("n"), F.col("n"), 3.8416
    mid, half = (v + z / (2 * n)) / (1 + z / n), 1.96 * F.sqrt(v * (1 - v) / n + z / (4 * n * n)) / (1 + z / n)
    s = g.select("l_linestatus", R.gate(v, mid - half, mid + half, 0.25, True).alias("s"))
    return s.select("l_linestatus", "s.passed", "s.crosses")


@query("q_record_faults", """WITH r AS (SELECT event_id, event_type AS profile, (event_id // 7) % 25 AS iteration, CASE WHEN event_id % 11 = 0 THEN 'odd' WHEN ((event_id // 7) % 25) % 2 = 1 THEN 'empty' ELSE 'pile' END AS scene, value FROM events),
o AS (SELECT *, CASE WHEN profile NOT IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2) OR iteration NOT BETWEEN 1 AND 20 THEN 'profile_or_iteration' WHEN scene <> CASE WHEN iteration % 2 = 1 THEN 'empty' ELSE 'pile' END THEN 'scene' WHEN value IS NULL OR value < 0 THEN 'number' END AS own FROM r)
SELECT event_id, CASE WHEN own IS NULL AND event_id > min(event_id) FILTER (WHERE own IS NULL) OVER (PARTITION BY profile, iteration) THEN 'duplicate' ELSE own END AS fault FROM o""")
def record_faults(t, spark):
    """Benchmark records by profile, iteration, scene and finite figures; repeats go."""
    e = t("events")
    profiles = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    i = F.expr("int(floor(event_id / 7) % 25)")
    scene = F.when(F.col("event_id") % 11 == 0, "odd").when(i % 2 == 1, "empty").otherwise("pile")
    rows = e.select("event_id", F.col("event_type").alias("profile"), i.alias("iteration"), scene.alias("scene"), "value")
    return R.record_faults(rows, profiles, ["empty", "pile"] * 10, ["value"], F.col("event_id")).select("event_id", "fault")


@query("q_ece_half_open", """WITH p AS (SELECT l_discount * 10 AS conf, (l_returnflag = 'N')::INT AS hit FROM lineitem), s AS (SELECT unnest(range(10)) AS bin), b AS (SELECT bin, count(conf) AS n, avg(hit) AS acc, avg(conf) AS c FROM s LEFT JOIN p ON conf >= bin / 10.0::DOUBLE AND (conf < (bin + 1) / 10.0::DOUBLE OR bin = 9 AND conf <= 1) GROUP BY bin)
SELECT round(sum(n * abs(acc - c)) / (SELECT count(*) FROM p), 6) AS ece FROM b WHERE n > 0""")
def ece_half_open(t, spark):
    """Bins closed below and open above, the last closed; borders are compared, not computed from the value."""
    p = t("lineitem").select((F.col("l_discount") * 10).alias("conf"), (F.col("l_returnflag") == "N").alias("hit"))
    return M.half_open_error(p, F.col("hit"), F.col("conf")).select(F.round("ece", 6).alias("ece"))


@query("q_leave_one_out", """WITH f AS (SELECT DISTINCT lang AS fold FROM documents WHERE lang IS NOT NULL) SELECT fold, count(*) FILTER (WHERE lang <> fold AND n_chars > 200) AS train, count(*) FILTER (WHERE lang = fold) AS test, round(avg(n_chars) FILTER (WHERE lang <> fold AND n_chars > 200), 4) AS mean FROM f, documents GROUP BY fold""")
def loso(t, spark):
    """Each language once as the test fold; what the other rows give (here a mean) is their total less its own, so
    one pass over the rows serves all folds."""
    d, use = t("documents").where("lang is not null"), F.col("n_chars") > 200
    per = d.groupBy("lang").agg(F.count_if(use).alias("n"), F.coalesce(F.sum(F.when(use, F.col("n_chars"))), F.lit(0)).alias("s"), F.count("*").alias("test"))
    n, total = per.agg(F.sum("n"), F.sum("s")).first()
    train = F.lit(n or 0) - F.col("n")
    return per.select(F.col("lang").alias("fold"), train.alias("train"), "test", F.round((F.lit(total or 0) - F.col("s")) / F.when(train > 0, train), 4).alias("mean"))


@query("q_stub_results", "SELECT doc_id, ['light', 'medium', 'dark'][(('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT % 3)::INT + 1] AS label, ('0x' || substr(md5('7:' || doc_id), 9, 8))::BIGINT % 40 AS n_beans FROM documents")
def stub(t, spark):
    """Made-up results that depend on seed and key alone."""
    h = F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))
    number = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return t("documents").select("doc_id", F.element_at(F.array(F.lit("light"), F.lit("medium"), F.lit("dark")), (number(1) % 3 + 1).cast("int")).alias("label"), (number(9) % 40).alias("n_beans"))


# ---------------------------------------------------------------- files


@query("q_csv_round_trip", "SELECT s_suppkey, s_name, '[' || s_nationkey || ',' || s_suppkey || ']' AS pair FROM supplier")
def csv_round_trip(t, spark):
    """A table with a nested column, written as CSV and read again."""
    where = scratch(spark, "csv")
    sinks.write_csv(t("supplier").select("s_suppkey", "s_name", F.array("s_nationkey", "s_suppkey").alias("pair")), where, once=True)
    return spark.read.csv(where, header=True, schema="s_suppkey long, s_name string, pair string", escape='"')


@query("q_semicolon_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def semicolon_csv(t, spark):
    """A ;-separated file."""
    where = scratch(spark, "semicolon")
    t("nation").select("n_nationkey", "n_name").write.csv(where, header=True, sep=";")
    return manifest.read_semicolon_csv(spark, where)


@query("q_json_round_trip", "SELECT event_id, value FROM events WHERE value IS NOT NULL")
def json_round_trip(t, spark):
    """Strict JSON, written once."""
    where = scratch(spark, "json")
    sinks.write_json(t("events").where("value is not null").select("event_id", "value"), where, once=True)
    return spark.read.schema("event_id long, value double").json(where)


@query("q_prediction_file", "SELECT CAST(doc_id AS VARCHAR) AS path, lang AS label, 0.5::DOUBLE AS prob_light, round((doc_id % 5) / 10.0::DOUBLE, 6) AS prob_medium FROM documents WHERE lang IS NOT NULL")
def prediction_file(t, spark):
    """A prediction file, its probabilities checked."""
    where = scratch(spark, "predictions")
    m = (F.col("doc_id") % 5) / 10.0
    p = [F.lit(0.5).alias("p_light"), m.alias("p_medium"), (0.5 - m).alias("p_dark")]
    t("documents").where("lang is not null").select(F.col("doc_id").alias("path"), F.col("lang").alias("label"), *p).write.csv(where, header=True)
    return manifest.read_predictions(spark, where, "p_").select("path", "label", "prob_light", F.round("prob_medium", 6).alias("prob_medium"))


@query("q_annotation_issues", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN 'field_count' WHEN 1 THEN CASE WHEN l_discount <= 0 THEN 'empty_box' ELSE '' END WHEN 2 THEN 'out_of_bounds' ELSE 'not_a_number' END AS issues FROM lineitem")
def annotation_issues(t, spark):
    """What is wrong with each line of an annotation file."""
    n = F.col("l_linenumber") % 4
    line = F.when(n == 0, "0 0.5 0.5 0.1").when(n == 1, F.concat(F.lit("0 0.5 0.5 "), F.col("l_discount").cast("string"), F.lit(" 0.2"))).when(n == 2, "1 0.95 0.5 0.2 0.2").otherwise("1 x 0.5 0.2 0.2")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("value"))
    return manifest.annotation_issues(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("issues", ",").alias("issues"))


@query("q_cache_refill", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 10 * n_chars + 1 ELSE n_chars END AS value FROM documents")
def cache_refill(t, spark):
    """What a cache lacks is computed, and then all rows must be in it. Cached values differ from computed ones,
    and those of another configuration do not count."""
    d = t("documents").select("doc_id", "n_chars")
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    config = F.when(F.col("doc_id") % 3 == 0, digest("now")).otherwise(digest("before"))
    cache = d.where("doc_id % 3 < 2").select("doc_id", (10 * F.col("n_chars") + 1).alias("value"), config.alias("config"))
    return manifest.refill(cache, d, "doc_id", lambda rows: rows.select("doc_id", F.col("n_chars").alias("value")), digest("now"))


@query("q_photo_devices", "SELECT c_custkey, coalesce(n_name, '?') AS device FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 > 0) ON c_nationkey = n_nationkey WHERE c_custkey % 10 > 0")
def photo_devices(t, spark):
    """Photos with their devices; identical repeats count once, conflicting ones go."""
    c = t("customer").select(F.col("c_custkey").alias("name_paper"), F.col("c_nationkey").alias("device_id"))
    photos = c.unionByName(c.where("name_paper % 10 = 1")).unionByName(c.where("name_paper % 10 = 0").withColumn("device_id", F.col("device_id") + 1))
    devices = t("nation").where("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("device_id"), F.col("n_name").alias("name"))
    return manifest.photos_with_devices(photos, devices)[0].select(F.col("name_paper").alias("c_custkey"), "device")


@query("q_archive_members", """WITH m AS (SELECT page_id // 4 AS archive, CASE WHEN html IS NULL THEN '' ELSE html END AS html, url, regexp_replace(coalesce(url, ''), '^https://', '') || '.html' AS name FROM pages)
SELECT archive, count(*) AS members, sum(octet_length(encode(html)))::BIGINT AS bytes, max(md5(html)) AS last_md5, CASE WHEN bool_or(contains(name, ':')) THEN 'drive' WHEN count(DISTINCT lower(name)) < count(*) THEN 'repeated' END AS reason FROM m GROUP BY archive""")
def archive_members(t, spark):
    """Pages packed by fours under their addresses and read as archives; an address that keeps its scheme
    (http:) or is there twice refuses the archive."""
    name = F.concat(F.regexp_replace(F.coalesce("url", F.lit("")), "^https://", ""), F.lit(".html"))
    pages = t("pages").select(F.expr("page_id div 4").alias("archive"), name.alias("name"), F.coalesce("html", F.lit("")).alias("html"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, html in zip(rows["name"], rows["html"], strict=True):
                z.writestr(name, html)
        return pd.DataFrame({"archive": rows["archive"].iloc[:1], "content": [out.getvalue()]})

    found = archives.members(pages.groupBy("archive").applyInPandas(packed, "archive long, content binary"), "archive", "content")
    return found.groupBy("archive").agg(F.count("member").alias("members"), F.sum(F.octet_length("content")).alias("bytes"), F.max(F.md5("content")).alias("last_md5"), F.min("reason").alias("reason"))
