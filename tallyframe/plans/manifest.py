"""Queries that build and audit a manifest: documents stand for files, lang for labels, labels for the QA mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.functions import paths as P
from tallyframe.functions import quality
from tallyframe.operators import ranking as R
from tallyframe.operators import relations as J



def files(t):
    return t("documents").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("md5"))


def _order():
    return [F.length("source"), F.col("source"), F.col("doc_id")]


_DEDUP = "WITH f AS (SELECT doc_id, source, lang, md5(text) AS md5 FROM documents), g AS (SELECT *, count(DISTINCT lang) OVER (PARTITION BY md5) AS labels, row_number() OVER (PARTITION BY md5 ORDER BY length(source), source, doc_id) AS rn FROM f)"


@query("q_md5_priority_dedup", f"{_DEDUP} SELECT doc_id, source, md5 FROM g WHERE labels = 1 AND rn = 1")
def priority_dedup(t, spark):
    """First by priority; groups with conflicting labels go whole."""
    return R.priority_dedup(files(t), "md5", "lang", _order())[0].select("doc_id", "source", "md5")


@query("q_dedup_rejects", f"{_DEDUP} SELECT doc_id, CASE WHEN labels > 1 THEN 'label_conflict' ELSE 'duplicate' END AS reason FROM g WHERE labels > 1 OR rn > 1")
def dedup_rejects(t, spark):
    """The rejects with their reasons."""
    return R.priority_dedup(files(t), "md5", "lang", _order())[1].select("doc_id", "reason")


@query("q_md5_conflict_groups", """WITH f AS (SELECT doc_id, source, lang, md5(text) AS md5 FROM documents), g AS (SELECT md5, count(*) AS n, count(DISTINCT lang) AS labels, count(DISTINCT source) AS sources FROM f GROUP BY ALL HAVING count(*) > 1)
SELECT md5, n, CASE WHEN labels > 1 THEN 'label_conflict' WHEN sources > 1 THEN 'cross_split' ELSE 'same_split' END AS category FROM g""")
def md5_groups(t, spark):
    """Duplicate groups and how grave they are."""
    g = files(t).groupBy("md5").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("labels"), F.count_distinct("source").alias("sources")).where("n > 1")
    return g.select("md5", "n", F.when(F.col("labels") > 1, "label_conflict").when(F.col("sources") > 1, "cross_split").otherwise("same_split").alias("category"))


@query("q_unique_paths", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS paths FROM documents WHERE lang IN ('en', 'de')")
def unique_paths(t, spark):
    """A filtered scan whose paths must be unique."""
    d = t("documents").where(F.col("lang").isin("en", "de")).select("doc_id")
    J.require_empty(d.groupBy("doc_id").count().where("count > 1"), "repeated paths")
    return d.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("paths"))


@query("q_group_cap", """WITH g AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT doc_id, source FROM g WHERE source NOT LIKE '%1%' OR rn <= 10""")
def group_cap(t, spark):
    """At most ten of each capped group, all others."""
    d = t("documents").select("doc_id", "source", "n_chars")
    return R.cap_groups(d, "source", F.contains("source", F.lit("1")), 10, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source")


@query("q_stratified_sample", "WITH g AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS rn FROM documents) SELECT doc_id, source, lang FROM g WHERE rn <= 3")
def stratified(t, spark):
    """L05."""
    return R.first_per_group(t("documents").select("doc_id", "source", "lang"), ["source", "lang"], [F.desc("doc_id")], 3)


@query("q_round_robin", "WITH g AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, source, lang FROM g ORDER BY rn, source, lang LIMIT 75")
def round_robin(t, spark):
    """A feature with a limit, one from each stratum in turn."""
    return R.round_robin(t("documents").select("doc_id", "source", "lang"), ["source", "lang"], [F.col("doc_id")], 75)


@query("q_spaced", """WITH g AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS "at", greatest(1, floor(count(*) OVER (PARTITION BY source) / 4)) AS step FROM documents)
SELECT doc_id, source FROM g WHERE g."at" % step = 0 AND g."at" < step * 4""")
def spaced(t, spark):
    """L07."""
    return R.spaced(t("documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 4)


@query("q_half_split", "WITH g AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), r AS (SELECT source, row_number() OVER (ORDER BY md5('11:' || source)) AS rn, count(*) OVER () AS n FROM g) SELECT source, CASE WHEN rn <= (n + 1) // 2 THEN 'dev' ELSE 'frozen' END AS half FROM r")
def half_split(t, spark):
    """By hash order."""
    return R.half_split(t("documents").select("source"), "source", 11)


@query("q_holdout", "SELECT source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) ORDER BY md5('11:' || source) LIMIT 2")
def holdout(t, spark):
    """Two groups by hash order."""
    return R.holdout(t("documents").select("source"), "source", 11, 2)


@query("q_top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, source LIMIT 5")
def top_sources(t, spark):
    """L13."""
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


_SCORES = "s AS (SELECT p_brand AS run, p_size AS complexity, p_partkey % 5 AS c, round(p_retailprice / 2000, 2) AS score FROM part)"


def runs(t):
    return t("part").select(F.col("p_brand").alias("run"), F.col("p_size").alias("complexity"), (F.col("p_partkey") % 5).alias("c"), F.round(F.col("p_retailprice") / 2000, 2).alias("score"))


@query("q_rank_runs", f"WITH {_SCORES} SELECT run, complexity, c, score FROM s ORDER BY score DESC, complexity, c, run LIMIT 1")
def rank_runs(t, spark):
    """Rounded score, then complexity, parameter and name."""
    return runs(t).orderBy(F.desc("score"), "complexity", "c", "run").limit(1)


@query("q_gate_then_rank", f"""WITH {_SCORES}, ok AS (SELECT * FROM s WHERE score >= 0.9 AND complexity <= 10), pool AS (SELECT * FROM ok UNION ALL SELECT * FROM s WHERE (SELECT count(*) FROM ok) = 0)
SELECT run, complexity, c, score FROM pool ORDER BY complexity, score DESC, c, run LIMIT 1""")
def gate_then_rank(t, spark):
    """The best of those that pass; of all, if none does."""
    s = runs(t)
    passing = s.withColumn("miss", (~((F.col("score") >= 0.9) & (F.col("complexity") <= 10))).cast("int"))
    return passing.orderBy("miss", "complexity", F.desc("score"), "c", "run").limit(1).drop("miss")


@query("q_null_last_choice", f"""WITH {_SCORES} SELECT run, complexity, c, score FROM s ORDER BY coalesce(CASE WHEN c > 0 THEN CAST(c AS DOUBLE) END, 'infinity'::DOUBLE), score, complexity, run LIMIT 1""")
def null_last(t, spark):
    """A missing measure counts as infinite."""
    c = F.coalesce(F.when(F.col("c") > 0, F.col("c").cast("double")), F.lit(float("inf")))
    return runs(t).orderBy(c, "score", "complexity", "run").limit(1)


@query("q_largest_regions", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_extendedprice) AS rn, median(l_quantity) OVER (PARTITION BY l_orderkey) AS med FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM b WHERE rn <= 3 AND l_quantity >= 0.5 * med""")
def largest_regions(t, spark):
    """The k largest of each image, none far smaller than the median."""
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    med = li.groupBy("l_orderkey").agg(F.percentile("l_quantity", F.lit(0.5)).alias("med"))
    top = R.first_per_group(li, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")], 3)
    return top.join(med, "l_orderkey").where(F.col("l_quantity") >= 0.5 * F.col("med")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("q_component_max", "SELECT l_suppkey, max(l_quantity) AS top, arg_max(l_orderkey, (l_quantity, l_orderkey)) AS at FROM lineitem GROUP BY ALL")
def component_max(t, spark):
    """L22."""
    return t("lineitem").groupBy("l_suppkey").agg(F.max("l_quantity").alias("top"), F.max_by("l_orderkey", F.struct("l_quantity", "l_orderkey")).alias("at"))


@query("q_relabel", "SELECT p_size AS value, (dense_rank() OVER (ORDER BY p_size) - 1)::INT AS new FROM (SELECT DISTINCT p_size FROM part)")
def relabel(t, spark):
    """L23."""
    return R.relabel(t("part").select(F.col("p_size").alias("value")), "value").select("value", F.col("new").cast("int").alias("new"))


_LABELS = """l AS (SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN '(no_label)' WHEN 1 THEN 'Dark Roast' WHEN 2 THEN 'Raw|Dark Roast' WHEN 3 THEN 'Maw' WHEN 4 THEN 'Maw|Raw' WHEN 5 THEN 'Odd|Zed|Raw' ELSE 'Light Roast|Light Roast' END AS label_orig FROM part)"""


@query("q_label_map", f"""WITH {_LABELS} SELECT label_orig, CASE label_orig WHEN 'Dark Roast' THEN 'dark' WHEN 'Raw|Dark Roast' THEN 'mixed' WHEN 'Maw|Raw' THEN 'mixed' WHEN 'Light Roast|Light Roast' THEN 'light' END AS label,
CASE label_orig WHEN '(no_label)' THEN 'yolo_no_label' WHEN 'Maw' THEN 'maw_only' WHEN 'Odd|Zed|Raw' THEN 'unknown_class:Odd|Zed' ELSE '' END AS reason FROM l""")
def label_map(t, spark):
    """P13."""
    k = F.col("p_partkey") % 7
    case = F.lit("Light Roast|Light Roast")
    for i, s in enumerate(["(no_label)", "Dark Roast", "Raw|Dark Roast", "Maw", "Maw|Raw", "Odd|Zed|Raw"]):
        case = F.when(k == i, s).otherwise(case)
    label, reason = P.map_label(F.col("label_orig"))
    return t("part").select(case.alias("label_orig")).distinct().select("label_orig", label.alias("label"), reason.alias("reason"))


@query("q_group_regex", """WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'clip' || doc_id % 9 || '_mp4-' || doc_id WHEN 1 THEN 'LINE_ALBUM_' || doc_id % 5 || '_x' WHEN 2 THEN '20260101_10' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || '00' ELSE 'plain' || doc_id END AS stem, CASE WHEN doc_id % 4 = 2 THEN 'rf_hendi' ELSE 'rf_boos' END AS source FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'rf_boos:video:clip' || doc_id % 9 WHEN 1 THEN 'rf_boos:LINE_ALBUM_' || doc_id % 5 WHEN 2 THEN 'rf_hendi:' || substr(stem, 1, 15) ELSE 'rf_boos:file:p/' || stem END AS grp FROM n""")
def group_regex(t, spark):
    """P14."""
    k, i = F.col("doc_id") % 4, F.col("doc_id")
    s = (
        F.when(k == 0, F.concat(F.lit("clip"), i % 9, F.lit("_mp4-"), i)).when(k == 1, F.concat(F.lit("LINE_ALBUM_"), i % 5, F.lit("_x")))
        .when(k == 2, F.concat(F.lit("20260101_10"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("00"))).otherwise(F.concat(F.lit("plain"), i))
    )
    n = t("documents").select("doc_id", s.alias("stem"), F.when(k == 2, "rf_hendi").otherwise("rf_boos").alias("source"))
    return n.select("doc_id", P.group_of(F.col("source"), F.col("stem"), F.concat(F.lit("p/"), F.col("stem"))).alias("grp"))


@query("q_stem", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '(?i)\.rf\.[0-9a-f]+$', '') AS stem FROM pages""")
def stems(t, spark):
    """P15."""
    return t("pages").select("page_id", P.stem(F.col("url")).alias("stem"))


@query("q_category", """SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de') THEN 'drop_not_contract_class' WHEN doc_id % 5 = 0 THEN 'drop_roaster_interior' WHEN doc_id % 5 = 1 THEN 'keep_phone_hd' WHEN doc_id % 5 = 2 THEN 'review_color_cast_few_beans'
WHEN n_chars > 3000 THEN 'review_cluttered_scene' ELSE 'keep_multi_bean_clear' END AS category FROM documents""")
def category(t, spark):
    """P16."""
    k = F.col("doc_id") % 5
    source = F.when(k == 0, "rf_hendi").when(k == 1, "agtron").when(k == 2, "rf_boos").otherwise("rf_robusta")
    label = F.when(F.col("lang") == "en", "light").when(F.col("lang") == "de", "dark")
    return t("documents").select("doc_id", P.category(source, label, F.lit("x"), F.when(F.col("n_chars") > 3000, "full").otherwise("beans")).alias("category"))


@query("q_path_guard", r"""SELECT page_id, CASE WHEN url LIKE '/%' THEN 'absolute' WHEN contains('/' || url || '/', '/../') THEN 'parent' WHEN contains(url, ':') THEN 'drive' END AS reason FROM pages""")
def path_guard(t, spark):
    """P17, S14."""
    return t("pages").select("page_id", P.unsafe_reason(F.col("url")).alias("reason"))


@query("q_survey", r"""SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS dir, regexp_extract(url, '\.([a-z0-9]+)$', 1) AS ext, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY ALL""")
def survey(t, spark):
    """Files and bytes by folder and extension, from lengths alone."""
    return t("pages").groupBy(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("dir"), F.regexp_extract("url", r"\.([a-z0-9]+)$", 1).alias("ext")).agg(F.count("*").alias("files"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))


@query("q_qa_flags", """SELECT d.doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN n_chars > 10000 THEN 'too_long' END, CASE WHEN n_chars <> length(text) THEN 'length_mismatch' END, CASE WHEN contains(text, '###') THEN 'symbols' END, CASE WHEN l.quality = 0 THEN 'low_quality' END, CASE WHEN l.doc_id IS NULL THEN 'no_label' END], lambda x: x IS NOT NULL), ',') AS flags,
coalesce(l.toxic = 1, false) OR n_chars < 20 AS hard_exclude FROM documents d LEFT JOIN labels l USING (doc_id)""")
def qa_flags(t, spark):
    """The rules as one projection; hard ones exclude, others ask for review."""
    l = t("labels").withColumn("covered", F.lit(True))
    d = t("documents").join(l, "doc_id", "left")
    n = F.col("n_chars")
    f = P.flags(too_short=n < 200, too_long=n > 10000, length_mismatch=n != F.length("text"), symbols=F.contains("text", F.lit("###")), low_quality=F.col("quality") == 0, no_label=F.col("covered").isNull())
    return d.select("doc_id", F.array_join(f, ",").alias("flags"), (F.coalesce(F.col("toxic") == 1, F.lit(False)) | (n < 20)).alias("hard_exclude"))


@query("q_flag_frequency", """WITH f AS (SELECT unnest([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'table' END]) AS flag FROM documents) SELECT flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY ALL""")
def flag_frequency(t, spark):
    """A23."""
    n = F.col("n_chars")
    return t("documents").select(F.explode(P.flags(short=n < 500, long=n > 5000, table=F.contains("text", F.lit("|")))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("q_qa_keep", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE NOT coalesce(l.toxic = 1, false)")
def qa_keep(t, spark):
    """The mask must cover its rows; here those that have one."""
    covered = t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return J.keep_by_mask(covered, t("labels"), "doc_id", "toxic")


@query("q_roi", """SELECT p_partkey, CAST(round_even(p_size * 1.5, 0) AS INT) AS x, CAST(round_even(p_size * 0.5, 0) AS INT) AS y FROM part""")
def roi(t, spark):
    """Boxes scaled on each axis, half to even."""
    text = F.concat_ws(",", "p_size", "p_size", F.lit("4"), F.lit("4"))
    r = P.parse_roi(text, F.lit(1.5), F.lit(0.5))
    return t("part").select("p_partkey", r[0].alias("x"), r[1].alias("y"))


@query("q_draft_scale", "SELECT p_partkey, CASE WHEN p_size * 100 >= 3200 THEN 8 WHEN p_size * 100 >= 1600 THEN 4 WHEN p_size * 100 >= 800 THEN 2 ELSE 1 END AS scale FROM part")
def draft_scale(t, spark):
    """S17."""
    w = F.col("p_size") * 100
    return t("part").select("p_partkey", P.draft_scale(w, w - 1, 400).alias("scale"))


@query("q_trigger", """WITH c AS (SELECT l_orderkey, count(*) AS n, list_reverse_sort([count(*) FILTER (WHERE l_returnflag = 'A'), count(*) FILTER (WHERE l_returnflag = 'N'), count(*) FILTER (WHERE l_returnflag = 'R')])[2] AS second FROM lineitem GROUP BY ALL) SELECT l_orderkey, n >= 4 AND second / n >= 0.25 AS would_trigger FROM c""")
def trigger(t, spark):
    """P22."""
    c = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sort_array(F.array(*[F.count_if(F.col("l_returnflag") == x) for x in "ANR"]), False)[1].alias("second"))
    return c.select("l_orderkey", ((F.col("n") >= 4) & (F.col("second") / F.col("n") >= 0.25)).alias("would_trigger"))


#: Measures as digits of a text's hash; of 16 values each.
_DIGITS = ", ".join(f"('0x' || substr(md5(coalesce(text, '')), {i}, 1))::INT AS d{i}" for i in range(1, 17))
_TOLD = {
    "md5(coalesce(text, '')) <> md5(trim(coalesce(text, ''), ' '))": "manifest_hash_mismatch", "d1 NOT BETWEEN 1 AND 8": "exif_orientation_invalid", "d2 = 0": "decode_failed", "d2 > 0 AND d3 = 0": "roi_invalid",
}
_LATER = {
    "n_chars < 128": "low_resolution", "d4 * 8 < 32": "small_bean_bbox", "d5 = 0": "annotation_class_invalid", "d5 > 0 AND d6 % 6 <> d7 % 6": "label_annotation_mismatch", "d7 % 6 = 3": "non_target_mixed", "d7 % 6 > 3": "unknown_label",
    "contains(text, 'Maw')": "ambiguous_maw", "d8 = 1": "low_multiscale_detail", "d9 = 1": "low_texture", "d10 * 4 >= 35 AND d11 / 16 < 0.25": "compression_review", "d12 < 8": "wb_not_applied", "d13 = 1": "pipeline_full_fallback",
    "d14 / 15 < 0.5": "pipeline_background_selection", "(d15 < 8) <> (d12 < 8)": "wb_train_pipeline_mismatch", "d16 / 32 > 0.15": "black_clipping_review",
}
_CASES = ", ".join([*[f"CASE WHEN {c} THEN '{n}' END" for c, n in _TOLD.items()], *[f"CASE WHEN d2 > 0 AND d3 > 0 AND ({c}) THEN '{n}' END" for c, n in _LATER.items()]])


@query("q_quality_rules", f"WITH d AS (SELECT doc_id, text, n_chars, {_DIGITS} FROM documents) SELECT doc_id, array_to_string(list_filter([{_CASES}], lambda x: x IS NOT NULL), ',') AS flags, d2 = 0 OR d3 = 0 AS hard_exclude FROM d")
def quality_rules(t, spark):
    """All rules over measures, which here are digits of a text's hash and its length."""
    text = F.coalesce("text", F.lit(""))
    d = lambda i: F.conv(F.substring(F.md5(text), i, 1), 16, 10).cast("int")
    label = lambda i: F.element_at(F.array(*map(F.lit, ("light", "medium", "dark", "mixed", "other", "light "))), d(i) % 6 + 1)
    measured = t("documents").select(
        "doc_id", F.md5(text).alias("md5"), F.md5(F.trim(text)).alias("md5_actual"), (d(2) > 0).alias("decoded"), (d(3) > 0).alias("roi_fits"), d(1).alias("orientation"), F.col("n_chars").alias("view_short"),
        (d(4) * 8).alias("box_short_median"), (d(5) > 0).alias("annotation_class_known"), label(6).alias("annotation_label"), label(7).alias("label"), F.col("text").alias("label_orig"), (d(8) == 1).alias("blurred"),
        (d(9) == 1).alias("textureless"), (d(10) * 4).alias("mean_quantizer"), (d(11) / 16).alias("bytes_per_pixel"), (d(12) >= 8).alias("white_balanced"), F.when(d(13) == 1, "full").otherwise("beans").alias("mode"),
        (d(14) / 15).alias("selected_inside_boxes"), (d(15) >= 8).alias("boxes_white_balanced"), (d(16) / 32).alias("black_clipped"),
    )
    return quality.judged(measured).select("doc_id", F.array_join("flags", ",").alias("flags"), "hard_exclude")
