"""Queries on joins, guards, set operations, similarity and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.operators import relations as J
from tallyframe.operators.graph import connected_components
from tallyframe.operators.selection import percentiles

_BITS = """h AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS b, label FROM embeddings)"""


def sign_bits(t):
    """The signs of 64 components as one BIGINT."""
    bits = F.aggregate(
        F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)
    )
    return t("embeddings").select("vec_id", bits.alias("h"), "label")


@query("q_left_lookup_default", "SELECT s_suppkey, coalesce(n_name, '?') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON s_nationkey = n_nationkey")
def left_lookup(t, spark):
    """A dimension's name, ? where it is unknown."""
    dim = t("nation").where(F.col("n_nationkey") % 3 > 0).select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.lookup(t("supplier").select("s_suppkey", "s_nationkey"), dim, "s_nationkey", "n_name", "?").select("s_suppkey", "n_name")


@query("q_same_population", "SELECT r_name, nations, customers FROM region JOIN (SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY ALL) ON r_regionkey = n_regionkey JOIN (SELECT n_regionkey AS k, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) ON r_regionkey = k")
def same_population(t, spark):
    """Figures of three tables that must cover the same regions, each once: a region without a nation or customer
    is refused."""
    nations = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"))
    lives = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    customers = lives.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("customers"))
    both = J.same_population(t("region").select("r_regionkey", "r_name"), nations, "r_regionkey")
    return J.same_population(both, customers, "r_regionkey").select("r_name", "nations", "customers")


@query("q_residual_pairs", """WITH f AS (SELECT md5(text) AS m, min(doc_id) AS a FROM documents WHERE text IS NOT NULL GROUP BY 1), p AS (SELECT f.a, d.doc_id AS b FROM documents d JOIN f ON md5(d.text) = m WHERE d.doc_id > f.a)
SELECT a, b, x.source AS group_a, y.source AS group_b FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.source IS DISTINCT FROM y.source OR x.source IS NULL""")
def residual(t, spark):
    """Copies (each with the first of its text) that the grouping by source would part."""
    d = t("documents").where("text is not null").select("doc_id", F.md5("text").alias("m"))
    first = d.groupBy("m").agg(F.min("doc_id").alias("a"))
    pairs = d.join(first, "m").where("doc_id > a").select("a", F.col("doc_id").alias("b"))
    return J.residual_pairs(pairs, t("documents").select("doc_id", "source"), "doc_id", "source")


@query("q_guarded_groups", "SELECT doc_id, md5(text) AS grp FROM documents WHERE text IS NOT NULL")
def guarded_groups(t, spark):
    """Documents with a grouping that keeps all copies together; one that parted a pair would be refused."""
    d = t("documents").where("text is not null").select("doc_id", F.md5("text").alias("grp"))
    pairs = d.join(d.groupBy("grp").agg(F.min("doc_id").alias("a")), "grp").where("doc_id > a").select("a", F.col("doc_id").alias("b"))
    return J.guarded(d.select("doc_id"), d, pairs, "doc_id", "grp")


@query("q_population_diff", """SELECT c_custkey, 'a' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'b' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def population_diff(t, spark):
    """J04, J08, G02, G04."""
    return J.population_diff(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("q_update_join", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 1 ELSE d.n_chars END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_join(t, spark):
    """J05."""
    new = t("labels").where("quality = 1").select("doc_id", F.lit(1).cast("long").alias("n_chars"))
    return J.update_join(t("documents").select("doc_id", "n_chars"), new, "doc_id", ["n_chars"])


@query("q_semi_safe", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def semi_safe(t, spark):
    """J06, S23, S24."""
    return t("documents").select("doc_id").join(t("labels").where("toxic = 0").select("doc_id"), "doc_id", "left_semi")


@query("q_anti_frozen", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def anti_frozen(t, spark):
    """Rows of frozen groups go."""
    d = t("documents").select("doc_id", "source")
    frozen = t("documents").where(F.col("source").isin("src1", "src2")).select("source").distinct()
    return d.join(frozen, "source", "left_anti").select("doc_id", "source")


@query("q_cache_miss", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_miss(t, spark):
    """The rows that a cache lacks."""
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("q_group_intersection", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def intersection(t, spark):
    """Groups on both sides of a split."""
    d = t("documents")
    return d.where("lang = 'en'").select("source").intersect(d.where("lang = 'de'").select("source"))


@query("q_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(t, spark):
    """G01, G05."""
    return t("supplier").select(F.col("s_nationkey").alias("k")).unionByName(t("customer").select(F.col("c_nationkey").alias("k"))).distinct()


@query("q_similarity_self", f"""WITH {_BITS} SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.b, b.b), lambda p: (p[1] <> p[2])::INT))::INT AS distance, a.label = b.label AS same_label FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE distance <= 15""")
def similarity_self(t, spark):
    """Lossless bands, then popcount."""
    return J.hamming_join(sign_bits(t), "vec_id", "h", 15, ("label",)).select("a", "b", "distance", (F.col("label_a") == F.col("label_b")).alias("same_label"))


@query("q_similarity_cross", f"""WITH {_BITS} SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_sum(list_transform(list_zip(a.b, b.b), lambda p: (p[1] <> p[2])::INT)) <= 16""")
def similarity_cross(t, spark):
    """Across sources only."""
    return J.hamming_join(sign_bits(t), "vec_id", "h", 16, ("label",)).where("label_a <> label_b").select("a", "b")


@query("q_duplicate_sensitivity", f"""WITH {_BITS}, p AS (SELECT list_sum(list_transform(list_zip(a.b, b.b), lambda p: (p[1] <> p[2])::INT)) AS d FROM h a JOIN h b ON a.vec_id < b.vec_id), th AS (SELECT unnest([13, 14, 15, 16]) AS threshold)
SELECT threshold::INT AS threshold, count(*) FILTER (WHERE d <= threshold) AS pairs FROM p, th GROUP BY ALL""")
def sensitivity(t, spark):
    """Pairs at each threshold, from one join at the widest."""
    p = J.hamming_join(sign_bits(t), "vec_id", "h", 16)
    th = F.explode(F.array(*[F.lit(x) for x in (13, 14, 15, 16)])).alias("threshold")
    return p.select("distance", th).groupBy("threshold").agg(F.count_if(F.col("distance") <= F.col("threshold")).alias("pairs"))


@query("q_identity_class", """WITH f AS (SELECT doc_id, doc_id // 10 AS stem, md5(text) AS md5, n_chars FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.md5 = b.md5 THEN 'md5' WHEN abs(a.n_chars - b.n_chars) <= 50 THEN 'phash' ELSE 'different' END AS identity FROM f a JOIN f b ON a.stem = b.stem AND a.doc_id < b.doc_id""")
def identity_class(t, spark):
    """Pairs of one stem: the same bytes, close, or different."""
    f = t("documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("stem"), F.md5("text").alias("md5"), "n_chars")
    a, b = f.alias("a"), f.alias("b")
    p = a.join(b, (F.col("a.stem") == F.col("b.stem")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    kind = F.when(F.col("a.md5") == F.col("b.md5"), "md5").when(F.abs(F.col("a.n_chars") - F.col("b.n_chars")) <= 50, "phash").otherwise("different")
    return p.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), kind.alias("identity"))


_BOX = """b AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box, l_discount * 500 AS x0, l_tax * 500 AS y0, l_discount * 500 + l_quantity AS x1, l_tax * 500 + l_quantity AS y1 FROM lineitem),
p AS (SELECT a.image, a.box AS a, c.box AS b, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM b a JOIN b c ON a.image = c.image AND a.box < c.box)"""


def boxes(t):
    n = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)").cast("long")
    x, y, q = F.col("l_discount") * 500, F.col("l_tax") * 500, F.col("l_quantity")
    return t("lineitem").select(F.col("l_orderkey").alias("image"), n.alias("box"), x.alias("x0"), y.alias("y0"), (x + q).alias("x1"), (y + q).alias("y1"))


@query("q_iou_pairs", f"WITH {_BOX} SELECT image, a, b, round(i / greatest(s - i, 1e-9), 6) AS iou FROM p WHERE i / greatest(s - i, 1e-9) > 0.5")
def iou_pairs(t, spark):
    """J13."""
    return J.box_pairs(boxes(t), "image", "box").where("iou > 0.5").select("image", "a", "b", F.round("iou", 6).alias("iou"))


@query("q_overlap_share", f"WITH {_BOX}, o AS (SELECT image, a AS box FROM p WHERE i / greatest(s - i, 1e-9) > 0.05 UNION SELECT image, b FROM p WHERE i / greatest(s - i, 1e-9) > 0.05), n AS (SELECT image, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT image, count(*) AS k FROM o GROUP BY ALL) SELECT image, round(coalesce(k, 0) / n, 6) AS share FROM n LEFT JOIN k USING (image)")
def overlap_share(t, spark):
    """J14."""
    return J.overlap_share(boxes(t), "image", "box").select("image", F.round("share", 6).alias("share"))


@query("q_containment", f"WITH {_BOX}, m AS (SELECT *, median((x1 - x0) * (y1 - y0)) OVER (PARTITION BY image) AS med FROM b) SELECT m.image, m.box, count(*) AS inside FROM m JOIN b ON m.image = b.image AND m.box <> b.box AND (b.x0 + b.x1) / 2 BETWEEN m.x0 AND m.x1 AND (b.y0 + b.y1) / 2 BETWEEN m.y0 AND m.y1 WHERE (m.x1 - m.x0) * (m.y1 - m.y0) >= 2 * m.med GROUP BY ALL HAVING count(*) >= 2")
def containment(t, spark):
    """J15."""
    return J.containers(boxes(t), "image", "box", 2, 2.0)


_IQR = "g AS (SELECT l_returnflag AS source, l_linestatus AS label, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3, median(l_extendedprice) AS med FROM lineitem GROUP BY ALL)"


def quartiles(t):
    li = t("lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("label"), "l_extendedprice")
    g = percentiles(li, ["source", "label"], {"q": "l_extendedprice"}, [0.25, 0.5, 0.75])
    return g.select("_key.*", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"))


@query("q_iqr_overlap", f"WITH {_IQR} SELECT a.source AS source_a, a.label AS label_a, b.source AS source_b, b.label AS label_b, round(least(a.q3, b.q3) - greatest(a.q1, b.q1), 4) AS overlap FROM g a JOIN g b ON a.source <> b.source AND a.label < b.label WHERE least(a.q3, b.q3) > greatest(a.q1, b.q1)")
def iqr_overlap(t, spark):
    """Over the table of groups, a row for each source and label."""
    a, b = quartiles(t).alias("a"), quartiles(t).alias("b")
    width = F.least("a.q3", "b.q3") - F.greatest("a.q1", "b.q1")
    p = a.join(b, (F.col("a.source") != F.col("b.source")) & (F.col("a.label") < F.col("b.label")))
    return p.where(width > 0).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("source", "label")], F.round(width, 4).alias("overlap"))


@query("q_inversions", f"WITH {_IQR} SELECT a.source AS source_a, b.source AS source_b FROM g a JOIN g b ON a.label = 'F' AND b.label = 'O' WHERE a.med > b.med")
def inversions(t, spark):
    """A darker class with a higher median than a lighter one."""
    a, b = quartiles(t).where("label = 'F'").alias("a"), quartiles(t).where("label = 'O'").alias("b")
    return a.join(b, F.col("a.med") > F.col("b.med")).select(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"))


@query("q_leakage", f"""WITH {_BITS} SELECT DISTINCT 'passage' AS leg, d.doc_id AS id FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)
UNION SELECT 'bytes', doc_id FROM documents WHERE doc_id % 5 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0)
UNION SELECT 'phash', a.vec_id FROM h a JOIN h b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 WHERE list_sum(list_transform(list_zip(a.b, b.b), lambda p: (p[1] <> p[2])::INT)) <= 6""")
def leakage_whole(t, spark):
    """J18 on whole texts, all three legs: documents that contain a whole benchmark text at any place, test rows whose
    bytes a training row has, and test vectors whose sign bits are within Hamming 6 of a training row's."""
    d = t("documents").select(F.col("doc_id").alias("id"), "text")
    passage = J.containing(d, "text", t("benchmark").select("text"), "text")
    keyed = d.select("id", F.md5("text").alias("m"))
    same = J.on_both_sides(keyed, "m", F.col("id") % 5 == 0)
    near = J.near_other_side(sign_bits(t).withColumnRenamed("vec_id", "id"), "h", 6, F.col("id") % 5 == 0)
    legs = [x.select(F.lit(leg).alias("leg"), "id") for leg, x in (("passage", passage), ("bytes", same), ("phash", near))]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).distinct()


@query("q_group_map_cover", "SELECT n_name AS grp, r_name AS inner_grp FROM nation JOIN region ON n_regionkey = r_regionkey")
def group_map(t, spark):
    """A map that must cover all groups."""
    n, r = t("nation"), t("region")
    J.require_empty(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti"), "groups without a map entry")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("grp"), F.col("r_name").alias("inner_grp"))


_REACH = f"""WITH RECURSIVE {_BITS}, e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.label = b.label WHERE list_sum(list_transform(list_zip(a.b, b.b), lambda p: (p[1] <> p[2])::INT)) <= 18),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach(node, r) AS (SELECT a, a FROM s UNION SELECT reach.node, s.b FROM reach JOIN s ON s.a = reach.r)"""


def same_label_links(t):
    """Links within one source only."""
    return J.hamming_join(sign_bits(t), "vec_id", "h", 18, ("label",)).where("label_a = label_b").select("a", "b")


@query("q_components", f"{_REACH} SELECT node, min(r) AS component FROM reach GROUP BY node")
def components(t, spark):
    """G06."""
    return connected_components(same_label_links(t))


@query("q_component_id", f"{_REACH}, c AS (SELECT node, min(r) AS component FROM reach GROUP BY node) SELECT component, count(*) AS n, 'src:qa_inner:' || substr(sha256(string_agg(CAST(node AS VARCHAR), chr(10) ORDER BY CAST(node AS VARCHAR))), 1, 16) AS component_id FROM c GROUP BY component")
def component_id(t, spark):
    """Stable ids from the sorted members."""
    c = connected_components(same_label_links(t))
    members = F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), "\n")
    return c.groupBy("component").agg(F.count("*").alias("n"), F.concat(F.lit("src:qa_inner:"), F.substring(F.sha2(members, 256), 1, 16)).alias("component_id"))


@query("q_event_dedup_first", """WITH b AS (SELECT event_id % 700 AS id, event_id, ts, event_type FROM events) SELECT id, arg_min(event_type, event_id) AS event_type FROM b WHERE id >= 50 GROUP BY id""")
def event_dedup(t, spark):
    """First writer wins, and what the target has stays."""
    b = t("events").select((F.col("event_id") % 700).alias("id"), "event_id", "event_type")
    target = spark.range(50).select(F.col("id"))
    return J.append_new(target, b, "id", [F.col("event_id")]).select("id", "event_type")
