"""Queries on cells and colours: boxes from lineitem, colours from the components of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.functions import colour
from tallyframe.operators import raster
from tallyframe.plans.relations import boxes

_SIDE = lambda a, b: f"greatest(0, least(floor({a} + ({b} - {a}) * 0.1), 27))::INT"
_END = lambda a, b: f"greatest({_SIDE(a, b)} + 1, least(ceil({a} + ({b} - {a}) * 0.9), 28))::INT"


@query("q_box_raster", f"""WITH b AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box, l_discount * 500 / 4 AS x0, l_tax * 500 / 4 AS y0, (l_discount * 500 + l_quantity) / 4 AS x1, (l_tax * 500 + l_quantity) / 4 AS y1 FROM lineitem),
s AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, {_SIDE('x0', 'x1')} AS l, {_END('x0', 'x1')} AS r, {_SIDE('y0', 'y1')} AS t, {_END('y0', 'y1')} AS d FROM b),
c AS (SELECT image, box, area, y, unnest(range(l, r)) AS x FROM (SELECT *, unnest(range(t, d)) AS y FROM s)),
w AS (SELECT image, y, x, box FROM c QUALIFY row_number() OVER (PARTITION BY image, y, x ORDER BY area, box DESC) = 1),
a AS (SELECT image, y, x, box FROM w UNION ALL SELECT image, greatest(0, least(round_even((y0 + y1) / 2, 0), 27))::INT, greatest(0, least(round_even((x0 + x1) / 2, 0), 27))::INT, box FROM s WHERE (image, box) NOT IN (SELECT (image, box) FROM w))
SELECT image, box, min(x)::INT AS x, min(y)::INT AS y, (max(x) - min(x) + 1)::INT AS w, (max(y) - min(y) + 1)::INT AS h, count(*) AS cells FROM a GROUP BY image, box""")
def box_raster(t, spark):
    """Boxes painted on a grid, the smaller over the larger, and the bounds of what is left of each."""
    quarter = boxes(t).select("image", "box", *[(F.col(c) / 4).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return raster.painted_bounds(quarter, "image", "box", 28, 28, 0.1)


def colours(t):
    """Each three components of an embedding as a colour, with its place."""
    part = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(i.alias("i"), *[F.get("embedding", 3 * i + k).cast("double").alias(f"c{k}") for k in range(3)]))
    rows = t("embeddings").select("vec_id", "label", F.explode(part).alias("p")).select("vec_id", "label", "p.*")
    own = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"c{k}") * 2 + 0.4)) for k in range(3)]
    return rows.select("vec_id", "label", "i", colour.lab(*own).alias("lab")).select("vec_id", "label", "i", "lab.*")


_LIN = lambda k: f"CASE WHEN v{k} <= 0.04045 THEN v{k} / 12.92 ELSE power((v{k} + 0.055) / 1.055, 2.4) END AS r{k}"
_CUBE = lambda k, row, w: f"(r0 * {row[0]}::DOUBLE + r1 * {row[1]}::DOUBLE + r2 * {row[2]}::DOUBLE) / {w}::DOUBLE AS t{k}"
_LAB = f"""e AS (SELECT vec_id, label, i, {', '.join(f'greatest(0, least(1, embedding[3 * i + {k + 1}]::DOUBLE * 2 + 0.4)) AS v{k}' for k in range(3))} FROM embeddings, range(21) g(i)),
n AS (SELECT vec_id, label, i, {', '.join(map(_LIN, range(3)))} FROM e), x AS (SELECT vec_id, label, i, {', '.join(_CUBE(k, row, w) for k, (row, w) in enumerate(zip(colour.TO_XYZ, colour.WHITE)))} FROM n),
f AS (SELECT vec_id, label, i, {', '.join(f'CASE WHEN t{k} > 0.008856 THEN cbrt(t{k}) ELSE 7.787 * t{k} + 16 / 116 END AS f{k}' for k in range(3))} FROM x),
lab AS (SELECT vec_id, label, i, 116 * f1 - 16 AS l, 500 * (f0 - f1) AS a, 200 * (f1 - f2) AS b FROM f)"""


@query("q_beanlike_colours", f"""WITH {_LAB} SELECT label, count(*) AS n, count(*) FILTER (WHERE l < 82 AND (l < 30 OR (degrees(atan2(b, a)) > 15 AND degrees(atan2(b, a)) < 125 AND sqrt(a * a + b * b) > 5))) AS beanlike, round(avg(l), 6) AS l, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM lab GROUP BY label""")
def beanlike_colours(t, spark):
    """Colours that beans can have, over all components of all embeddings."""
    good = colour.beanlike(F.col("l"), F.col("a"), F.col("b"))
    return colours(t).groupBy("label").agg(F.count("*").alias("n"), F.count_if(good).alias("beanlike"), *[F.round(F.avg(c), 6).alias(c) for c in "lab"])


@query("q_trimmed_colours", f"""WITH {_LAB}, q AS (SELECT label, quantile_cont(l, 0.1) AS lo, quantile_cont(l, 0.9) AS hi FROM lab GROUP BY label)
SELECT label, count(*) AS n, round(avg(l), 6) AS l, round(min(l), 6) AS low, round(max(l), 6) AS high FROM lab JOIN q USING (label) WHERE l BETWEEN lo AND hi GROUP BY label""")
def trimmed_colours(t, spark):
    """What is left of each label's colours once the darkest and lightest tenth are gone."""
    kept = raster.trimmed(colours(t), ["label"], "l", 0.1, 0.9)
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("l"), 6).alias("l"), F.round(F.min("l"), 6).alias("low"), F.round(F.max("l"), 6).alias("high"))
