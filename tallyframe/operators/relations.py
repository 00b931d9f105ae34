"""Joins with coverage guards, similarity joins, spatial joins, keyed append and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """df with a value of a dimension table, default where the key is unknown or the value null."""
    d = dim.select(F.col(key), F.col(value).alias("_v"))
    return df.join(d, key, "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v")


def population_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys that only one of two tables has."""
    x, y = (d.select(key).distinct() for d in (a, b))
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))


def require_empty(df: DataFrame, message: str) -> None:
    """Raises with up to five offending rows; the guards' contract is to stop, not to treat missing as false."""
    rows = df.take(5)
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")


def same_population(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The inner join of two tables that must hold the same keys, each once."""
    require_empty(population_diff(a, b, key), "populations differ")
    for d in (a, b):
        require_empty(d.groupBy(key).count().where("count > 1"), f"{key} is not unique")
    return a.join(b, key)


def residual_pairs(pairs: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """a, b, group_a, group_b: the pairs (a, b) whose rows are not in one group. groups: key and group, each key once; a
    null group is none. A pair with a key that has no group is residual too: what must stay together is not known to."""
    of = lambda side: groups.select(F.col(key).alias(side), F.col(group).alias(f"group_{side}"))
    met = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.where(~F.coalesce(F.col("group_a") == F.col("group_b"), F.lit(False))).select("a", "b", "group_a", "group_b")


def guarded(rows: DataFrame, groups: DataFrame, pairs: DataFrame, key: str, group: str) -> DataFrame:
    """rows with their group, which every row must have, once no pair of near copies among them crosses groups."""
    require_empty(rows.select(key).join(groups.where(F.col(group).isNotNull()).select(key), key, "left_anti"), "rows without a group")
    own = rows.select(key).distinct()
    among = pairs.join(own.withColumnRenamed(key, "a"), "a", "left_semi").join(own.withColumnRenamed(key, "b"), "b", "left_semi")
    require_empty(residual_pairs(among, groups, key, group), "near copies in different groups")
    return rows.join(groups.select(key, group), key)


def keep_by_mask(rows: DataFrame, mask: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows whose mask is not set; every row must be covered by the mask."""
    require_empty(rows.select(key).join(mask.select(key), key, "left_anti"), "rows without a mask")
    return rows.join(mask.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).select(key).distinct(), key, "left_anti")


def update_join(df: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the columns replaced where updates has the key and a value."""
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(u, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    return out.drop(*[f"_new_{c}" for c in columns])


def append_new(target: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows of batch to append: the first of each key in order, unless target has the key (first writer wins)."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    first = batch.groupBy(key).agg(F.min_by(F.struct(*[c for c in batch.columns if c != key]), rank).alias("_row"))
    return first.join(target.select(key), key, "left_anti").select(key, "_row.*").select(*batch.columns)


def bands(h: Column, distance: int, bits: int = 64) -> list[Column]:
    """distance + 1 bands of a bit string in a BIGINT: two within the distance agree in one of them."""
    n = distance + 1
    edges = [round(i * bits / n) for i in range(n + 1)]
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        width = hi - lo
        shifted = F.shiftrightunsigned(h, lo)
        out.append(shifted if width >= 64 else shifted.bitwiseAND(F.lit((1 << width) - 1)))
    return out


def hamming_join(df: DataFrame, key: str, h: str, distance: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, distance) with key a < key b and at most `distance` differing bits, by pigeonhole bands: rows meet on
    an equal band, and a pair is taken in the first band on which it agrees, so no distinct is needed. Lossless.
    Extra columns come along as name_a, name_b."""
    cols = [key, h, *extra]
    b = F.posexplode(F.array(*bands(F.col(h), distance))).alias("_band", "_v")
    rows = df.where(F.col(h).isNotNull()).select(*cols, b)
    x = rows.select("_band", "_v", *[F.col(c).alias(f"{c}_a") for c in cols])
    y = rows.select("_band", "_v", *[F.col(c).alias(f"{c}_b") for c in cols])
    ha, hb = F.col(f"{h}_a"), F.col(f"{h}_b")
    first = F.lit(distance + 1)
    pairs = list(zip(bands(ha, distance), bands(hb, distance), strict=True))
    for i in range(len(pairs) - 1, -1, -1):
        first = F.when(pairs[i][0] == pairs[i][1], F.lit(i)).otherwise(first)
    d = F.bit_count(ha.bitwiseXOR(hb))
    hit = x.join(y, ["_band", "_v"]).where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (d <= distance) & (F.col("_band") == first))
    return hit.select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"), d.cast("int").alias("distance"), *[f"{c}_{s}" for c in extra for s in "ab"])


#: Up to so many keys or passages a join with them is a broadcast; beyond, it is shuffled or done in slices.
FEW_KEYS, FEW_PASSAGES = 1_000_000, 100_000


def semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among keys: broadcast while those are few, shuffled beyond."""
    few = keys.count() <= FEW_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, "left_semi")


def on_both_sides(df: DataFrame, key: str, test: Column) -> DataFrame:
    """The test rows of df whose key a training row also has. Keys are judged once each, however many rows share one."""
    side = df.groupBy(key).agg(F.bool_or(test).alias("t"), F.bool_or(~test).alias("r"))
    return semi(df.where(test), side.where(f"t and r and {key} is not null").select(key), key)


def near_other_side(df: DataFrame, h: str, distance: int, test: Column) -> DataFrame:
    """The test rows of df whose bit string h is within the distance of a training row's. Distinct values meet in the
    bands of hamming_join, by semi-join: whether there is one is asked, so no pairs come out. Lossless."""
    side = df.where(F.col(h).isNotNull()).groupBy(h).agg(F.bool_or(test).alias("t"), F.bool_or(~test).alias("r"))
    band = F.posexplode(F.array(*bands(F.col(h), distance)))
    x = side.where("t").select(h, band.alias("_i", "_v"))
    y = side.where("r").select(F.col(h).alias("_o"), band.alias("_j", "_w"))
    met = (F.col("_i") == F.col("_j")) & (F.col("_v") == F.col("_w")) & (F.bit_count(F.col(h).bitwiseXOR(F.col("_o"))) <= distance)
    return semi(df.where(test), x.join(y, met, "left_semi").select(h).distinct(), h)


def containing(df: DataFrame, text: str, passages: DataFrame, passage: str) -> DataFrame:
    """The rows of df whose whole text contains a whole passage, at any place, byte for byte; once for each passage.

    Of the words between a passage's first and last space the longest is its key: a text with the passage has it
    between spaces too. Texts meet passages by their distinct words, and contains() decides. Passages without such
    a word are tried on every text; null and empty ones occur in none."""
    words = F.split(passage, " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    found = passages.where(F.length(passage) > 0).select(F.col(passage).alias("_p"), longest.alias("_w")).distinct()
    slices = -(-passages.count() // FEW_PASSAGES) or 1
    by_word = df.withColumn("_w", F.explode(F.array_distinct(F.split(text, " "))))
    out = None
    for i in range(slices):
        own = found if slices == 1 else found.where(F.pmod(F.xxhash64("_p"), F.lit(slices)) == i)
        keyed = by_word.join(F.broadcast(own.where("_w <> ''")), "_w").where(F.contains(text, "_p"))
        loose = df.join(F.broadcast(own.where("coalesce(_w, '') = ''").select("_p")), F.contains(text, "_p"))
        for hit in (keyed.select(*df.columns), loose.select(*df.columns)):
            out = hit if out is None else out.unionByName(hit)
    return out


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    zero = F.lit(0.0)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero)
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    area = lambda q: F.greatest(q[2] - q[0], zero) * F.greatest(q[3] - q[1], zero)
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-9))


BOX = ("x0", "y0", "x1", "y1")


def box_pairs(boxes: DataFrame, image: str, box: str) -> DataFrame:
    """image, a, b, iou for every two boxes of an image, a < b."""
    x = boxes.select(image, F.col(box).alias("a"), *[F.col(c).alias(f"{c}_a") for c in BOX])
    y = boxes.select(image, F.col(box).alias("b"), *[F.col(c).alias(f"{c}_b") for c in BOX])
    pair = x.join(y, image).where("a < b")
    return pair.select(image, "a", "b", iou(tuple(F.col(f"{c}_a") for c in BOX), tuple(F.col(f"{c}_b") for c in BOX)).alias("iou"))


def overlap_share(boxes: DataFrame, image: str, box: str, above: float = 0.05) -> DataFrame:
    """image, share: the part of an image's boxes that overlap another by more than `above`."""
    hit = box_pairs(boxes, image, box).where(F.col("iou") > above)
    touched = hit.select(image, F.explode(F.array("a", "b")).alias(box)).distinct().groupBy(image).agg(F.count("*").alias("_t"))
    n = boxes.groupBy(image).agg(F.count("*").alias("_n"))
    return n.join(touched, image, "left").select(image, (F.coalesce("_t", F.lit(0)) / F.col("_n")).alias("share"))


def containers(boxes: DataFrame, image: str, box: str, min_inside: int, area_ratio: float) -> DataFrame:
    """image, box, inside: boxes that hold the centres of at least min_inside others and whose area is at least
    area_ratio times the image's median area."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    b = boxes.withColumn("_area", area)
    median = b.groupBy(image).agg(F.percentile("_area", F.lit(0.5)).alias("_median"))
    c = boxes.select(image, F.col(box).alias("_c"), ((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("y0") + F.col("y1")) / 2).alias("_y"))
    big = b.join(median, image).where(F.col("_area") >= area_ratio * F.col("_median"))  # few are left to pair
    held = big.join(c, image).where((F.col(box) != F.col("_c")) & F.col("_x").between(F.col("x0"), F.col("x1")) & F.col("_y").between(F.col("y0"), F.col("y1")))
    return held.groupBy(image, box).agg(F.count("*").alias("inside")).where(F.col("inside") >= min_inside)
