"""Exact percentiles of groups of any size by distributed selection.

No group's values come together. Each wanted rank has a bracket of values that holds it, at first the group's whole
range. A pass lays a grid of approximate quantiles over each open bracket (sketches, merged from the tasks), narrows
the bracket to the cells around the rank, and counts exactly what lies below it and inside; so a bracket shrinks about
two hundred times in a pass whatever the distribution. Once a bracket has few different values, these are counted and
the rank is read off. All groups, columns and ranks go through the passes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.storage import discard, materialize

#: A bracket with at most so many different values (by estimate) is not narrowed further.
FEW = 20_000
#: Cells of the grid; the sketch's error is an eighth of a cell.
CELLS = 512
#: The table of brackets is broadcast up to so many groups and bytes of their keys, joined by shuffle beyond.
BROADCAST_GROUPS, BROADCAST_BYTES = 20_000, 4 << 20


def _key(by: list[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def percentiles(df: DataFrame, by: list[str], values: dict[str, Column | str], shares: list[float]) -> DataFrame:
    """_key (a struct of by) and for each name in values an array of its exact percentiles at the shares, linearly
    interpolated: position (n - 1) * share among the group's n values in order, nulls left out, NaN the largest. Null
    keys are a group of their own. A group without a value in a column has null there, without any no row."""
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie in 0..1")
    columns = {name: (F.col(x) if isinstance(x, str) else x).cast("double") for name, x in values.items()}
    if len(columns) == 1:
        rows = df.select(_key(by).alias("_key"), *[F.lit(name).alias("c") for name in columns], *[x.alias("v") for x in columns.values()])
    else:
        pairs = [F.struct(F.lit(name).alias("c"), x.alias("v")) for name, x in columns.items()]
        rows = df.select(_key(by).alias("_key"), F.explode(F.array(*pairs)).alias("_x")).select("_key", "_x.c", "_x.v")
    rows = rows.where("v is not null")
    whole = rows.groupBy("_key", "c").agg(F.count("*").alias("n"), F.approx_count_distinct("v", 0.1).alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    def bracket(i: int, share: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(share))
        return F.struct(F.lit(i).alias("s"), F.floor(at).alias("k"), (at - F.floor(at)).alias("part"), F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.col("d").alias("d"))

    state = materialize(whole.select("_key", "c", "n", F.array(*[bracket(i, s) for i, s in enumerate(shares)]).alias("b")), "brackets")
    wide = lambda b: (b["d"] > FEW) & (b["lo"] < b["hi"])
    narrowed = False
    while True:
        groups, size, n_open = state.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json("_key"))), F.lit(0)), F.count_if(F.exists("b", wide))).first()
        few = groups <= BROADCAST_GROUPS and size <= BROADCAST_BYTES
        meet = lambda s, few=few: rows.join(F.broadcast(s) if few else s, ["_key", "c"])
        if not n_open:
            break
        narrowed, before, state = True, state, materialize(_narrowed(state, meet, wide), "brackets")
        discard(before)
    # the values in some bracket, with their counts; the running count tells each one's rank from its bracket's start
    inside = rows
    if narrowed:
        ranges = state.select("_key", "c", F.transform("b", lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"))).alias("r"))
        inside = meet(ranges).where(F.exists("r", lambda r: (F.col("v") >= r["lo"]) & (F.col("v") <= r["hi"])))
    counted = inside.groupBy("_key", "c", "v").agg(F.count("*").alias("m"))
    running = counted.withColumn("upto", F.sum("m").over(Window.partitionBy("_key", "c").orderBy("v"))).select("_key", "c", "v", "m", "upto")
    told = state.select("_key", "c", F.col("n"), F.explode("b").alias("b"))
    met = running.join(F.broadcast(told) if few else told, ["_key", "c"]).where((F.col("v") >= F.col("b.lo")) & (F.col("v") <= F.col("b.hi")))
    of_bracket = Window.partitionBy("_key", "c", "s")
    ranked = met.select("_key", "c", "v", F.col("b.s").alias("s"), F.col("b.k").alias("k"), F.col("b.part").alias("part"), F.col("b.below").alias("below"), "upto", "m")
    ranked = ranked.withColumn("rank", F.col("below") + F.col("upto") - F.min(F.col("upto") - F.col("m")).over(of_bracket))
    first = lambda k: F.min(F.when(F.col("rank") > k, F.col("v")))
    ends = ranked.groupBy("_key", "c", "s").agg(F.first("part").alias("part"), first(F.col("k")).alias("low"), first(F.col("k") + 1).alias("high"))
    low, high, part = F.col("low"), F.col("high"), F.col("part")
    read = ends.select("_key", "c", "s", F.when((part == 0) | (low == high), low).otherwise((1 - part) * low + part * high).alias("q"))
    listed = read.groupBy("_key", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "q"))), lambda x: x["q"]).alias("q"))
    return listed.groupBy("_key").agg(*[F.max(F.when(F.col("c") == name, F.col("q"))).alias(name) for name in values])


def _narrowed(state: DataFrame, meet, wide) -> DataFrame:
    """The state after one pass over the rows for the grid and one for the counts."""
    opened = state.select("_key", "c", F.explode(F.filter("b", wide)).alias("b"))
    within = lambda t: meet(t).where((F.col("v") >= F.col("b.lo")) & (F.col("v") <= F.col("b.hi")))
    grid = F.percentile_approx("v", F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)]), F.lit(8 * CELLS)).alias("grid")
    sketched = within(opened).groupBy("_key", "c", "b").agg(grid)
    place = lambda k: (F.col("b.k") + k - F.col("b.below")) / F.col("b.inside") * CELLS
    low, high = F.floor(place(0)) - 1, F.ceil(place(2)) + 1
    lo = F.when(low <= 0, F.col("b.lo")).otherwise(F.element_at("grid", F.greatest(low, F.lit(0)).cast("int") + 1))
    hi = F.when(high >= CELLS, F.col("b.hi")).otherwise(F.element_at("grid", F.least(high, F.lit(CELLS)).cast("int") + 1))
    cut = materialize(sketched.select("_key", "c", "b", lo.alias("lo"), hi.alias("hi")), "cuts")
    here = F.col("v").between(F.col("lo"), F.col("hi"))
    counts = within(cut).groupBy("_key", "c", "b.s").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count_if(F.col("v") < F.col("lo")).alias("less"), F.count_if(here).alias("inside"), F.approx_count_distinct(F.when(here, F.col("v")), 0.1).alias("d"))
    new = counts.groupBy("_key", "c").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("lo", "hi", "less", "inside", "d").alias("x")))).alias("x"))

    def moved(b: Column) -> Column:
        x = F.col("x")[b["s"]]
        below = b["below"] + x["less"]
        held = (below <= b["k"]) & (F.least(b["k"] + 1, F.col("n") - 1) < below + x["inside"])
        checked = F.when(held, below).otherwise(F.raise_error(F.lit("a bracket lost its rank")).cast("long"))
        return F.when(x.isNull(), b).otherwise(F.struct(b["s"].alias("s"), b["k"].alias("k"), b["part"].alias("part"), x["lo"].alias("lo"), x["hi"].alias("hi"), checked.alias("below"), x["inside"].alias("inside"), x["d"].alias("d")))

    joined = state.join(new, ["_key", "c"], "left")
    return joined.select("_key", "c", "n", F.transform("b", lambda b: F.when(F.col("x").isNull(), b).otherwise(moved(b))).alias("b"))


def with_percentiles(grouped: DataFrame, df: DataFrame, by: list[str], values: dict[str, Column | str], shares: list[float]) -> DataFrame:
    """grouped, which has one row for each value of by, with the percentile arrays of df; null where there is none."""
    return grouped.withColumn("_key", _key(by)).join(percentiles(df, by, values, shares), "_key", "left").drop("_key")
