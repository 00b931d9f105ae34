"""Boxes and labels on a grid of cells, and rows trimmed by the percentiles of their group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.selection import with_percentiles
from tallyframe.operators.sequential import whole_groups

#: Cells of a side of a tile.
TILE = 32
#: Cells that a task paints at a time, and tiles that it holds.
CELLS_AT_ONCE, TILES_AT_ONCE = 1 << 21, 1 << 11
#: The least cell of a box without cells, and the greatest.
NOWHERE, BEFORE = 1 << 30, -1


def _span(low: Column, high: Column, limit: int, shrink: float) -> tuple[Column, Column]:
    """First and last cell of a box's side, shrunk at both ends, at least one cell, inside the image."""
    side = high - low
    first = F.greatest(F.lit(0), F.least(F.floor(low + side * shrink), F.lit(limit - 1))).cast("int")
    end = F.greatest(first + 1, F.least(F.ceil(low + side * (1 - shrink)), F.lit(limit))).cast("int")
    return first, end - 1


def _tiled(boxes: DataFrame, image: str, box: str, width: int, height: int, shrink: float) -> tuple[DataFrame, DataFrame]:
    """The first and last cells and the centre of each box that can be painted, and the same for each tile that it meets."""
    if not 0 <= shrink < 0.5 or width < 1 or height < 1:
        raise ValueError("shrink must be in 0..0.5 and the image not empty")
    corners = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    fine = (corners[2] > corners[0]) & (corners[3] > corners[1])
    for c in corners:
        fine = fine & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x0, y0, x1, y1 = corners
    (left, right), (top, bottom) = _span(x0, x1, width, shrink), _span(y0, y1, height, shrink)
    centre = lambda a, b, limit: F.greatest(F.lit(0), F.least(F.rint((a + b) / 2), F.lit(limit - 1))).cast("int")
    spans = boxes.where(fine).select(
        F.col(image), F.col(box).alias("_box"), ((x1 - x0) * (y1 - y0)).alias("_area"), left.alias("_l"), right.alias("_r"), top.alias("_t"), bottom.alias("_b"), centre(x0, x1, width).alias("_cx"), centre(y0, y1, height).alias("_cy")
    )
    tiles = lambda a, b: F.sequence(F.floor(F.col(a) / TILE), F.floor(F.col(b) / TILE))
    tiled = spans.withColumn("_ty", F.explode(tiles("_t", "_b"))).withColumn("_tx", F.explode(tiles("_l", "_r")))
    return spans, tiled


def painted(boxes: DataFrame, image: str, box: str, width: int, height: int, shrink: float = 0.0) -> DataFrame:
    """image, y, x, box: which box each covered cell belongs to. boxes has x0, y0, x1, y1 in cells.

    Of several boxes over a cell the smallest by area wins, of equal ones the greatest number. A box that is nowhere
    left has the cell of its centre besides, so that cell occurs twice. shrink (0 to less than 0.5) is cut off at each
    end of both sides. Boxes with a null, NaN or infinite corner or without area are left out. Boxes are dealt to tiles
    of TILE cells a side, so that a large one spreads over the cluster, and a cell's candidates are combined in the
    tasks before they are shuffled.
    """
    spans, tiled = _tiled(boxes, image, box, width, height, shrink)
    tiled = tiled.repartition(image, "_ty", "_tx")
    cells = lambda t, a, b: F.sequence(F.greatest(F.col(a), F.col(t) * TILE).cast("int"), F.least(F.col(b), F.col(t) * TILE + TILE - 1).cast("int"))
    each = tiled.withColumn("y", F.explode(cells("_ty", "_t", "_b"))).withColumn("x", F.explode(cells("_tx", "_l", "_r")))
    won = each.groupBy(image, "_ty", "_tx", "y", "x").agg(F.min_by("_box", F.struct("_area", -F.col("_box"))).alias(box)).select(image, "y", "x", box)
    lost = spans.join(won.select(F.col(image).alias("_image"), F.col(box).alias("_won")), (F.col(image).eqNullSafe(F.col("_image"))) & (F.col("_box") == F.col("_won")), "left_anti")
    return won.unionByName(lost.select(image, F.col("_cy").alias("y"), F.col("_cx").alias("x"), F.col("_box").alias(box)))


def _paint(place: np.ndarray, top: np.ndarray, bottom: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    """What is left of each box of many tiles, painted in order: its bounds inside the tile and its number of cells. place
    is 1 where a tile begins."""
    out = {k: np.full(len(place), v, np.int32) for k, v in (("_x0", NOWHERE), ("_y0", NOWHERE), ("_x1", BEFORE), ("_y1", BEFORE))}
    wide = right - left + 1
    size = (bottom - top + 1) * wide
    starts = np.append(np.flatnonzero(place == 1), len(place))
    for first in range(0, len(starts) - 1, TILES_AT_ONCE):
        ends = starts[first : first + TILES_AT_ONCE + 1]
        begin, end = ends[0], ends[-1]
        tile = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        grid = np.full((len(ends) - 1) * TILE * TILE, -1, np.int64)
        sums = np.cumsum(size[begin:end])
        at = 0
        while at < end - begin:  # later boxes are painted over earlier ones, in this block or one before
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CELLS_AT_ONCE, side="right")))
            n = size[begin + at : begin + to]
            own = np.repeat(np.arange(at, to), n)
            k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            row = begin + own
            grid[(tile[own] * TILE + top[row] + k // wide[row]) * TILE + left[row] + k % wide[row]] = row
            at = to
        seen = np.flatnonzero(grid >= 0)
        row, y, x = grid[seen], seen // TILE % TILE, seen % TILE
        for name, join, v in (("_x0", np.minimum, x), ("_y0", np.minimum, y), ("_x1", np.maximum, x), ("_y1", np.maximum, y)):
            join.at(out[name], row, v.astype(np.int32))
        cells = np.bincount(row - begin, minlength=end - begin)
        out.setdefault("cells", np.zeros(len(place), np.int64))[begin:end] = cells
    return out


def painted_bounds(boxes: DataFrame, image: str, box: str, width: int, height: int, shrink: float = 0.0) -> DataFrame:
    """bounds(painted(..), [image, box]) without a row for each cell: a task paints its tiles, many at a time, and tells what
    is left of each box in each of them. The boxes of a tile come together in a task, their cells never in a table."""
    _, tiled = _tiled(boxes, image, box, width, height, shrink)
    inside = lambda c, t: F.greatest(F.lit(0), F.least(F.col(c) - F.col(t) * TILE, F.lit(TILE - 1))).cast("int").alias(c)
    home = (F.col("_ty") == F.floor(F.col("_t") / TILE)) & (F.col("_tx") == F.floor(F.col("_l") / TILE))
    spread = tiled.select(image, F.col("_box").alias(box), "_ty", "_tx", "_cy", "_cx", "_area", home.cast("long").alias("_home"), inside("_t", "_ty"), inside("_b", "_ty"), inside("_l", "_tx"), inside("_r", "_tx"))
    # the smallest box comes last, of equal ones that of the greatest number
    order = Window.partitionBy(image, "_ty", "_tx").orderBy(F.desc("_area"), F.asc_nulls_last(box))
    dealt = spread.withColumn("_place", F.row_number().over(order)).drop("_area")
    kept = [image, box, "_ty", "_tx", "_cy", "_cx", "_home"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "_place"):
            names = table.select(kept)
            for k, x in _paint(*[table.column(c).to_numpy().astype(np.int64) for c in ("_place", "_t", "_b", "_l", "_r")]).items():
                names = names.append_column(k, pa.array(x))
            yield from names.to_batches()

    kinds = dict(dealt.dtypes)
    told = dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", _x0 int, _y0 int, _x1 int, _y1 int, cells long")
    low = lambda c, t: F.min(F.when(F.col("cells") > 0, F.col(c) + F.col(t) * TILE))
    high = lambda c, t: F.max(F.when(F.col("cells") > 0, F.col(c) + F.col(t) * TILE))
    g = told.groupBy(image, box).agg(
        low("_x0", "_tx").alias("_l"), low("_y0", "_ty").alias("_t"), high("_x1", "_tx").alias("_r"), high("_y1", "_ty").alias("_b"), F.sum("cells").alias("_n"),
        F.sum("_home").alias("_rows"), *[f("_c" + c).alias(f"_{n}{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xy"],
    )
    x, y, r, b = (F.coalesce(F.col(c), F.col(d)).cast("int") for c, d in (("_l", "_lowx"), ("_t", "_lowy"), ("_r", "_highx"), ("_b", "_highy")))
    cells = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_rows"))
    return g.select(image, box, x.alias("x"), y.alias("y"), (r - x + 1).alias("w"), (b - y + 1).alias("h"), cells.alias("cells"))


def bounds(cells: DataFrame, by: list[str]) -> DataFrame:
    """by.., x, y, w, h, cells: the bounding box of each label's cells and how many it has."""
    g = cells.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("_r"), F.max("y").alias("_b"), F.count("*").alias("cells"))
    return g.select(*by, "x", "y", (F.col("_r") - F.col("x") + 1).alias("w"), (F.col("_b") - F.col("y") + 1).alias("h"), "cells")


def trimmed(df: DataFrame, by: list[str], value: str, low: float, high: float, least: int = 1) -> DataFrame:
    """The rows of each group whose value lies between the group's exact percentiles at low and high, ends included;
    all rows of a group of which fewer than `least` would stay. Null values go, null keys are a group."""
    rows = df.where(F.col(value).isNotNull())
    ends = with_percentiles(rows.groupBy(*by).agg(F.count("*").alias("_n")), rows, by, {"_q": value}, [low, high])
    named = ends.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    held = rows.join(named, same)
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    keys = [f"_by{i}" for i in range(len(by))]
    few = held.groupBy(*keys).agg((F.count_if(inside) < least).alias("_few")).select(*[F.col(k).alias(f"{k}_") for k in keys], "_few")
    again = F.lit(True)
    for k in keys:
        again = again & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return held.join(few, again).where(inside | F.col("_few")).select(*df.columns)
