"""Painted boxes, bounds, trims and colours against plain loops."""

import colorsys
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import colour
from tallyframe.operators import raster


@pytest.mark.parametrize("shrink", [0.0, 0.3])
@pytest.mark.parametrize("tile", [3, 32])
def test_painting_equals_a_loop(spark, monkeypatch, shrink, tile):
    monkeypatch.setattr(raster, "TILE", tile)
    rnd, w, h, rows = random.Random(2), 17, 11, []
    for image in (1, 2, None):
        for box in range(12):
            x, y = rnd.uniform(-4, 18), rnd.uniform(-4, 12)
            rows.append((image, box, x, y, x + rnd.choice([0.3, 3, 3, 8.5]), y + rnd.choice([0.3, 3, 6.25])))
        rows += [(image, 20, *rows[-1][2:]), (image, 21, 0.0, 0.0, 40.0, 40.0)]  # a repeat, and one over all
    odd = [(1, 30, 1.0, 1.0, 1.0, 2.0), (1, 31, math.nan, 1.0, 2.0, 2.0), (1, 32, None, 1.0, 2.0, 2.0), (1, 33, 1.0, 1.0, math.inf, 2.0)]
    df = spark.createDataFrame(rows + odd, "image long, box int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.image or 0, r.y, r.x, r.box) for r in raster.painted(df, "image", "box", w, h, shrink).collect())
    want = []
    for image in (1, 2, None):
        own = [r for r in rows if r[0] == image]
        grid = np.full((h, w), -1)
        for _, box, x0, y0, x1, y1 in sorted(own, key=lambda r: (-(r[4] - r[2]) * (r[5] - r[3]), r[1])):
            left, top = (min(max(math.floor(a + (b - a) * shrink), 0), n - 1) for a, b, n in ((x0, x1, w), (y0, y1, h)))
            right, bottom = (max(min(math.ceil(a + (b - a) * (1 - shrink)), n), f + 1) for a, b, n, f in ((x0, x1, w, left), (y0, y1, h, top)))
            grid[top:bottom, left:right] = box
        want += [(image or 0, int(y), int(x), int(grid[y, x])) for y, x in zip(*np.nonzero(grid >= 0), strict=True)]
        for _, box, x0, y0, x1, y1 in own:
            if not (grid == box).any():
                want.append((image or 0, int(np.clip(np.rint((y0 + y1) / 2), 0, h - 1)), int(np.clip(np.rint((x0 + x1) / 2), 0, w - 1)), box))
    assert got == sorted(want)
    with pytest.raises(ValueError):
        raster.painted(df, "image", "box", w, h, 0.5)


def test_trims_of_groups(spark):
    rows = [("a", float(i)) for i in range(11)] + [("b", 1.0), ("b", 2.0), (None, 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {}
    for r in raster.trimmed(df, ["g"], "v", 0.2, 0.8).collect():
        out.setdefault(r.g, []).append(r.v)
    assert {k: sorted(v) for k, v in out.items()} == {"a": [float(i) for i in range(2, 9)], "b": [1.0, 2.0], None: [5.0]}
    assert raster.trimmed(df.limit(0), ["g"], "v", 0.2, 0.8).count() == 0


def test_colours(spark):
    rnd = random.Random(1)
    some = [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.0, 0.0), (0.5, 0.5, 0.5), *[colorsys.hsv_to_rgb(rnd.random(), rnd.random(), rnd.random()) for _ in range(40)]]
    df = spark.createDataFrame(some, "r double, g double, b double")
    back = colour.to_srgb(colour.to_linear(F.col("r")))
    for r in df.withColumn("lab", colour.lab(F.col("r"), F.col("g"), F.col("b"))).withColumn("back", back).select("r", "g", "b", "back", "lab.*").toDF("r", "g", "bl", "back", "l", "a", "b").collect():
        lin = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (r.r, r.g, r.bl)]
        f = [t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in (np.array(colour.TO_XYZ) @ lin / np.array(colour.WHITE))]
        assert (r.l, r.a, r.b, r.back) == (pytest.approx(116 * f[1] - 16, abs=1e-6), pytest.approx(500 * (f[0] - f[1]), abs=1e-6), pytest.approx(200 * (f[1] - f[2]), abs=1e-6), pytest.approx(r.r, abs=1e-6))
    red = df.where("r = 1 and g = 0").select(colour.lab(F.col("r"), F.col("g"), F.col("b")).alias("x")).first().x
    assert (red.l, red.a, red.b) == (pytest.approx(53.24, abs=0.02), pytest.approx(80.09, abs=0.2), pytest.approx(67.2, abs=0.2))
    lab = spark.createDataFrame([(50.0, 10.0, 30.0), (90.0, 10.0, 30.0), (20.0, 0.0, 0.0), (50.0, 0.0, 0.0), (50.0, 10.0, -30.0)], "l double, a double, b double")
    assert [r.k for r in lab.select(colour.beanlike(*map(F.col, "lab")).alias("k")).collect()] == [True, False, True, False, False]


def test_painted_bounds_are_those_of_the_cells(spark, monkeypatch):
    """over several tiles, with hidden boxes, and blocks of few cells; no row for each cell."""
    monkeypatch.setattr(raster, "CELLS_AT_ONCE", 50)
    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else i % 5, i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(0, 60, (300, 4)).tolist())]
    df = spark.createDataFrame(rows, "image int, box long, x0 double, y0 double, x1 double, y1 double")
    got = raster.painted_bounds(df, "image", "box", 70, 50, 0.1)
    want = raster.bounds(raster.painted(df, "image", "box", 70, 50, 0.1), ["image", "box"])
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
