"""Colour expressions: sRGB with components in 0..1, linear light, and CIE L*a*b*."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the sRGB and CIE standards: rows of the matrix to XYZ, and the white point.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
#: Bounds of the colours that beans have, from green to dark roast.
BEAN_HUE, BEAN_CHROMA, BEAN_LIGHT, BEAN_DARK = (15.0, 125.0), 5.0, 82.0, 30.0


def to_linear(x: Column) -> Column:
    """Linear light of an sRGB component."""
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(x: Column) -> Column:
    """The sRGB component of linear light; below zero on its straight part."""
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def lab(red: Column, green: Column, blue: Column) -> Column:
    """struct<l, a, b> of an sRGB colour: l in 0..100."""
    light = [to_linear(c) for c in (red, green, blue)]
    xyz = [sum((m * c for m, c in zip(row[1:], light[1:], strict=True)), row[0] * light[0]) / w for row, w in zip(TO_XYZ, WHITE, strict=True)]
    x, y, z = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116) for t in xyz)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def hue(a: Column, b: Column) -> Column:
    """The angle in degrees, -180 to 180."""
    return F.degrees(F.atan2(b, a))


def beanlike(l: Column, a: Column, b: Column) -> Column:
    """Whether a bean can have this colour: not too light, and either coloured within the hues or dark."""
    angle = hue(a, b)
    coloured = (angle > BEAN_HUE[0]) & (angle < BEAN_HUE[1]) & (chroma(a, b) > BEAN_CHROMA)
    return (l < BEAN_LIGHT) & (coloured | (l < BEAN_DARK))
