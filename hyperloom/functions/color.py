"""Stretch, gamma, quantisation and colour maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float | Column = 0.0, hi: float | Column = 1.0) -> Column:
    lo, hi = (F.lit(v) if isinstance(v, (int, float)) else v for v in (lo, hi))
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


def stretch(v: Column, lo: Column, hi: Column, least: float, instead: float, strict: bool = False) -> Column:
    """(v - lo) / range within 0 and 1; a range of ``least`` or less (``strict``: under it) counts as ``instead``."""
    width = hi - lo
    narrow = width < least if strict else width <= least
    return clamp((v - lo) / F.when(narrow, F.lit(instead)).otherwise(width))


def gamma(t: Column, g: float) -> Column:
    return F.pow(t, F.lit(g)) if abs(g - 1) > 1e-3 else t


def to_byte(t: Column) -> Column:
    """Truncated to 0 ... 255."""
    return F.floor(clamp(t) * 255).cast("int")


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(to_byte(r).alias("r"), to_byte(g).alias("g"), to_byte(b).alias("b"))


def colormap(t: Column, name: str = "rainbow") -> Column:
    """struct<r, g, b> of a value in 0 ... 1; names not known are the rainbow."""
    zero, one = F.lit(0.0), F.lit(1.0)
    # fixed values: the maps' slopes and offsets
    if name == "heatmap":
        return _rgb(t * 3, t * 3 - 1, t * 3 - 2)
    if name == "grayscale":
        return _rgb(t, t, t)
    if name == "cold_blue":
        return _rgb(t * 2 - 1, t * 2 - 1, t * 2)
    if name == "green_fluorescent":
        return _rgb(clamp(t * 2 - 1) * 0.5, t * 1.5, t * 0.5)
    if name == "red_fluorescent":
        return _rgb(t * 1.5, clamp(t * 0.5) * 0.3, zero)
    # fixed values: the rainbow's breaks
    r = F.when(t < 0.375, zero).when(t < 0.625, (t - 0.375) * 4).otherwise(one)
    g = F.when(t < 0.125, zero).when(t < 0.375, (t - 0.125) * 4).when(t < 0.625, one).when(t < 0.875, 1 - (t - 0.625) * 4).otherwise((t - 0.875) * 8)
    b = F.when(t < 0.125, 0.5 + t * 4).when(t < 0.375, one).when(t < 0.625, 1 - (t - 0.375) * 4).when(t < 0.875, zero).otherwise((t - 0.875) * 8)
    return _rgb(r, g, b)


def jet(t: Column) -> Column:
    """The prediction maps' colours."""
    # fixed values: the channels' centres
    part = lambda c: 1.5 - F.abs(2 * t - c)
    return _rgb(part(1.5), part(1.0), part(0.5))


def hue_color(hue: Column, lightness: float = 0.5) -> Column:
    """struct<r, g, b> of a hue in degrees at full saturation."""
    c = 1 - abs(2 * lightness - 1)
    m = lightness - c / 2
    h = hue / 60
    x = c * (1 - F.abs(h % 2 - 1))
    zero, full = F.lit(0.0), F.lit(c)
    r = F.when(h < 1, full).when(h < 2, x).when(h < 4, zero).when(h < 5, x).otherwise(full)
    g = F.when(h < 1, x).when(h < 3, full).when(h < 4, x).otherwise(zero)
    b = F.when(h < 2, zero).when(h < 3, x).when(h < 5, full).otherwise(x)
    return F.struct(*[F.floor((v + m) * 255).cast("int").alias(n) for v, n in ((r, "r"), (g, "g"), (b, "b"))])


def band_hue(band: Column, bands: int) -> Column:
    # fixed value: hues from 270 degrees down to 0
    return 270 * (1 - band / max(1, bands - 1))


def dimmed(v: Column, factor: float) -> Column:
    """Gray of a 0 ... 1 value at a fraction of its brightness, for what lies outside a selection."""
    return F.floor(clamp(v) * 255 * factor).cast("int")
