"""Images as rows of r, g, b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import band_hue, clamp, colormap, dimmed, gamma, hue_color, jet, stretch, to_byte
from ..functions.valid import nearest_rank, valid
from ..model import RenderOptions
from ..shared import stored
from .roi import extremes, place, spots
from .stats import band_minmax


def _with_limits(v: DataFrame, options: RenderOptions) -> DataFrame:
    """``lo`` and ``hi`` of each cube's values (NaN skipped, infinities kept), 0 and 1 without any."""
    finite = v.withColumn("v", valid(F.col("v"), infinite=True))
    # limits are stored, here and below: of a known size, they are broadcast if small
    ends = stored(nearest_rank(finite, ["cube_id"], "v", [("lo", options.low, "plain"), ("hi", options.high, "render_high")]), "limits")
    return finite.join(ends, "cube_id", "left").withColumns({"lo": F.least(F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))), "hi": F.coalesce("hi", F.lit(1.0))})


def render_band(pixels: DataFrame, band: int, options: RenderOptions = RenderOptions()) -> DataFrame:
    """One band in a colour map; NaN and values under the threshold are black."""
    v = _with_limits(pixels.select("cube_id", "line", "sample", F.col("spectrum")[band].alias("v")), options)
    t = gamma(stretch(F.col("v"), F.col("lo"), F.col("hi"), 0.0, 1e-6), options.gamma)
    dark = F.col("v").isNull() | (F.col("v") < options.threshold)
    black = F.struct(*[F.lit(0).alias(n) for n in "rgb"])
    return v.select("cube_id", "line", "sample", F.when(dark, black).otherwise(colormap(t, options.colormap)).alias("c")).select("cube_id", "line", "sample", "c.*")


def render_rgb(pixels: DataFrame, bands: tuple[int, int, int], options: RenderOptions = RenderOptions()) -> DataFrame:
    """Three bands as r, g and b, each with its own stretch; any NaN gives black."""
    out = pixels.select("cube_id", "line", "sample", *[F.col("spectrum")[b].alias(f"v{i}") for i, b in enumerate(bands)])
    bad = F.isnan("v0") | F.isnan("v1") | F.isnan("v2")
    channels = out.select("cube_id", F.posexplode(F.array("v0", "v1", "v2")).alias("channel", "v")).withColumn("v", valid(F.col("v"), infinite=True))
    ends = nearest_rank(channels, ["cube_id", "channel"], "v", [("lo", options.low, "plain"), ("hi", options.high, "render_high")])
    first = lambda c, i, instead: F.coalesce(F.max(F.when(F.col("channel") == i, F.col(c))), F.lit(instead))
    limits = ends.groupBy("cube_id").agg(*[f for i in range(3) for f in (first("hi", i, 1.0).alias(f"hi{i}"), F.least(first("lo", i, 0.0), first("hi", i, 1.0)).alias(f"lo{i}"))])
    out = out.join(stored(limits, "limits"), "cube_id")
    byte = lambda i: to_byte(gamma(stretch(F.col(f"v{i}").cast("double"), F.col(f"lo{i}"), F.col(f"hi{i}"), 0.0, 1e-6), options.gamma))
    return out.select("cube_id", "line", "sample", *[F.when(bad, 0).otherwise(byte(i)).alias(n) for i, n in enumerate("rgb")])


def masked_render(pixels: DataFrame, band: int, mask: DataFrame, name: str = "rainbow") -> DataFrame:
    """Colours within the mask, stretched between its own extremes; gray at a quarter of the brightness elsewhere."""
    own = pixels.withColumn("spectrum", F.slice("spectrum", band + 1, 1))
    ends = stored(band_minmax(own, mask=mask).select("cube_id", F.col("min").alias("lo"), F.col("max").alias("hi")), "limits")
    inside = spots(mask, pixels).withColumn("on", F.lit(True))
    v = pixels.select("cube_id", "line", "sample", F.col("spectrum")[band].cast("double").alias("v")).join(ends, "cube_id").join(inside, place(mask, pixels), "left")
    t = F.when(F.isnan("v"), F.lit(0.0)).otherwise(stretch(F.col("v"), F.col("lo"), F.col("hi"), 0.0, 1e-6))
    gray = dimmed(t, 0.25)
    c = F.when(F.col("on"), colormap(t, name)).otherwise(F.struct(*[gray.alias(n) for n in "rgb"]))
    return v.select("cube_id", "line", "sample", c.alias("c")).select("cube_id", "line", "sample", "c.*")


def prediction_render(predicted: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """A prediction map between its 2nd and 98th percentile; outside the mask, band 0 as gray at a fifth."""
    v = predicted.select("cube_id", "line", "sample", F.col("spectrum")[0].cast("double").alias("gray"), F.col("prediction").alias("v"))
    within = v if mask is None else v.join(spots(mask, v), place(mask, v), "left_semi")
    ends = stored(nearest_rank(within.withColumn("v", valid(F.col("v"))), ["cube_id"], "v", [("lo", 2.0, "plain"), ("hi", 98.0, "plain")]), "limits")
    out = v.join(ends, "cube_id", "left").withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(1.0))})
    t = stretch(F.col("v"), F.col("lo"), F.col("hi"), 1e-4, 1.0)
    on = F.lit(True)
    if mask is not None:
        out = out.join(spots(mask, out).withColumn("on", F.lit(True)), place(mask, out), "left")
        on = F.coalesce("on", F.lit(False))
    dark = dimmed(F.when(F.isnan("gray"), F.lit(0.0)).otherwise(F.col("gray")), 0.2)
    return out.select("cube_id", "line", "sample", F.when(on, jet(t)).otherwise(F.struct(*[dark.alias(n) for n in "rgb"])).alias("c")).select("cube_id", "line", "sample", "c.*")


def overlay(gray: DataFrame, mask: DataFrame) -> DataFrame:
    """A gray image with the mask in green."""
    on = spots(mask, gray).withColumn("on", F.lit(True))
    g = F.col("gray")
    return gray.join(on, place(mask, gray), "left").select("cube_id", "line", "sample", F.when(F.col("on"), 0).otherwise(g).alias("r"), F.when(F.col("on"), 255).otherwise(g).alias("g"), F.when(F.col("on"), 0).otherwise(g).alias("b"))


def faces(pixels: DataFrame, mask: DataFrame, lo: float, hi: float, bands: int) -> DataFrame:
    """``face, band, at, r, g, b`` of a cube's four sides: the first or last masked cell of each row or column, tinted by the band's hue."""
    width = hi - lo if hi > lo else 1.0
    sides = []
    for face, along, end in (("top", "line", "first"), ("bottom", "line", "last"), ("left", "sample", "first"), ("right", "sample", "last")):
        other = "sample" if along == "line" else "line"
        outer = extremes(mask, along).withColumnRenamed(end, along)
        cells = pixels.join(spots(outer, pixels), place(outer, pixels)).select(F.lit(face).alias("face"), F.posexplode("spectrum").alias("band", "v"), F.col(other).alias("at"))
        sides.append(cells)
    out = sides[0].union(sides[1]).union(sides[2]).union(sides[3])
    i = 0.25 + 0.75 * clamp((F.col("v").cast("double") - lo) / width)
    tint = hue_color(band_hue(F.col("band"), bands))
    return out.withColumn("t", tint).select("face", "band", "at", *[F.floor(F.col(f"t.{n}") * i).cast("int").alias(n) for n in "rgb"])


def thumbnail(image: DataFrame, factor: int) -> DataFrame:
    """A rendered image with each factor x factor block as its mean colour."""
    small = lambda c: ((F.col(c) - F.col(c) % factor) / factor).cast("int").alias(c)
    return image.groupBy("cube_id", small("line"), small("sample")).agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"])
