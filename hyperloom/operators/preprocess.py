"""Radiometric and spectral preprocessing, and spatial filters."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.valid import is_valid, let
from ..shared import stored
from .stats import mean_array


def doubles(column: str = "spectrum") -> Column:
    return F.col(column).cast("array<double>")


def reference_by_sample(reference: DataFrame, kind: str) -> DataFrame:
    """``sample, ref array<double>``: over lines, the largest value of each band and sample of a white reference (1 without a valid one), the smallest of a dark one (0)."""
    from ..functions.valid import to_long, valid

    v = valid(F.col("value"))
    best = F.coalesce(F.max(v), F.lit(1.0)) if kind == "white" else F.coalesce(F.min(v), F.lit(0.0))
    cells = to_long(reference).groupBy("sample", "band").agg(best.alias("v"))
    return cells.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("band", "v"))).alias("r")).select("sample", F.col("r.v").alias(kind))


def nearest_bands(wanted: list[float], have: list[float], n_have: int | None = None) -> list[int]:
    """For each wanted wavelength the nearest one of ``have``, ties to the lowest; where there is none to compare, the proportional index rounded half to even."""
    n_have = n_have or len(have)
    out = []
    for i, w in enumerate(wanted):
        if not have or w == 0:
            out.append(min(max(round(i / max(1, len(wanted) - 1) * (n_have - 1)), 0), n_have - 1))
        else:
            out.append(min(range(len(have)), key=lambda k: (abs(have[k] - w), k)))
    return out


def calibrate(pixels: DataFrame, white: DataFrame, dark: DataFrame, white_bands: list[int] | None = None, dark_bands: list[int] | None = None) -> DataFrame:
    """Reflectance ((v - dark) / max(white - dark, 1e-4)) * 0.99, from 0 to 1; invalid cells stay as they are.

    ``white`` and ``dark`` are pixels of reference cubes of the same width; ``*_bands`` map a band to a reference's nearest one (default: the same band).
    References shrink to one array a sample, worked out at once and written to the shared folder; of a known size, they are broadcast if small.
    """
    both = stored(reference_by_sample(white, "white").join(reference_by_sample(dark, "dark"), "sample", "full_outer"), "references")
    at = lambda name, bands: F.col(name) if bands is None else F.transform(F.array(*[F.lit(b) for b in bands]), lambda b: F.element_at(F.col(name), b + 1))
    joined = pixels.join(both, "sample", "left")
    refs = F.arrays_zip(at("white", white_bands).alias("w"), at("dark", dark_bands).alias("d"))
    joined = joined.withColumn("__refs", refs)

    def one(v: Column, r: Column) -> Column:
        low = r["d"]
        x = (v - low) / F.greatest(r["w"] - low, F.lit(1e-4)) * 0.99
        x = F.when(is_valid(x) & (x >= 0), F.least(x, F.lit(1.0))).otherwise(F.lit(0.0))
        return F.when(is_valid(v), x).otherwise(v)

    out = F.zip_with(doubles(), "__refs", one)
    return joined.withColumn("spectrum", out).drop("white", "dark", "__refs").select(*pixels.columns)


def with_cell(pixels: DataFrame, line: int, sample: int, band: int, value: float) -> DataFrame:
    """The cube with one cell replaced; a place outside of it changes nothing."""
    here = (F.col("line") == line) & (F.col("sample") == sample)
    new = F.transform("spectrum", lambda v, b: F.when(b == band, F.lit(value).cast("float")).otherwise(v))
    return pixels.withColumn("spectrum", F.when(here, new).otherwise(F.col("spectrum")))


def absorbance(pixels: DataFrame, calibrated: bool = True, already: bool = False) -> DataFrame:
    """-log10(max(r, 1e-4)) of valid cells; unchanged, with a warning, unless calibrated and not absorbance already."""
    if not calibrated or already:
        warnings.warn("absorbance needs calibrated reflectance; left as it is", stacklevel=2)
        return pixels
    return pixels.withColumn("spectrum", F.transform(doubles(), lambda r: F.when(is_valid(r), -F.log10(F.greatest(r, F.lit(1e-4)))).otherwise(r)))


def snv(pixels: DataFrame) -> DataFrame:
    """Standard normal variate of each spectrum's valid bands; a population std under 1e-6 counts as 1. One Arrow pass, vectorised over pixels."""
    return _row_kernel(pixels, snv_kernel)


def snv_expression(pixels: DataFrame) -> DataFrame:
    """The same as column expressions; mean and std are let-bound, or each lambda call would work them out again."""
    good = F.filter(doubles(), lambda v: is_valid(v))

    def use(s: Column) -> Column:
        return F.transform(doubles(), lambda v: F.when(is_valid(v), (v - s["m"]) / s["d"]).otherwise(v))

    def moments(a: Column) -> Column:
        n = F.when(F.size(a) > 0, F.size(a))
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
        return let(mean, lambda m: let(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n), lambda d: F.struct(m.alias("m"), F.when(d < 1e-6, F.lit(1.0)).otherwise(d).alias("d"))))

    return pixels.withColumn("spectrum", let(let(good, moments), use))


def _row_kernel(pixels: DataFrame, kernel) -> DataFrame:
    """Applies ``kernel`` (a matrix of spectra to one of the same height) to whole Arrow batches; columns other than spectrum pass through."""
    schema = pixels.withColumn("spectrum", doubles()).schema
    names = pixels.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("spectrum")
            x = np.asarray(flat.flatten(), dtype=float).reshape(batch.num_rows, -1)
            y = kernel(x)
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(y).ravel()))
            yield pa.RecordBatch.from_arrays([out if n == "spectrum" else batch.column(n) for n in names], names=names)

    return pixels.withColumn("spectrum", doubles()).select(*names).mapInArrow(run, schema)


def snv_kernel(x: np.ndarray) -> np.ndarray:
    ok = np.isfinite(x)
    n = np.maximum(ok.sum(1, keepdims=True), 1)
    mean = np.where(ok, x, 0).sum(1, keepdims=True) / n
    std = np.sqrt((np.where(ok, x - mean, 0) ** 2).sum(1, keepdims=True) / n)
    return np.where(ok, (x - mean) / np.where(std < 1e-6, 1.0, std), x)


def msc(pixels: DataFrame) -> DataFrame:
    """Multiplicative scatter correction against the cube's mean spectrum: (v - a) / m of each pixel's least-squares line v = a + m * mean.

    Pixels of under two valid bands or a degenerate fit are left; a slope of (nearly) 0 counts as 1 after the intercept is worked out.
    """
    # of a known size: broadcast if small, so that the pixels of a cube don't meet in one task
    means = stored(mean_array(pixels.select("cube_id", "line", "sample", "spectrum")).withColumnRenamed("mean", "__mean"), "means")
    names = pixels.columns
    wide = pixels.withColumn("spectrum", doubles()).join(means, "cube_id").select(*names, "__mean")
    schema = wide.drop("__mean").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = (np.asarray(batch.column(c).flatten(), dtype=float).reshape(batch.num_rows, -1) for c in ("spectrum", "__mean"))
            y = msc_kernel(x, m)
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([out if n == "spectrum" else batch.column(n) for n in names], names=names)

    return wide.mapInArrow(run, schema)


def msc_kernel(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    ok = np.isfinite(x)
    n = ok.sum(1, keepdims=True)
    r, v = np.where(ok, mean, 0), np.where(ok, x, 0)
    sr, sv, srr, srv = (a.sum(1, keepdims=True) for a in (r, v, r * r, r * v))
    denominator = n * srr - sr * sr
    fit = (n >= 2) & (np.abs(denominator) >= 1e-9)
    safe = np.where(fit, denominator, 1)
    slope = (n * srv - sr * sv) / safe
    intercept = (sv - slope * sr) / np.maximum(n, 1)
    slope = np.where((np.abs(slope) < 1e-9) | np.isnan(slope), 1.0, slope)
    return np.where(ok & fit, (x - intercept) / slope, x)


def savgol_coefficients(window: int, polynomial: int, derivative: int) -> np.ndarray:
    """Weights over a window of the derivative (a band index apart) of the least-squares polynomial at the centre."""
    if derivative > polynomial:
        raise ValueError("derivative order above the polynomial's")
    half = window // 2
    j = np.vander(np.arange(-half, half + 1, dtype=float), polynomial + 1, increasing=True)
    return math.factorial(derivative) * np.linalg.solve(j.T @ j, j.T)[derivative]


def savgol_window(bands: int, window: int, polynomial: int) -> int | None:
    """The window that is used: odd, at most the bands; None where filtering is a no-op."""
    if bands < 4:
        return None
    window += window % 2 == 0
    if window > bands:
        window = bands if bands % 2 else bands - 1
    return None if window < 3 or polynomial >= window else window


def savgol(pixels: DataFrame, bands: int, window: int, polynomial: int, derivative: int, spacing: float = 1.0) -> DataFrame:
    """Savitzky-Golay along the bands with replicated ends, as one product with a banded matrix a batch.

    An invalid centre gives NaN; an invalid neighbour gives 0. Derivatives are per band, or per nm where ``spacing`` is the bands' distance in nm.
    """
    used = savgol_window(bands, window, polynomial)
    if used is None:
        warnings.warn("Savitzky-Golay doesn't apply to these bands; left as they are", stacklevel=2)
        return pixels
    weights, half = savgol_coefficients(used, polynomial, derivative) / spacing**derivative, used // 2
    matrix, touched = np.zeros((bands, bands)), np.zeros((bands, bands))
    for b in range(bands):
        for k, w in enumerate(weights):
            at = min(max(b + k - half, 0), bands - 1)
            matrix[at, b] += w
            touched[at, b] = 1

    def kernel(x: np.ndarray) -> np.ndarray:
        ok = np.isfinite(x)
        y = np.where(ok, x, 0) @ matrix
        y = np.where((~ok).astype(float) @ touched > 0, 0.0, y)
        return np.where(ok, y, np.nan)

    return _row_kernel(pixels, kernel)


#: Side of the square tiles in which spatial kernels run; neighbours within the halo are copied to a tile.
TILE = 128


def tiled(pixels: DataFrame, halo: int, kernel, schema, tile: int = TILE) -> DataFrame:
    """Runs ``kernel`` (a frame of one tile and its halo, and the tile's bounds, to the tile's rows) on every tile of every cube.

    Only cells near a tile's edge are copied, so a cube of any size is spread over tasks of bounded memory.
    """
    def reach(c: str) -> Column:
        low, high = F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)), high))

    spread = pixels.withColumn("__ty", reach("line")).withColumn("__tx", reach("sample"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = int(frame["__ty"].iloc[0]) * tile, int(frame["__tx"].iloc[0]) * tile
        return kernel(frame, y, y + tile, x, x + tile)

    return spread.groupBy("cube_id", "__ty", "__tx").applyInPandas(run, schema)


def median_filter(pixels: DataFrame, size: int, lines: int, samples: int, tile: int = TILE) -> DataFrame:
    """Median over size x size neighbours, replicated at the image's borders; NaN sorts first. No-op for a size of 1 or less."""
    if size <= 1:
        return pixels
    half = size // 2
    out = pixels.withColumn("spectrum", doubles()).select("cube_id", "line", "sample", "spectrum")

    def kernel(frame: pd.DataFrame, y0: int, y1: int, x0: int, x1: int) -> pd.DataFrame:
        bands = len(frame["spectrum"].iloc[0])
        ly, lx = max(0, y0 - half), max(0, x0 - half)
        hy, hx = min(lines, y1 + half), min(samples, x1 + half)
        grid = np.full((hy - ly, hx - lx, bands), np.nan)
        grid[frame["line"].to_numpy() - ly, frame["sample"].to_numpy() - lx] = np.stack(frame["spectrum"].to_numpy())
        ys = np.clip(np.arange(max(y0, 0), min(y1, lines))[:, None] + np.arange(-half, half + 1), 0, lines - 1) - ly
        xs = np.clip(np.arange(max(x0, 0), min(x1, samples))[:, None] + np.arange(-half, half + 1), 0, samples - 1) - lx
        rows = []
        for i in range(len(ys)):
            near = grid[ys[i]][:, xs]  # window lines, samples, window samples, bands
            near = near.transpose(1, 0, 2, 3).reshape(len(xs), -1, bands)
            near = np.sort(np.where(np.isnan(near), -np.inf, near), axis=1)[:, near.shape[1] // 2]
            rows += list(np.where(np.isneginf(near), np.nan, near))
        have = frame[(frame["line"].between(y0, y1 - 1)) & (frame["sample"].between(x0, x1 - 1))]
        at = (have["line"].to_numpy() - y0) * len(xs) + (have["sample"].to_numpy() - x0)
        return pd.DataFrame({"cube_id": have["cube_id"], "line": have["line"], "sample": have["sample"], "spectrum": pd.Series([rows[k] for k in at], index=have.index, dtype=object)})

    return tiled(out, half, kernel, out.schema, tile)


def rotate(pixels: DataFrame, degrees: float, lines: int, samples: int) -> DataFrame:
    """Rotation about the centre onto a canvas that holds the whole image: nearest neighbour, half to even; cells from outside are NaN."""
    if degrees % 360 == 0:
        return pixels
    a = degrees * math.pi / 180
    cos, sin, cx, cy = math.cos(a), math.sin(a), samples / 2, lines / 2
    corners = [(cos * (x - cx) - sin * (y - cy) + cx, sin * (x - cx) + cos * (y - cy) + cy) for x in (0, samples) for y in (0, lines)]
    min_x, min_y = min(x for x, _ in corners), min(y for _, y in corners)
    width, height = math.ceil(max(x for x, _ in corners) - min_x), math.ceil(max(y for _, y in corners) - min_y)
    spark = pixels.sparkSession
    cell = spark.range(width * height).select(((F.col("id") - F.col("id") % width) / width).cast("int").alias("line"), (F.col("id") % width).cast("int").alias("sample"))
    grid = pixels.select("cube_id").distinct().crossJoin(cell)
    dx, dy = F.col("sample") + F.lit(min_x) - cx, F.col("line") + F.lit(min_y) - cy
    grid = grid.withColumn("__x", F.rint(cos * dx + sin * dy + cx).cast("int")).withColumn("__y", F.rint(-sin * dx + cos * dy + cy).cast("int"))
    source = pixels.select("cube_id", F.col("line").alias("__y"), F.col("sample").alias("__x"), doubles().alias("spectrum"))
    bands = stored(pixels.groupBy("cube_id").agg(F.max(F.size("spectrum")).alias("__b")), "bands")  # of a known size: broadcast if small
    out = grid.join(source, ["cube_id", "__y", "__x"], "left").join(bands, "cube_id")
    return out.select("cube_id", "line", "sample", F.coalesce("spectrum", F.array_repeat(F.lit(float("nan")), F.col("__b"))).alias("spectrum"))


def crop(pixels: DataFrame, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """Samples, lines and bands within ranges that include both ends, numbered from 0 again."""
    inside = pixels.where(F.col("line").between(*y) & F.col("sample").between(*x))
    return inside.withColumns({"line": F.col("line") - y[0], "sample": F.col("sample") - x[0], "spectrum": F.slice("spectrum", z[0] + 1, z[1] - z[0] + 1)})


def derivatives_of(pixels: DataFrame, wavelengths: list[float]) -> DataFrame:
    """``d1`` and ``d2`` (arrays) beside the pixels' other columns: central differences as in ``derivatives``, of whole spectra where they are, without a shuffle."""
    wl = np.asarray(wavelengths, float)
    step = wl[2:] - wl[:-2]
    step = np.where(np.abs(step) < 1e-6, 1.0, step)
    names = [c for c in pixels.columns if c != "spectrum"]
    schema = pixels.select(*names, doubles().alias("d1"), doubles().alias("d2")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("spectrum").flatten(), dtype=float).reshape(batch.num_rows, -1)
            d1, d2 = np.zeros_like(x), np.zeros_like(x)
            d1[:, 1:-1] = (x[:, 2:] - x[:, :-2]) / step
            d2[:, 2:-2] = (d1[:, 3:-1] - d1[:, 1:-3]) / step[1:-1]
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.ListArray.from_arrays(ends, pa.array(d.ravel())) for d in (d1, d2))], names=[*names, "d1", "d2"])

    return pixels.select(*names, doubles().alias("spectrum")).mapInArrow(run, schema)


def derivatives(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and second central differences of ``value`` over ``wl`` along ``band``; a step under 1e-6 counts as 1; ends without neighbours are 0."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("band")
    step = F.lead("wl").over(order) - F.lag("wl").over(order)
    step = F.when(F.abs(step) < 1e-6, F.lit(1.0)).otherwise(step)
    d1 = rows.withColumn("__s", step).withColumn("d1", F.coalesce((F.lead("value").over(order) - F.lag("value").over(order)) / F.col("__s"), F.lit(0.0)))
    n = F.count("*").over(Window.partitionBy(*keys))
    d2 = (F.lead("d1").over(order) - F.lag("d1").over(order)) / F.col("__s")
    inner = F.col("__k").between(3, F.col("__n") - 2)
    return d1.withColumn("__k", F.row_number().over(order)).withColumn("__n", n).withColumn("d2", F.when(inner, d2).otherwise(0.0)).drop("__s", "__k", "__n")


def mosaic(cubes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cubes side by side in the order of ``path``; shorter ones are padded with NaN to the largest height.

    ``sizes``: cube_id, path, lines, samples, bands, a row a cube; their places come from one running sum over it. Unequal band counts are an error.
    """
    from pyspark.sql import Window

    if sizes.select("bands").distinct().count() > 1:
        raise ValueError("cubes of unequal band counts can't be joined")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("left", F.coalesce(F.sum("samples").over(before), F.lit(0)).cast("int")).crossJoin(sizes.agg(F.max("lines").alias("height")))
    grid = placed.select("cube_id", "left", "bands", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)).alias("sample"), "height").select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("line"))
    joined = grid.join(cubes.select("cube_id", "line", "sample", doubles().alias("spectrum")), ["cube_id", "line", "sample"], "left")
    return joined.select(
        F.lit("mosaic").alias("cube_id"), "line", (F.col("left") + F.col("sample")).alias("sample"), F.coalesce("spectrum", F.array_repeat(F.lit(float("nan")), F.col("bands"))).alias("spectrum")
    )
