"""Aggregations over cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.valid import is_valid, let, nearest_rank, to_long, valid
from ..shared import stored
from .roi import place, select_pixels


def band_stats(pixels: DataFrame) -> DataFrame:
    """min, max, mean and population std of each band's valid values; zeros for a band without any."""
    v = valid(F.col("value"))
    return to_long(pixels).groupBy("cube_id", "band").agg(
        *[F.coalesce(f(v), F.lit(0.0)).alias(n) for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_pop, "std"))]
    )


def band_minmax(pixels: DataFrame, ignore_value: float = float("nan"), mask: DataFrame | None = None) -> DataFrame:
    """min and max of each band over values that aren't NaN or (within 1e-5) the ignore value, infinities included; 0 and 1 where none is left."""
    if mask is not None:
        pixels = select_pixels(pixels, mask)
    v = valid(F.col("value"), infinite=True)
    if ignore_value == ignore_value:
        v = F.when(F.abs(v - ignore_value) >= 1e-5, v)
    return to_long(pixels).groupBy("cube_id", "band").agg(F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(1.0)).alias("max"))


def mean_spectrum(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the valid values of each band, 0 without any, over a whole cube or by further columns."""
    by = by or []
    return to_long(pixels, *by).groupBy("cube_id", *by, "band").agg(F.coalesce(F.avg(valid(F.col("value"))), F.lit(0.0)).alias("mean"))


def mean_array(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``mean_spectrum`` as one array a cube."""
    keys = ["cube_id", *(by or [])]
    bands = mean_spectrum(pixels, by).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("band", "mean"))).alias("b"))
    return bands.select(*keys, F.col("b.mean").alias("mean"))


def roi_mean_spectrum(pixels: DataFrame, mask: DataFrame, valid_only: bool = False) -> DataFrame:
    """Mean spectrum of each region. NaN is left out of the sum but counted in the denominator, and infinities take part, unless ``valid_only``."""
    at = place(mask, pixels)
    cells = to_long(pixels.join(mask.select("roi_id", *at).distinct(), at), "roi_id")
    v = F.col("value")
    mean = F.avg(valid(v)) if valid_only else F.sum(valid(v, infinite=True)) / F.count("*")
    return cells.groupBy("cube_id", "roi_id", "band").agg(F.coalesce(mean, F.lit(0.0)).alias("mean"))


def pixel_stats(pixels: DataFrame, *keep: str) -> DataFrame:
    """mean, min, max and range over each pixel's valid bands, beside the ``keep`` columns; NaN where band 0 is NaN or no band is valid."""
    nan = F.lit(float("nan"))
    good = F.filter(F.transform("spectrum", lambda x: x.cast("double")), lambda x: is_valid(x))
    out = let(
        good,
        lambda a: F.struct(
            (F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(a) > 0, F.size(a))).alias("mean"), F.array_min(a).alias("min"), F.array_max(a).alias("max")
        ),
    )
    ok = ~F.isnan(F.col("spectrum")[0]) & F.col("s.mean").isNotNull()
    found = pixels.select("cube_id", "line", "sample", *{"spectrum": None, **dict.fromkeys(keep)}, out.alias("s"))
    columns = {"mean": F.col("s.mean"), "min": F.col("s.min"), "max": F.col("s.max"), "range": F.col("s.max") - F.col("s.min")}
    return found.select("cube_id", "line", "sample", *keep, *[F.when(ok, c).otherwise(nan).alias(n) for n, c in columns.items()])


def result_stats(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """min, max, mean, median, population std and skewness (0 for std under 1e-10), nine nearest-rank percentiles and the count of the valid values."""
    keys = keys or []
    rows = rows.select(*keys, valid(F.col(value)).alias("v")).where("v is not null")
    percents = (1, 2, 5, 25, 50, 75, 95, 98, 99)
    moments = [F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skew"), F.count("v").alias("count")]
    ranks = nearest_rank(rows, keys, "v", [(f"p{p}", float(p), "plain") for p in percents])
    basic = rows.groupBy(*keys).agg(*moments) if keys else rows.agg(*moments)
    joined = basic.join(ranks, keys) if keys else basic.crossJoin(ranks)
    skew = F.when(F.col("std") < 1e-10, F.lit(0.0)).otherwise(F.col("skew"))
    return joined.select(*keys, "min", "max", "mean", F.col("p50").alias("median"), "std", skew.alias("skew"), *[f"p{p}" for p in percents], "count")


def histogram(rows: DataFrame, value: str, bins: int = 256, lo: float | None = None, hi: float | None = None, infinite: bool = False) -> DataFrame:
    """``bin, count`` of int((v - min) / range * (bins - 1)), clamped, empty bins included; values outside lo ... hi count in the end bins."""
    v = rows.select(valid(F.col(value), infinite).alias("v")).where("v is not null")
    ends = v.agg((F.min("v") if lo is None else F.lit(lo)).alias("lo"), (F.max("v") if hi is None else F.lit(hi)).alias("hi"))
    width = F.when(F.col("hi") - F.col("lo") == 0, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width * (bins - 1)))).cast("int")
    counts = v.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def covariance(pixels: DataFrame) -> DataFrame:
    """``i, j, covariance`` (n - 1) for i <= j over the pixels without an invalid band, of each cube, in one pass over centred blocks."""
    i, j = (F.col("at") - F.col("at") % F.col("bands")) / F.col("bands"), F.col("at") % F.col("bands")
    cells = cross_products(pixels).select("cube_id", "n", F.size("mean").alias("bands"), F.posexplode("scatter").alias("at", "xy"))
    return cells.select("cube_id", i.cast("int").alias("i"), j.cast("int").alias("j"), (F.col("xy") / F.when(F.col("n") > 1, F.col("n") - 1)).alias("covariance")).where("i <= j")


#: Groups in which the tasks' moments of a cube are merged first.
_MERGERS = 64
_MOMENTS = "cube_id string, part int, n long, mean array<double>, scatter array<double>"


def _merged(one, two):
    """Count, mean and centred cross products of two disjoint sets of rows."""
    import numpy as np

    (n, m, s), (k, o, t) = one, two
    if not n or not k:
        return one if n else two
    d = o - m
    return n + k, m + d * (k / (n + k)), s + t + np.outer(d, d) * (n * k / (n + k))


def cross_products(pixels: DataFrame) -> DataFrame:
    """``cube_id, n, mean, scatter``: of each cube's pixels without an invalid band, the count, mean spectrum and centred cross products (row by row).

    Each batch is centred by itself and each task folds its batches, so what is shuffled doesn't grow with the pixels; the tasks' moments are merged in
    two steps, so none meets all of them.
    """
    import numpy as np
    import pyarrow as pa

    def rows(held: dict, part: int):
        for cube, (n, m, s) in held.items():
            yield pa.RecordBatch.from_pydict({"cube_id": [cube], "part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "mean": [m.tolist()], "scatter": [s.ravel().tolist()]})

    def fold(batches):
        from pyspark import TaskContext

        held: dict[str, tuple] = {}
        for batch in batches:
            ids = np.array(batch.column("cube_id").to_pylist(), object)
            for cube in dict.fromkeys(ids.tolist()):
                some = batch.column("spectrum").filter(pa.array(ids == cube))
                x = np.asarray(some.flatten(), dtype=float).reshape(len(some), -1)
                x = x[np.isfinite(x).all(1)]
                if not len(x):
                    own = 0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
                else:
                    mean = x.mean(0)
                    own = len(x), mean, (x - mean).T @ (x - mean)
                held[cube] = _merged(held[cube], own) if cube in held else own
        yield from rows(held, TaskContext.get().partitionId() % _MERGERS)

    def merge(batches):
        at, held = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if (r["cube_id"], r["part"]) != at:
                    yield from rows(held, at[1]) if at else ()
                    at, held = (r["cube_id"], r["part"]), {}
                m = np.array(r["mean"])
                own = r["n"], m, np.array(r["scatter"]).reshape(len(m), -1)
                held[r["cube_id"]] = _merged(held[r["cube_id"]], own) if held else own
        yield from rows(held, at[1]) if at else ()

    parts = pixels.select("cube_id", F.col("spectrum").cast("array<double>").alias("spectrum")).mapInArrow(fold, _MOMENTS)
    met = lambda some: some.repartition("cube_id", "part").sortWithinPartitions("cube_id", "part").mapInArrow(merge, _MOMENTS)
    return met(met(parts).withColumn("part", F.lit(0))).drop("part")


def percentiles(rows: DataFrame, value: str, keys: list[str], convention: str) -> DataFrame:
    """The stretch limits ``lo`` and ``hi`` at 2 and 98 per cent: ``render`` clamps int(n p) - 1 at the top, others take int(n p)."""
    high = "render_high" if convention == "render" else "plain"
    return nearest_rank(rows, keys, value, [("lo", 2.0, "plain"), ("hi", 98.0, high)])


def joint_range(rows: DataFrame, value: str, margin: float) -> DataFrame:
    """Range of a plot axis over several spectra, widened by ``margin`` of it at both ends."""
    ends = rows.agg(F.min(valid(F.col(value))).alias("lo"), F.max(valid(F.col(value))).alias("hi"))
    width = F.col("hi") - F.col("lo")
    return ends.select((F.col("lo") - margin * width).alias("lo"), (F.col("hi") + margin * width).alias("hi"))


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first occur."""
    return rows.groupBy(column).agg(F.min(order).alias("first"))


def fit_quality(rows: DataFrame, y: Column, predicted: Column) -> DataFrame:
    """R2 (0 where the variation of y is under 1e-10) and RMSE."""
    pairs = rows.select(y.alias("y"), predicted.alias("p"))
    sums = pairs.agg(F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("sse"), (F.var_pop("y") * F.count("y")).alias("sst"), F.count("y").alias("n"))
    r2 = F.when(F.col("sst") < 1e-10, F.lit(0.0)).otherwise(1 - F.col("sse") / F.when(F.col("sst") >= 1e-10, F.col("sst")))
    return sums.select(r2.alias("r2"), F.sqrt(F.col("sse") / F.when(F.col("n") > 0, F.col("n"))).alias("rmse"))


def exact_sample(rows: DataFrame, n: int, ids: list[str], by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """min(n, all) rows of each group of ``by``: those of the smallest keyed digests of ``ids``, the same ones however rows are partitioned.

    Rows of equal ids are drawn in turn. A group's count says which digests can be among its n smallest, so about n rows of a group are ever ordered, not the group; should too
    few lie below that bound, it is doubled.
    """
    by = by or []
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]).cast("binary"))
    marked = rows.withColumn("__d", digest)
    totals = stored(marked.groupBy(*by).agg(F.count("*").alias("__n")), "sample-counts")
    share = F.lit(1.0) * (n + 8 * n**0.5 + 64) / F.greatest(F.col("__n"), F.lit(1))
    least = F.lit(float(16**8))
    factor = 1
    while True:
        # the digest's first eight digits as a number
        below = F.conv(F.substring("__d", 1, 8), 16, 10).cast("double") < share * factor * least
        drawn = (marked.join(totals, by) if by else marked.crossJoin(F.broadcast(totals))).where(below)  # a row a group
        have = drawn.groupBy(*by).agg(F.count("*").alias("__m"))
        both = totals.join(have, by, "left") if by else totals.crossJoin(F.broadcast(have))
        if both.where(F.coalesce("__m", F.lit(0)) < F.least(F.col("__n"), F.lit(n))).isEmpty():
            break
        factor *= 2
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__d", *ids)  # about n rows
    return drawn.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).select(*rows.columns)


def sampled_limits(pixels: DataFrame, cells: int = 5000, seed: int = 42) -> DataFrame:
    """2nd and 98th percentile of ``cells`` random cells of each cube (all, if there are fewer)."""
    drawn = exact_sample(to_long(pixels), cells, ["line", "sample", "band"], ["cube_id"], seed)
    return nearest_rank(drawn.withColumn("v", valid(F.col("value"))), ["cube_id"], "v", [("lo", 2.0, "plain"), ("hi", 98.0, "plain")])


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two spectra (wl, value) on the union of their wavelengths."""
    return a.select("wl", F.col("value").alias("a")).join(b.select("wl", F.col("value").alias("b")), "wl", "full_outer")


def nearest_point(scores: DataFrame, x: float, y: float, within: float) -> DataFrame:
    """The row (id, x, y) nearest to a place, if any is within reach; ties go to the smaller id."""
    d = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
    return scores.withColumn("distance", d).where(F.col("distance") <= within).agg(F.min_by("id", F.struct("distance", "id")).alias("id"))
