"""Preprocessing pipelines over cubes and the folder batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BatchOptions, Header
from ..operators import preprocess as pre
from ..operators.segment import raw_mask, segments, to_8bit
from ..operators.stats import mean_array, roi_mean_spectrum
from ..sources import envi


def interactive(pixels: DataFrame, header: Header, options: BatchOptions, white: DataFrame | None = None, dark: DataFrame | None = None, degrees: float = 0.0) -> DataFrame:
    """Calibrate, rotate, absorbance, SNV or else MSC, Savitzky-Golay, median."""
    return _steps(pixels, header, options, white, dark, degrees, both=False)


def batch(pixels: DataFrame, header: Header, options: BatchOptions, white: DataFrame | None = None, dark: DataFrame | None = None) -> DataFrame:
    """The same without rotation."""
    return _steps(pixels, header, options, white, dark, 0.0, both=False)


def sequential(pixels: DataFrame, header: Header, options: BatchOptions, white: DataFrame | None = None, dark: DataFrame | None = None) -> DataFrame:
    """As ``batch``, with SNV and MSC both where both are asked for."""
    return _steps(pixels, header, options, white, dark, 0.0, both=True)


def _steps(pixels, header, o, white, dark, degrees, both) -> DataFrame:
    lines, samples = header.lines, header.samples
    calibrated = o.calibrate and white is not None and dark is not None
    if calibrated:
        pixels = pre.calibrate(pixels, white, dark)
    if degrees % 360:
        pixels = pre.rotate(pixels, degrees, lines, samples)
        found = pixels.agg(F.max("line"), F.max("sample")).first()
        lines, samples = found[0] + 1, found[1] + 1
    if o.absorbance and calibrated:
        pixels = pre.absorbance(pixels)
    if o.snv:
        pixels = pre.snv(pixels)
    if o.msc and (both or not o.snv):
        pixels = pre.msc(pixels)
    if o.savgol:
        wl = header.wavelengths
        spacing = (wl[-1] - wl[0]) / (len(wl) - 1) if o.per_nm and len(wl) > 1 else 1.0
        pixels = pre.savgol(pixels, header.bands, o.window, o.polynomial, o.derivative, spacing)
    if o.median:
        pixels = pre.median_filter(pixels, 3, lines, samples)
    return pixels


def extract(pixels: DataFrame, header: Header, options: BatchOptions) -> tuple[DataFrame, DataFrame]:
    """Mean spectra (cube_id, roi_id, mean) of each cube's segments, or of whole cubes; and the cubes without any segment."""
    if not options.segment:
        return mean_array(pixels).select("cube_id", F.lit(1).alias("roi_id"), "mean"), pixels.select("cube_id").limit(0)
    band = min(options.segment_band, header.bands - 1)
    mask = raw_mask(to_8bit(pixels, band, options.segmentation.stretch), header.lines, header.samples, options.segmentation)
    found = segments(mask, options.segmentation.min_area)
    per_cube = pixels.join(found.select("cube_id", "line", "sample", F.col("label").alias("roi_id")), ["cube_id", "line", "sample"])
    v = F.col("v")
    cells = per_cube.select("cube_id", "roi_id", F.posexplode("spectrum").alias("band", "v")).groupBy("cube_id", "roi_id", "band")
    means = cells.agg(F.coalesce(F.sum(F.when(~F.isnan(v), v.cast("double"))) / F.count("*"), F.lit(0.0)).alias("m"))
    spectra = means.groupBy("cube_id", "roi_id").agg(F.array_sort(F.collect_list(F.struct("band", "m"))).alias("b")).select("cube_id", "roi_id", F.col("b.m").alias("mean"))
    return spectra, pixels.select("cube_id").distinct().join(found, "cube_id", "left_anti")


SPECTRA = "cube_id string, roi_id int, mean array<double>"
PROBLEMS = "file string, problem string"


def by_shape(spark: SparkSession, headers: list[str]) -> tuple[dict[tuple[int, int, int], list[str]], list[tuple[str, str]]]:
    """Headers grouped by their cubes' (lines, samples, bands), and (file, problem) of those that can't be read. Tasks open them."""

    def look(batches):
        for batch in batches:
            found = [_shape(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([e for _, e in found], pa.string())], names=["path", "shape", "problem"])

    shapes: dict[tuple[int, int, int], list[str]] = {}
    problems: list[tuple[str, str]] = []
    if not headers:
        return shapes, problems
    tasks = min(len(headers), 10_000)
    rows = spark.createDataFrame([(p,) for p in headers], "path string").repartition(tasks).mapInArrow(look, "path string, shape array<long>, problem string").collect()
    for r in sorted(rows, key=lambda r: r["path"]):
        if r["problem"] is not None:
            problems.append((r["path"], r["problem"]))
        else:
            shapes.setdefault(tuple(r["shape"]), []).append(r["path"])
    return shapes, problems


def _shape(header_path: str) -> tuple[list[int] | None, str | None]:
    """Lines, samples and bands of a cube whose data file is there as a whole, or what is wrong with it."""
    try:
        h = envi.load_header(header_path)
        store, at = envi.located(envi.binary_of(header_path))
        short = envi.file_bytes(h) - store.get_file_info(at).size
        return (None, f"the data file ends {short} bytes early") if short > 0 else ([h.lines, h.samples, h.bands], None)
    except (ValueError, OSError) as e:
        return None, str(e)


def extract_all(spark: SparkSession, headers: list[str], options: BatchOptions, white: DataFrame | None = None, dark: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Spectra of cubes, a scan and a job for each shape among them; and the files left out, with their problems, as rows worked out when they are asked for."""
    shapes, unreadable = by_shape(spark, headers)
    spectra, problems = spark.createDataFrame([], SPECTRA), spark.createDataFrame(unreadable, PROBLEMS)
    for paths in shapes.values():
        h = envi.load_header(paths[0])
        pixels = envi.read(spark, paths[0], headers="\n".join(paths))
        own, empty = extract(batch(pixels, h, options, white, dark), h, options)
        spectra = spectra.unionByName(own)
        problems = problems.union(empty.select(F.col("cube_id").alias("file"), F.lit("no objects found").alias("problem")))
    return spectra, problems


def folder(spark: SparkSession, path: str, options: BatchOptions, white: DataFrame | None = None, dark: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Spectra (cube_id, roi_id, mean) of every cube of a folder; and (file, problem) of the files left out and the cubes without segments."""
    return extract_all(spark, envi.scan_folder(path), options, white, dark)


def compare(original: DataFrame, treated: DataFrame, mask: DataFrame) -> DataFrame:
    """The regions' mean spectra before and after treatment, side by side."""
    a = roi_mean_spectrum(original, mask).withColumnRenamed("mean", "original")
    b = roi_mean_spectrum(treated, mask).withColumnRenamed("mean", "treated")
    return a.join(b, ["cube_id", "roi_id", "band"], "full_outer")
