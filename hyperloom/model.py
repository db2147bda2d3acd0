"""Data model: one row a pixel, the spectrum as an array; cube headers, regions of interest and options beside it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "cube_id string, line int, sample int, spectrum array<float>"
PIXELS_LONG = "cube_id string, band int, line int, sample int, value float"
ROIS = (
    "roi_id int, kind string, xs array<int>, ys array<int>, radius int, color int, variety string, date string, brix float, notes string"
)
MODELS = "model_id string, intercept double, coef array<double>, r2 double, rmse double"


@dataclass(frozen=True)
class Header:
    samples: int
    lines: int
    bands: int
    data_type: int = 4
    interleave: str = "bil"
    byte_order: int = 0
    header_offset: int = 0
    wavelengths: tuple[float, ...] = ()
    units: str = "nm"
    description: str = ""
    band_names: tuple[str, ...] = ()
    ignore_value: float = float("nan")
    raw: dict[str, str] = field(default_factory=dict)

    @property
    def resolution(self) -> float:
        """Mean distance of neighbouring bands."""
        return (self.wavelengths[-1] - self.wavelengths[0]) / self.bands if self.wavelengths and self.bands else 0.0


@dataclass(frozen=True)
class Cube:
    """A lazily evaluated cube; every operation gives a new one."""

    pixels: DataFrame
    header: Header
    calibrated: bool = False
    absorbance: bool = False

    def with_pixels(self, pixels: DataFrame, **changes) -> Cube:
        return replace(self, pixels=pixels, **changes)


@dataclass(frozen=True)
class SegmentationParams:
    threshold: int = 154
    invert: bool = True
    open_iterations: int = 1
    close_iterations: int = 2
    min_area: int = 4000
    ignore_top: float = 0
    ignore_bottom: float = 0
    ignore_left: float = 0
    ignore_right: float = 0
    repair: tuple[tuple[int, int], ...] = ()
    remove: tuple[tuple[int, int], ...] = ()
    stretch: tuple[float, float] | None = None


@dataclass(frozen=True)
class BatchOptions:
    calibrate: bool = True
    absorbance: bool = True
    snv: bool = False
    msc: bool = False
    savgol: bool = False
    window: int = 15
    polynomial: int = 2
    derivative: int = 1
    #: Derivatives per nm instead of per band.
    per_nm: bool = False
    median: bool = False
    segment: bool = True
    segment_band: int = 65
    segmentation: SegmentationParams = SegmentationParams()


@dataclass(frozen=True)
class RenderOptions:
    colormap: str = "rainbow"
    low: float = 2.0
    high: float = 98.0
    gamma: float = 1.0
    threshold: float = 0.0


def ramp(bands: int) -> list[float]:
    """Wavelengths assumed where a header names none: 400 to 900 nm."""
    return [400.0 + i * 500.0 / max(1, bands - 1) for i in range(bands)]


def virtual_cube(spark: SparkSession, sf_dir: str, invalid: bool = False, width: int = 25) -> DataFrame:
    """``embeddings`` seen as a cube ``width`` samples wide: line = vec_id div width, sample = vec_id mod width.

    ``invalid`` puts NaN where (vec_id * 64 + band) % 97 is 0 and infinity where it is 0 modulo 101.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    spectrum = F.col("embedding")
    if invalid:
        spectrum = F.transform(
            spectrum,
            lambda v, b: F.when((F.col("vec_id") * 64 + b) % 97 == 0, F.lit(float("nan")).cast("float"))
            .when((F.col("vec_id") * 64 + b) % 101 == 0, F.lit(float("inf")).cast("float"))
            .otherwise(v),
        )
    line = ((F.col("vec_id") - F.col("vec_id") % width) / width).cast("int")
    return rows.select(F.lit("emb").alias("cube_id"), line.alias("line"), (F.col("vec_id") % width).cast("int").alias("sample"), spectrum.alias("spectrum"), "label", "vec_id")
