"""The library's names in a session's SQL: ENVI files as tables, regions as rows of pixels, formulas as functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import formula
from ..sources import envi


class Rasterise:
    """``rasterise(kind, xs, ys, radius, lines, samples)``: the pixels (line, sample) of one region, as ``operators.roi.rasterise`` has them."""

    @staticmethod
    def analyze(kind: AnalyzeArgument, xs: AnalyzeArgument, ys: AnalyzeArgument, radius: AnalyzeArgument, lines: AnalyzeArgument, samples: AnalyzeArgument) -> AnalyzeResult:
        for name, argument, wanted in (("kind", kind, StringType), ("xs", xs, ArrayType), ("ys", ys, ArrayType), ("radius", radius, IntegerType), ("lines", lines, IntegerType), ("samples", samples, IntegerType)):
            if not isinstance(argument.dataType, wanted):
                raise ValueError(f"rasterise: {name} is not of type {wanted.__name__}")
        return AnalyzeResult(StructType([StructField("line", IntegerType()), StructField("sample", IntegerType())]))

    def eval(self, kind: str, xs: list[int], ys: list[int], radius: int, lines: int, samples: int) -> Iterator[tuple[int, int]]:
        if kind is None or not xs or not ys:
            return
        if kind == "circle":
            box = ys[0] - radius, ys[0] + radius, xs[0] - radius, xs[0] + radius
        elif kind == "rect":
            box = ys[0], ys[0] + ys[1], xs[0], xs[0] + xs[1]
        else:
            box = min(ys), max(ys), min(xs), max(xs)
        first, last, left, right = max(0, box[0]), min(lines - 1, box[1]), max(0, box[2]), min(samples - 1, box[3])
        x = np.arange(left, right + 1)
        marked = set(zip(ys, xs)) if kind == "mask" else None
        for line in range(first, last + 1):
            if kind in ("polygon", "freehand"):
                inside = np.zeros(len(x), bool)
                for xi, yi, xj, yj in zip(xs, ys, [xs[-1], *xs[:-1]], [ys[-1], *ys[:-1]]) if len(xs) >= 3 else ():
                    if (yi > line) != (yj > line):
                        inside ^= x < (xj - xi) * (line - yi) / (yj - yi) + xi
            elif kind == "circle":
                inside = (x - xs[0]) ** 2 + (line - ys[0]) ** 2 <= radius * radius
            elif kind == "mask":
                inside = np.array([(line, s) in marked for s in x.tolist()], bool)
            elif kind == "pixel":
                inside = (x == xs[0]) & (line == ys[0])
            else:
                inside = np.full(len(x), kind == "rect")
            for s in x[inside].tolist():
                yield line, s


def register(spark: SparkSession, formulas: dict[str, str] | None = None, wavelengths: list[float] | None = None) -> None:
    """Makes ``rasterise``, the table format ``envi`` and a function of a spectrum for each of ``formulas`` (name to text, over bands at ``wavelengths``) known to the session."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("rasterise", udtf(Rasterise))
    envi.register(spark)
    for name, text in (formulas or {}).items():
        formula.register(spark, name, text, wavelengths or [])
