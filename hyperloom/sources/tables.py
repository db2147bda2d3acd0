"""CSV and JSON inputs: spectral matrices, training tables, regression models and region sessions."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decompose import Pls


def _number(c: Column, comma: bool = False) -> Column:
    """A cell as a double; 0 where it doesn't parse or isn't finite."""
    text = F.regexp_replace(c, ",", ".") if comma else c
    v = F.trim(text).try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.lit(0.0))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def spectral_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, list[float]]:
    """``id, class, file, spectrum`` and the wavelengths of the header; a header that is no number counts as its column's index."""
    rows = spark.read.csv(path, header=True)
    wl = []
    for i, c in enumerate(rows.columns[3:]):
        try:
            wl.append(float(c))
        except ValueError:
            wl.append(float(i))
    first = [quoted(c).alias(n) for c, n in zip(rows.columns[:3], ("id", "class", "file"))]
    return rows.select(*first, F.array(*[_number(quoted(c)) for c in rows.columns[3:]]).alias("spectrum")), wl


def training_table(spark: SparkSession, path: str, target: str | None = None, features: str = "spectral", sep: str = ",", decimal_comma: bool = False) -> tuple[DataFrame, list[str]]:
    """``spectrum, y`` of the rows whose target parses, and the feature names.

    The default target is the first header with "brix" or "target" in it. Features are the columns named like wavelengths (``Wl_`` or a number); ``first_row_numeric``
    takes every column that is a number in the first row.
    """
    rows = spark.read.csv(path, header=True, sep=sep)
    if target is None:
        target = next((c for c in rows.columns if "brix" in c.lower() or "target" in c.lower()), None)
    if target is None:
        raise ValueError("no target column")
    if features == "spectral":
        names = [c for c in rows.columns if c != target and re.fullmatch(r"(Wl_)?\d+([.,]\d+)?", c)]
    else:
        first = rows.first()
        names = [c for c in rows.columns if c != target and _parses(first[c])]
    y = F.trim(F.regexp_replace(quoted(target), ",", ".") if decimal_comma else quoted(target)).try_cast("double")
    wide = rows.select(F.array(*[_number(quoted(c), decimal_comma) for c in names]).alias("spectrum"), y.alias("y"))
    return wide.where("y is not null and not isnan(y)"), names


def _parses(cell: str | None) -> bool:
    try:
        float(cell)
    except (TypeError, ValueError):
        return False
    return True


def sniff_separator(first_line: str) -> str:
    return max(";\t,|", key=first_line.count)


def parse_model(text: str) -> Pls:
    """A regression model in either layout: intercept on its own line, or before the coefficients."""
    import numpy as np

    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if rows[0][0].strip().lower() == "intercepto":
        return Pls(np.array([float(x) for x in rows[1][1:] if x.strip()]), float(rows[0][1]))
    values = [float(x) for x in rows[1][1:] if x.strip()]
    return Pls(np.array(values[1:]), values[0])


def model_text(model: Pls) -> str:
    return "Tipo,Intercepto\nCoeficientes," + ",".join(repr(float(x)) for x in (model.intercept, *model.coefficients)) + "\n"


SESSION = "SessionDate string, Selections array<struct<Type:string,ColorArgb:int,PointsX:array<int>,PointsY:array<int>,Radius:int,Variety:string,Date:string,MeasuredBrix:float,Notes:string>>"


def session(spark: SparkSession, path: str, samples: int, lines: int) -> DataFrame:
    """The regions of session files; a region with any point outside of the image is dropped (a rectangle's width and height count as points)."""
    return session_rois(spark.read.schema(SESSION).option("multiLine", True).json(path), samples, lines)


def session_rois(rows: DataFrame, samples: int, lines: int) -> DataFrame:
    out = rows.select(F.posexplode("Selections").alias("roi_id", "s")).select("roi_id", "s.*")
    bad = F.exists("PointsX", lambda x: (x < 0) | (x >= samples)) | F.exists("PointsY", lambda y: (y < 0) | (y >= lines))
    kinds = {"Pixel": "pixel", "Rect": "rect", "Rectangle": "rect", "Circle": "circle", "Polygon": "polygon", "Freehand": "freehand", "Mask": "mask"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("Type")], F.lower("Type"))
    return out.where(~F.coalesce(bad, F.lit(False))).select(
        "roi_id", kind.alias("kind"), F.col("PointsX").alias("xs"), F.col("PointsY").alias("ys"), F.col("Radius").alias("radius"), F.col("ColorArgb").alias("color"), F.col("Variety").alias("variety"), F.col("Date").alias("date"), F.col("MeasuredBrix").alias("brix"), F.col("Notes").alias("notes")
    )


def simulate_labels(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``Brix`` from 15 at the pixels' centre down to 8 at the farthest, with normal noise of 0.2."""
    centre = rows.agg(F.avg("PixelX").alias("cx"), F.avg("PixelY").alias("cy"))
    far = rows.crossJoin(F.broadcast(centre)).withColumn("d", F.sqrt(F.pow(F.col("PixelX") - F.col("cx"), 2) + F.pow(F.col("PixelY") - F.col("cy"), 2)))
    most = far.agg(F.max("d").alias("most"))
    return far.crossJoin(F.broadcast(most)).withColumn("Brix", 15 - F.col("d") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0) * 7 + F.randn(seed) * 0.2).drop("cx", "cy", "d", "most")
