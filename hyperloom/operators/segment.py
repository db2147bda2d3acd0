"""Segmentation: threshold, morphology, components and region growing on sparse masks, without any image in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import stretch
from ..functions.valid import nearest_rank, valid
from ..model import SegmentationParams
from ..shared import stored, whole_groups
from .graph import components
from .numbering import numbered

#: The 5 x 5 ellipse as (line, sample) offsets.
ELLIPSE = [(dy, dx) for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2) if abs(dy) < 2 or dx == 0]


def to_8bit(pixels: DataFrame, band: int, limits: tuple[float, float] | None = None) -> DataFrame:
    """``gray`` 0 ... 255 of one band, stretched between its 2nd and 98th percentile; invalid cells are 0, a range of 1e-5 or less counts as 1."""
    v = pixels.select("cube_id", "line", "sample", valid(F.col("spectrum")[band]).alias("v"))
    if limits is None:
        ends = stored(nearest_rank(v, ["cube_id"], "v", [("lo", 2.0, "plain"), ("hi", 98.0, "plain")]), "limits")  # of a known size: broadcast if small
        v = v.join(ends, "cube_id", "left").withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(1.0))})
    else:
        v = v.withColumns({"lo": F.lit(limits[0]), "hi": F.lit(limits[1])})
    t = stretch(F.col("v"), F.col("lo"), F.col("hi"), 1e-5, 1.0)
    return v.select("cube_id", "line", "sample", F.coalesce(F.floor(t * 255).cast("int"), F.lit(0)).alias("gray"))


#: Side of the tiles in which masks are dilated and eroded.
TILE = 256


def morphed(mask: DataFrame, lines: int, samples: int, steps: list[tuple[str, list[tuple[int, int]]]]) -> DataFrame:
    """The mask after "dilate" and "erode" steps with their offsets, in one pass over tiles with a halo as wide as all steps reach.

    Dilation stays within the image; erosion keeps pixels all of whose neighbours within the image are on.
    """
    halo = sum(max(max(abs(y), abs(x)) for y, x in offsets) for _, offsets in steps)
    if not steps:
        return mask.select("cube_id", "line", "sample").distinct()
    side = TILE + 2 * halo

    def shifted(a: np.ndarray, dy: int, dx: int, outside: bool) -> np.ndarray:
        """a[y + dy, x + dx] at each y, x."""
        out = np.full_like(a, outside)
        n = len(a)
        out[max(0, -dy) : n - max(0, dy), max(0, -dx) : n - max(0, dx)] = a[max(0, dy) : n - max(0, -dy), max(0, dx) : n - max(0, -dx)]
        return out

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        top, left = int(rows["ty"].iloc[0]) * TILE - halo, int(rows["tx"].iloc[0]) * TILE - halo
        y, x = np.arange(top, top + side), np.arange(left, left + side)
        inside = ((y >= 0) & (y < lines))[:, None] & ((x >= 0) & (x < samples))
        on = np.zeros((side, side), bool)
        on[rows["line"].to_numpy() - top, rows["sample"].to_numpy() - left] = True
        for kind, offsets in steps:
            if kind == "dilate":
                on = np.logical_or.reduce([shifted(on, -dy, -dx, False) for dy, dx in offsets]) & inside
            else:
                on = np.logical_and.reduce([shifted(on | ~inside, dy, dx, True) for dy, dx in offsets]) & inside
        core = np.nonzero(on[halo : halo + TILE, halo : halo + TILE])
        return pd.DataFrame({"cube_id": rows["cube_id"].iloc[0], "line": (core[0] + top + halo).astype(np.int32), "sample": (core[1] + left + halo).astype(np.int32)})

    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / TILE).cast("int"), F.floor((F.col(c) + halo) / TILE).cast("int")))
    spread = mask.select("cube_id", "line", "sample", reach("line").alias("ty")).select("*", reach("sample").alias("tx"))
    return spread.groupBy("cube_id", "ty", "tx").applyInPandas(tile, "cube_id string, line int, sample int")


def dilate(mask: DataFrame, lines: int, samples: int, offsets: list[tuple[int, int]] = ELLIPSE) -> DataFrame:
    return morphed(mask, lines, samples, [("dilate", offsets)])


def erode(mask: DataFrame, lines: int, samples: int, offsets: list[tuple[int, int]] = ELLIPSE) -> DataFrame:
    """Pixels all of whose neighbours within the image are on."""
    return morphed(mask, lines, samples, [("erode", offsets)])


def raw_mask(gray: DataFrame, lines: int, samples: int, p: SegmentationParams) -> DataFrame:
    """Thresholded pixels within the margins, closed, opened, repaired with discs and cleared of removed components."""
    on = F.col("gray") <= p.threshold if p.invert else F.col("gray") > p.threshold
    top, bottom = int(lines * p.ignore_top / 100), int(lines * p.ignore_bottom / 100)
    left, right = int(samples * p.ignore_left / 100), int(samples * p.ignore_right / 100)
    margin = F.col("line").between(top, lines - bottom - 1) & F.col("sample").between(left, samples - right - 1)
    mask = gray.where(on & margin).select("cube_id", "line", "sample")
    closed = ["dilate"] * p.close_iterations + ["erode"] * p.close_iterations
    opened = ["erode"] * p.open_iterations + ["dilate"] * p.open_iterations
    mask = morphed(mask, lines, samples, [(step, ELLIPSE) for step in closed + opened])
    if p.repair:
        disc = [(dy, dx) for dy in range(-10, 11) for dx in range(-10, 11) if dy * dy + dx * dx <= 100]
        spots = gray.select("cube_id").distinct().select("cube_id", F.explode(F.array(*[F.struct(F.lit(y).alias("line"), F.lit(x).alias("sample")) for x, y in p.repair])).alias("s")).select("cube_id", "s.*")
        mask = mask.union(dilate(spots, lines, samples, disc)).distinct()
    if p.remove:
        labelled = labels(mask, connectivity=4)
        hit = labelled.where(F.exists(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for x, y in p.remove]), lambda q: (q["y"] == F.col("line")) & (q["x"] == F.col("sample"))))
        mask = labelled.join(hit.select("cube_id", "label").distinct(), ["cube_id", "label"], "left_anti").select("cube_id", "line", "sample")
    return mask


#: Lines and samples of the tiles in which tasks join pixels; an image of any height and width is many of them.
STRIP, COLUMN = 256, 4096


def _joined_runs(line: np.ndarray, sample: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """Runs (line, first, last sample) of a strip's pixels and, for each, the first run that it is connected to within the strip."""
    order = np.lexsort((sample, line))
    line, sample = line[order], sample[order]
    new = np.r_[True, (line[1:] != line[:-1]) | (sample[1:] != sample[:-1] + 1)]
    begin = np.flatnonzero(new)
    y, a, b = line[begin], sample[begin], sample[np.r_[begin[1:], len(line)] - 1]
    root = list(range(len(begin)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lines, begin_of = np.unique(y, return_index=True)
    end_of = np.r_[begin_of[1:], len(y)]
    for k in np.flatnonzero(np.diff(lines) == 1).tolist():
        i, middle, end = int(begin_of[k]), int(end_of[k]), int(end_of[k + 1])
        j = middle
        while i < middle and j < end:
            if a[i] <= b[j] + reach and a[j] <= b[i] + reach:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    return y, a, b, np.array([find(i) for i in range(len(root))])


_TILE = ["cube_id", "strip", "col"]
_RUNS = "cube_id string, strip int, col int, line int, a int, b int, part int"


def _tile_of(line: Column, sample: Column) -> list[Column]:
    return [F.floor(line / STRIP).cast("int").alias("strip"), F.floor(sample / COLUMN).cast("int").alias("col")]


def _off_runs(line: np.ndarray, sample: np.ndarray, on: np.ndarray, lines: range, samples: range, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of a tile that aren't on; of a tile that isn't ``whole`` only those that have a row."""
    off = np.full((len(lines), len(samples)), whole)
    off[line[~on] - lines.start, sample[~on] - samples.start] = True
    off[line[on] - lines.start, sample[on] - samples.start] = False
    y, x = np.nonzero(off)
    return y + lines.start, x + samples.start


def _runs(mask: DataFrame, reach: int, background: tuple[int, int] | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """Runs of pixels (line, first and last sample), with the number of the part of their tile that they belong to: the runs of a part touch within the tile.

    ``background``: lines and samples of the images, whose other pixels are taken instead; ``pixels``: those that the images have, if not all.
    """
    whole = pixels is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _TILE):
            cube, strip, col = table.column("cube_id").combine_chunks(), table.column("strip").to_numpy(), table.column("col").to_numpy()
            code = cube.dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (strip[1:] != strip[:-1]) | (col[1:] != col[:-1])])
            line, sample = table.column("line").to_numpy(), table.column("sample").to_numpy()
            if background:
                on = table.column("on").to_numpy()
                found = []
                for k, (i, j) in enumerate(zip(new, np.r_[new[1:], len(line)])):
                    tops, lefts = (range(int(n) * size, min((int(n) + 1) * size, most)) for n, size, most in ((strip[i], STRIP, background[0]), (col[i], COLUMN, background[1])))
                    own = line[i:j] >= 0  # but for the row that stands for the tile itself
                    y, x = _off_runs(line[i:j][own], sample[i:j][own], on[i:j][own], tops, lefts, whole)
                    found.append((np.full(len(y), k), y, x))
                of, line, sample = (np.concatenate(c) for c in zip(*found))
            else:
                of = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(line)]))
            if not len(line):
                continue
            # tiles of one table lie below each other, a line apart
            top = of * (STRIP + 1) - strip[new[of]].astype(np.int64) * STRIP
            y = line + top
            once = np.r_[True, (y[1:] != y[:-1]) | (sample[1:] != sample[:-1])]
            y, a, b, root = _joined_runs(y[once], sample[once], reach)
            tile = y // (STRIP + 1)
            row = new[tile]
            part = root - np.searchsorted(tile, tile)  # counted from its tile's first run
            line_of = y - tile * (STRIP + 1) + strip[row].astype(np.int64) * STRIP
            yield pa.RecordBatch.from_arrays([cube.take(pa.array(row)), *(pa.array(v.astype(np.int32)) for v in (strip[row], col[row], line_of, a, b, part))], names=[*_TILE, "line", "a", "b", "part"])

    line, sample = F.col("line").cast("int"), F.col("sample").cast("int")
    tiles = mask.select("cube_id", *_tile_of(line, sample), line.alias("line"), sample.alias("sample"))
    if background:
        tiles = tiles.withColumn("on", F.lit(True))
    if background and pixels is not None:
        tiles = tiles.union(pixels.select("cube_id", *_tile_of(line, sample), line.alias("line"), sample.alias("sample"), F.lit(False).alias("on")))
    elif background:
        count = [(n + size - 1) // size for n, size in zip(background, (STRIP, COLUMN))]
        every = mask.select("cube_id").distinct().select("cube_id", F.explode(F.sequence(F.lit(0), F.lit(count[0] - 1))).alias("strip"))
        every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(count[1] - 1))).alias("col"), F.lit(-1).alias("line"), F.lit(-1).alias("sample"), F.lit(False).alias("on"))
        tiles = tiles.union(every)
    spread = tiles.repartition(*_TILE).sortWithinPartitions(*_TILE, "line", "sample")
    return stored(spread.mapInArrow(run, _RUNS), "runs")


def _rooted(runs: DataFrame, reach: int) -> DataFrame:
    """``cube_id, strip, col, part, id, first, root`` of each part: its first run and the smallest id among the parts that it is connected to.

    Only pixels at the tiles' edges are looked at: each is joined with the neighbours after it in reading order that lie in another tile.
    """
    keys = [*_TILE, "part"]
    parts = runs.groupBy(*keys).agg(F.min(F.struct("line", "a")).alias("first"))
    parts = stored(parts.withColumn("id", F.monotonically_increasing_id()), "parts")
    row, left, right = F.pmod("line", F.lit(STRIP)), F.pmod("a", F.lit(COLUMN)) == 0, F.pmod("b", F.lit(COLUMN)) == COLUMN - 1
    sides = F.array_distinct(F.array_compact(F.array(F.when(left, F.col("a")), F.when(right, F.col("b")))))
    edge = runs.where((row == 0) | (row == STRIP - 1) | left | right)
    edge = edge.select(*keys, "line", F.explode(F.when((row == 0) | (row == STRIP - 1), F.sequence("a", "b")).otherwise(sides)).alias("sample"))
    after = [(0, 1), (1, 0)] + ([(1, -1), (1, 1)] if reach else [])
    seen = edge.withColumn("o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in after])))
    seen = seen.select(*keys, (F.col("line") + F.col("o.dy")).alias("line"), (F.col("sample") + F.col("o.dx")).alias("sample"))
    strip, col = _tile_of(F.col("line"), F.col("sample"))
    seen = seen.where((strip != F.col("strip")) | (col != F.col("col")))
    other = edge.select("cube_id", "line", "sample", *[F.col(k).alias(f"{k}2") for k in keys[1:]])
    touching = seen.join(other, ["cube_id", "line", "sample"]).select(*keys, *[f"{k}2" for k in keys[1:]]).distinct()
    two = parts.select("cube_id", *[F.col(k).alias(f"{k}2") for k in keys[1:]], F.col("id").alias("b"))
    links = stored(touching.join(parts.select(*keys, F.col("id").alias("a")), keys).join(two, ["cube_id", *[f"{k}2" for k in keys[1:]]]).select("a", "b"), "contacts")
    if links.isEmpty():
        return parts.withColumn("root", F.col("id"))
    return parts.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")


def labels(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """``cube_id, line, sample, label``: connected components, numbered from 1 in the order of their first pixel (by line, then sample).

    Tasks join what touches within tiles of ``STRIP`` lines and ``COLUMN`` samples; only contacts across the tiles' edges are links of a distributed components job, between numbers given to the tiles' parts.
    """
    reach = 1 if connectivity == 8 else 0
    runs = _runs(mask, reach)
    named = stored(_rooted(runs, reach), "components")
    firsts = named.groupBy("cube_id", "root").agg(F.min("first").alias("first"))
    numbers = numbered(firsts, ["cube_id"], ["first"], "label").select("cube_id", "root", F.col("label").cast("int").alias("label"))
    keys = [*_TILE, "part"]
    of_part = named.join(numbers, ["cube_id", "root"]).select(*keys, "label")
    return runs.join(of_part, keys).select("cube_id", "line", "label", F.explode(F.sequence("a", "b")).alias("sample")).select("cube_id", "line", "sample", "label")


def segments(mask: DataFrame, min_area: int) -> DataFrame:
    """Components of ``min_area`` pixels or more, named Instancia_001 ... by label."""
    labelled = stored(labels(mask), "labels")
    large = labelled.groupBy("cube_id", "label").agg(F.count("*").alias("area")).where(F.col("area") >= min_area)
    name = F.format_string("Instancia_%03d", F.col("__k"))
    return labelled.join(numbered(large, ["cube_id"], ["label"], "__k").withColumn("name", name).drop("__k"), ["cube_id", "label"])


def fill_holes(mask: DataFrame, lines: int, samples: int, pixels: DataFrame | None = None) -> DataFrame:
    """The mask and the background components (four-connected) that don't touch the image's border.

    The background is made of runs inside the tiles' tasks, and only the runs of holes become pixels. ``pixels``: those that the images have, where some are missing; a
    missing pixel is no background, so it neither fills nor leads to the border.
    """
    runs = _runs(mask, 0, (lines, samples), pixels)
    named = stored(_rooted(runs, 0), "background")
    border = (F.col("line") == 0) | (F.col("line") == lines - 1) | (F.col("a") == 0) | (F.col("b") == samples - 1)
    keys = [*_TILE, "part"]
    outside = named.join(runs.where(border).select(*keys).distinct(), keys, "left_semi").select("root").distinct()
    holes = runs.join(named.join(outside, "root", "left_anti").select(*keys), keys, "left_semi")
    holes = holes.select("cube_id", "line", F.explode(F.sequence("a", "b")).alias("sample"))
    return mask.select("cube_id", "line", "sample").union(holes).distinct()


def grow(pixels: DataFrame, line: int, sample: int, tolerance: float, bands: int) -> DataFrame:
    """The four-connected region around a seed whose spectra, at every (bands / 16)-th band, are within tolerance % of 1.5 rad of the seed's."""
    step = max(1, bands // 16)
    used = F.array(*[F.col("spectrum")[b].cast("double") for b in range(0, bands, step)])
    rows = pixels.select("cube_id", "line", "sample", used.alias("v"))
    seed = rows.where((F.col("line") == line) & (F.col("sample") == sample)).select("cube_id", F.col("v").alias("s"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    length = F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("s"), F.col("s")))
    alike = dot(F.col("v"), F.col("s")) / F.when(length > 0, length) >= math.cos(tolerance / 100 * 1.5)
    near = labels(rows.join(F.broadcast(seed), "cube_id").where(alike).select("cube_id", "line", "sample"), connectivity=4)
    own = near.where((F.col("line") == line) & (F.col("sample") == sample)).select("cube_id", "label")
    return near.join(own, ["cube_id", "label"], "left_semi").select("cube_id", "line", "sample")
