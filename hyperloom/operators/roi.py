"""Regions of interest: rasterising, hit tests, mask algebra and morphology on sparse masks (rows of line and sample).

A mask with a cube_id holds pixels of those cubes alone, in every function here; one without applies to each cube.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored


def place(*masks: DataFrame) -> list[str]:
    """The columns by which masks (and pixels) meet: with cube_id where all of them have it."""
    return [*(["cube_id"] if all("cube_id" in m.columns for m in masks) else []), "line", "sample"]


def spots(mask: DataFrame, *others: DataFrame) -> DataFrame:
    """A mask's distinct pixels, by the columns that it has in common with ``others``."""
    return mask.select(*place(mask, *others)).distinct()


def _pairs(xs: Column, ys: Column) -> Column:
    return F.arrays_zip(xs.alias("x"), ys.alias("y"))


def in_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Even-odd rule against the closed polygon; fewer than three points hold nothing."""
    n = F.size(xs)

    def cross(inside: Column, i: Column) -> Column:
        j = F.when(i == 0, n - 1).otherwise(i - 1)
        xi, yi, xj, yj = (F.element_at(c, k + 1).cast("double") for c, k in ((xs, i), (ys, i), (xs, j), (ys, j)))
        hit = ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / F.when(yj != yi, yj - yi).otherwise(F.lit(1.0)) + xi)
        return inside != hit

    return (n >= 3) & F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), cross)


def contains(x: Column, y: Column) -> Column:
    """Whether the region in scope (columns kind, xs, ys, radius) holds a pixel. Rectangles include their right and bottom edges."""
    kind, xs, ys, radius = (F.col(c) for c in ("kind", "xs", "ys", "radius"))
    dx, dy = x - xs[0], y - ys[0]
    return (
        F.when(kind == "pixel", (dx == 0) & (dy == 0))
        .when(kind == "rect", x.between(xs[0], xs[0] + xs[1]) & y.between(ys[0], ys[0] + ys[1]))
        .when(kind == "circle", dx * dx + dy * dy <= radius * radius)
        .when(kind.isin("polygon", "freehand"), in_polygon(x, y, xs, ys))
        .when(kind == "mask", F.exists(_pairs(xs, ys), lambda p: (p["x"] == x) & (p["y"] == y)))
        .otherwise(False)
    )


def _box() -> list[Column]:
    """First and last x and y of the region in scope, as x0, x1, y0, y1."""
    kind, xs, ys, radius = (F.col(c) for c in ("kind", "xs", "ys", "radius"))
    rect, circle = kind == "rect", kind == "circle"
    low = lambda c: F.when(circle, c[0] - radius).when(rect, c[0]).otherwise(F.array_min(c))
    high = lambda c: F.when(circle, c[0] + radius).when(rect, c[0] + c[1]).otherwise(F.array_max(c))
    return [f.alias(n) for f, n in ((low(xs), "x0"), (high(xs), "x1"), (low(ys), "y0"), (high(ys), "y1"))]


def rasterise(rois: DataFrame, lines: int, samples: int) -> DataFrame:
    """``roi_id, line, sample`` of every pixel of every region.

    Polygons are filled line by line between their edges' crossings; other kinds are generated from their bounding boxes. No join with the grid. A cube_id of the regions stays.
    """
    own = [c for c in ("cube_id",) if c in rois.columns]
    outline = F.col("kind").isin("polygon", "freehand")
    box = rois.where(~outline).select(*own, "roi_id", "kind", "xs", "ys", "radius", *_box())
    clip = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c))
    box = box.where(f"x1 >= 0 and y1 >= 0 and x0 < {samples} and y0 < {lines}")
    cells = box.withColumn("line", F.explode(F.sequence(clip(F.col("y0"), lines - 1), clip(F.col("y1"), lines - 1)))).withColumn(
        "sample", F.explode(F.sequence(clip(F.col("x0"), samples - 1), clip(F.col("x1"), samples - 1)))
    )
    cells = cells.where(contains(F.col("sample"), F.col("line")))
    filled = scan_lines(rois.where(outline), lines, samples)
    columns = [*own, "roi_id", F.col("line").cast("int").alias("line"), F.col("sample").cast("int").alias("sample")]
    return cells.select(columns).unionByName(filled.select(columns))


def scan_lines(polygons: DataFrame, lines: int, samples: int) -> DataFrame:
    """Filled polygons (even-odd): each edge gives its crossing with each line that it spans, and a line's pixels lie between its crossings, taken in pairs.

    Work grows with the edges' heights and the pixels that are filled. A line's crossings are one array, of as many numbers as the polygon has edges there at most.
    """
    own = [c for c in ("cube_id",) if c in polygons.columns]
    back = lambda c: F.concat(F.slice(c, -1, 1), F.slice(c, 1, F.size(c) - 1))
    zipped = F.arrays_zip(F.col("xs").alias("xi"), F.col("ys").alias("yi"), back("xs").alias("xj"), back("ys").alias("yj"))
    edges = polygons.where(F.size("xs") >= 3).select(*own, "roi_id", F.xxhash64("xs", "ys").alias("shape"), F.explode(zipped).alias("e")).select(*own, "roi_id", "shape", "e.*")
    edges = edges.withColumns({"first": F.greatest(F.lit(0), F.least("yi", "yj")), "last": F.least(F.lit(lines - 1), F.greatest("yi", "yj") - 1)}).where("first <= last")
    at = edges.withColumn("line", F.explode(F.sequence("first", "last")))
    xi, yi, xj, yj = (F.col(c).cast("double") for c in ("xi", "yi", "xj", "yj"))
    crossing = (xj - xi) * (F.col("line") - yi) / (yj - yi) + xi
    rows = at.groupBy(*own, "roi_id", "shape", "line").agg(F.array_sort(F.collect_list(crossing)).alias("c"))
    pairs = rows.select(*own, "roi_id", "line", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2))).alias("k"))
    spans = pairs.select(*own, "roi_id", "line", F.greatest(F.lit(0), F.ceil(F.col("c")[F.col("k")]).cast("int")).alias("a"), F.least(F.lit(samples - 1), F.ceil(F.col("c")[F.col("k") + 1]).cast("int") - 1).alias("b"))
    return spans.where("a <= b").select(*own, "roi_id", "line", F.explode(F.sequence("a", "b")).alias("sample"))


def simplify(points: list[tuple[int, int]], epsilon: float = 2.0) -> list[tuple[int, int]]:
    """A freehand outline reduced to the points that stand out from their chord by more than ``epsilon``."""
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5

        def off(p: tuple[int, int]) -> float:
            if not length:
                return ((p[0] - ax) ** 2 + (p[1] - ay) ** 2) ** 0.5
            return abs((by - ay) * p[0] - (bx - ax) * p[1] + bx * ay - by * ax) / length

        far = max(range(a + 1, b), key=lambda i: (off(points[i]), -i), default=None)
        if far is not None and off(points[far]) > epsilon:
            keep.add(far)
            todo += [(a, far), (far, b)]
    return [points[i] for i in sorted(keep)]


def select_pixels(pixels: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Pixels under any region; all of them where the mask is None (nothing selected)."""
    return pixels if mask is None else pixels.join(spots(mask, pixels), place(mask, pixels), "left_semi")


def apply_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels outside the mask get NaN spectra."""
    inside = spots(mask, pixels).withColumn("__in", F.lit(True))
    nan = F.transform("spectrum", lambda v: F.lit(float("nan")).cast("float"))
    return pixels.join(inside, place(mask, pixels), "left").withColumn("spectrum", F.when(F.col("__in"), F.col("spectrum")).otherwise(nan)).drop("__in").select(*pixels.columns)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*place(a, b)).union(b.select(*place(a, b))).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return spots(a).join(spots(b, a), place(a, b), "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return spots(a).join(spots(b, a), place(a, b), "left_semi")


def bounds(mask: DataFrame) -> DataFrame:
    """Bounding box of each region, ends included."""
    return mask.groupBy(*place(mask)[:-2], "roi_id").agg(F.min("sample").alias("x0"), F.max("sample").alias("x1"), F.min("line").alias("y0"), F.max("line").alias("y1"))


def _neighbours(mask: DataFrame) -> DataFrame:
    """Each mask pixel seen from itself and from its four neighbours: its place, and self."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
    seen = spots(mask).withColumn("o", offsets)
    return seen.select(*place(mask)[:-2], (F.col("line") + F.col("o.dy")).alias("line"), (F.col("sample") + F.col("o.dx")).alias("sample"), ((F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("self"))


def dilate(mask: DataFrame, lines: int, samples: int, times: int = 1) -> DataFrame:
    """Grown by the four-neighbour cross, within the image."""
    for _ in range(times):
        mask = _neighbours(mask).where(f"line >= 0 and line < {lines} and sample >= 0 and sample < {samples}").select(*place(mask)).distinct()
    return mask


def erode(mask: DataFrame, times: int = 1) -> DataFrame:
    """Shrunk by the four-neighbour cross; what is outside of the image counts as off."""
    for _ in range(times):
        mask = _neighbours(mask).groupBy(*place(mask)).agg(F.count("*").alias("n"), F.max("self").alias("self")).where("n = 5 and self").select(*place(mask))
    return mask


def edges(mask: DataFrame, lines: int, samples: int) -> DataFrame:
    """Mask pixels on the image's border or with a four-neighbour off."""
    near = _neighbours(mask).groupBy(*place(mask)).agg(F.count("*").alias("n"), F.max("self").alias("self")).where("self")
    return near.where(f"n < 5 or line = 0 or sample = 0 or line = {lines - 1} or sample = {samples - 1}").select(*place(mask))


def hits(points: DataFrame, rois: DataFrame, x: str = "sample", y: str = "line") -> DataFrame:
    """``points`` with ``top``, ``first`` and ``regions``: the last and the first region (by roi_id) that hold each, and how many do (0, with nulls, where none does).

    Where both tables have a cube_id, points meet the regions of their own cube. Each region goes to the four cells at most that it touches in a grid as wide as itself (a power of two),
    and each distinct place looks into the one cell that it lies in of each grid that occurs, 32 at most; so a place is held against near regions of each size alone.
    """
    own = [c for c in ("cube_id",) if c in points.columns and c in rois.columns]
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1
    box = rois.select(*own, "roi_id", "kind", "xs", "ys", "radius", *_box()).where("x0 is not null and y0 is not null and x1 >= x0 and y1 >= y0")
    box = box.withColumn("grid", F.ceil(F.log2(size)).cast("int"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("grid"))).cast("long")
    spread = box.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    regions = stored(spread.select(*own, "grid", "cx", "cy", "roi_id", "kind", "xs", "ys", "radius"), "regions")
    grids = sorted(r["grid"] for r in regions.select("grid").distinct().collect())  # 32 at most
    at = points.select(*own, F.col(x).alias("__x"), F.col(y).alias("__y")).distinct().dropna(subset=["__x", "__y"])
    seen = at.withColumn("grid", F.explode(F.array(*[F.lit(g) for g in grids]).cast("array<int>")))
    met = seen.withColumns({"cx": cell("__x"), "cy": cell("__y")}).join(regions, [*own, "grid", "cx", "cy"]).where(contains(F.col("__x"), F.col("__y")))
    found = met.groupBy(*own, "__x", "__y").agg(F.max("roi_id").alias("top"), F.min("roi_id").alias("first"), F.count("*").alias("regions"))
    wide = points.withColumns({"__x": F.col(x), "__y": F.col(y)}).join(found, [*own, "__x", "__y"], "left")
    return wide.select(*points.columns, "top", "first", F.coalesce("regions", F.lit(0)).cast("long").alias("regions"))


def hit(rois: DataFrame, x: int, y: int, last: bool = True) -> DataFrame:
    """The region that holds a point: the last one added (top) or the first."""
    found = rois.where(contains(F.lit(x), F.lit(y)))
    return found.agg((F.max("roi_id") if last else F.min("roi_id")).alias("roi_id"))


def extremes(mask: DataFrame, along: str) -> DataFrame:
    """First and last mask index along ``line`` or ``sample`` for each row of the other."""
    other = "sample" if along == "line" else "line"
    return mask.groupBy(*place(mask)[:-2], other).agg(F.min(along).alias("first"), F.max(along).alias("last"))


def edited(rois: DataFrame, roi_id: int, **changes) -> DataFrame:
    """One region's variety, date, brix (0 to 100, or None) or notes replaced."""
    unknown = set(changes) - {"variety", "date", "brix", "notes"}
    if unknown:
        raise ValueError(f"not editable: {sorted(unknown)}")
    brix = changes.get("brix")
    if brix is not None and not 0 <= brix <= 100:
        raise ValueError("brix goes from 0 to 100")
    types = dict(rois.dtypes)
    return rois.withColumns({c: F.when(F.col("roi_id") == roi_id, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in changes.items()})


def small_as_pixel(rois: DataFrame, least: int = 4) -> DataFrame:
    """Rectangles narrower and lower than ``least`` become their corner pixel."""
    tiny = (F.col("kind") == "rect") & (F.col("xs")[1] < least) & (F.col("ys")[1] < least)
    return rois.withColumns({"xs": F.when(tiny, F.slice("xs", 1, 1)).otherwise(F.col("xs")), "ys": F.when(tiny, F.slice("ys", 1, 1)).otherwise(F.col("ys")), "kind": F.when(tiny, "pixel").otherwise(F.col("kind"))})


def boxed(rois: DataFrame, mask: DataFrame) -> DataFrame:
    """Explicit masks replaced by the rectangles around them (two pixels wide at least); other metadata stay, brix goes."""
    box = bounds(mask)
    wide = rois.join(box, "roi_id", "left")
    on = (F.col("kind") == "mask") & F.col("x0").isNotNull()
    side = lambda a, b: F.array(F.col(a), F.greatest(F.lit(2), F.col(b) - F.col(a) + 1)).cast("array<int>")
    out = wide.withColumns({"xs": F.when(on, side("x0", "x1")).otherwise(F.col("xs")), "ys": F.when(on, side("y0", "y1")).otherwise(F.col("ys")), "brix": F.when(~on, F.col("brix")), "kind": F.when(on, "rect").otherwise(F.col("kind"))})
    return out.select(*rois.columns)


def central_window(lines: int, samples: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """First and last sample and line, inclusive, of the window that is analysed where nothing is selected; small images have narrower margins."""
    x = (40, samples - 60) if samples < 1000 else (200, samples - 200)
    return x, (70 if lines < 600 else 300, lines - (40 if lines < 600 else 100))


def central(pixels: DataFrame, lines: int, samples: int) -> DataFrame:
    """The pixels within ``central_window``."""
    (x0, x1), (y0, y1) = central_window(lines, samples)
    return pixels.where(F.col("sample").between(x0, x1) & F.col("line").between(y0, y1))


def moved(rois: DataFrame, roi_id: int, step: int) -> DataFrame:
    """The regions with one moved a place up (-1) or down (1) in their order: it and its neighbour change ids. At the end of the order nothing changes."""
    beyond = F.when(F.col("roi_id") < roi_id, F.col("roi_id")) if step < 0 else F.when(F.col("roi_id") > roi_id, F.col("roi_id"))
    other = rois.agg((F.max if step < 0 else F.min)(beyond).alias("__other"))  # one row
    new = F.when(F.col("roi_id") == roi_id, F.coalesce("__other", "roi_id")).when(F.col("roi_id") == F.col("__other"), F.lit(roi_id)).otherwise(F.col("roi_id"))
    return rois.crossJoin(F.broadcast(other)).withColumn("roi_id", new.cast(rois.schema["roi_id"].dataType)).select(*rois.columns)
