"""Nearest joins, hit tests, scan lines, samples and numbering, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.model import ROIS
from hyperloom.operators import roi, segment, stats
from hyperloom.operators.nearest import nearest_join
from hyperloom.operators.numbering import numbered
from hyperloom.shared import whole_groups


def plain_nearest(left, right, direction):
    """(id, key, x) rows, each with the (x, id) of its match and the distance."""
    out = []
    for i, k, x in left:
        near = [(abs(x - y), y, j) for j, m, y in right if k is not None and m == k and x is not None and y is not None and x == x and y == y and (direction == "nearest" or (y <= x if direction == "backward" else y >= x))]
        d, _, j = min(near, default=(None, None, None))
        out.append((i, j, d))
    return sorted(out)


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
def test_nearest_join(spark, direction):
    rng = np.random.default_rng(1)
    nan = float("nan")
    left = [(i, ["a", "b", "c", "a", "a", None][i % 6], float(x)) for i, x in enumerate(rng.integers(0, 60, 400) / 2)] + [(1000, "a", None), (1001, "a", nan), (1002, "d", 1.0)]
    left += [(2000 + i, "a", 7.25) for i in range(100)]  # one place for a fifth of all rows
    right = [(i, ["a", "b", None][i % 3], float(x)) for i, x in enumerate(rng.integers(5, 50, 120))] + [(500, "a", None), (501, "b", nan), (502, "c", -3.0), (503, "c", -3.0)]
    schema = "id long, k string, x double"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("id", "other")
    got = sorted((x["id"], x["other"], x["distance"]) for x in nearest_join(l, r, "x", ["other"], ["k"], direction).collect())
    assert got == plain_nearest(left, right, direction)


def test_nearest_join_without_keys_and_by_time(spark):
    left, right = spark.range(200).selectExpr("id", "cast(id * 7 % 50 as int) as x"), spark.range(40).selectExpr("id as other", "cast(id * 3 % 44 as int) as x")
    rows = [(i, 0, i * 7 % 50) for i in range(200)]
    want = plain_nearest(rows, [(i, 0, i * 3 % 44) for i in range(40)], "nearest")
    assert sorted((x["id"], x["other"], x["distance"]) for x in nearest_join(left, right, "x", ["other"]).collect()) == want
    day = lambda df, c: df.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("x")).alias("d"), c)
    got = nearest_join(day(left, "id"), day(right, "other"), "d", ["other"])
    assert sorted((x["id"], x["other"], x["distance"]) for x in got.collect()) == want and dict(got.dtypes)["distance"] == "bigint"
    at = lambda df, c: df.select(F.timestamp_millis(F.col("x").cast("long")).alias("t"), c)
    assert [x["distance"] for x in nearest_join(at(left, "id").where("id = 7"), at(right, "other"), "t", ["other"]).collect()] == [1000 * want[7][2]]
    assert [tuple(x) for x in nearest_join(left.where("id = 1"), right.limit(0), "x", ["other"]).collect()] == [(1, 7, None, None)]
    assert nearest_join(left.limit(0), right, "x", ["other"]).count() == 0
    with pytest.raises(ValueError):
        nearest_join(left, right.withColumnRenamed("other", "id"), "x", ["id"])
    with pytest.raises(ValueError):
        nearest_join(left, right, "x", ["other"], direction="sideways")


def regions(rng, n, size):
    out = []
    for i in range(n):
        kind = ["rect", "circle", "polygon", "pixel", "freehand", "mask"][i % 6]
        x, y, r = (int(v) for v in rng.integers(-5, 40, 3))
        k = int(rng.integers(1, size))
        xs, ys = {"rect": ([x, k], [y, r % size]), "circle": ([x], [y]), "pixel": ([x], [y])}.get(kind, (rng.integers(x, x + size, 3 + i % 5).tolist(), rng.integers(y, y + size, 3 + i % 5).tolist()))
        out.append((i, kind, xs, ys, k, 0, None, None, None, None))
    return out


def holds(region, x, y):
    _, kind, xs, ys, radius, *_ = region
    if kind == "rect":
        return xs[0] <= x <= xs[0] + xs[1] and ys[0] <= y <= ys[0] + ys[1]
    if kind == "circle":
        return (x - xs[0]) ** 2 + (y - ys[0]) ** 2 <= radius**2
    if kind == "pixel":
        return (x, y) == (xs[0], ys[0])
    if kind == "mask":
        return (x, y) in set(zip(xs, ys))
    inside = False
    for i in range(len(xs)):
        xi, yi, xj, yj = xs[i], ys[i], xs[i - 1], ys[i - 1]
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            inside = not inside
    return inside


@pytest.mark.parametrize("size", [3, 12, 60])
def test_rasterise_hits_and_sql(spark, size):
    from hyperloom.plans import sql

    rows = regions(np.random.default_rng(size), 48, size)
    df = spark.createDataFrame(rows, ROIS)
    want = sorted((r[0], y, x) for r in rows for y in range(30) for x in range(25) if holds(r, x, y))
    assert sorted(tuple(r) for r in roi.rasterise(df, 30, 25).distinct().collect()) == want
    points = spark.range(30 * 25).selectExpr("id", "cast(id div 25 as int) as line", "cast(id % 25 as int) as sample")
    got = {r["id"]: (r["top"], r["first"], r["regions"]) for r in roi.hits(points.union(points.where("id < 50")), df).collect()}
    by = {}
    for i, y, x in want:
        by.setdefault(25 * y + x, []).append(i)
    assert got == {i: (max(by[i]), min(by[i]), len(by[i])) if i in by else (None, None, 0) for i in range(750)}
    sql.register(spark)
    df.createOrReplaceTempView("some_regions")
    again = spark.sql("select r.roi_id, m.line, m.sample from some_regions r, lateral rasterise(r.kind, r.xs, r.ys, r.radius, 30, 25) m")
    assert sorted(tuple(r) for r in again.collect()) == want


def test_hits_of_cubes_and_odd_points(spark):
    df = spark.createDataFrame([("a", 1, "rect", [0, 5], [0, 5], 0), ("b", 2, "circle", [2], [2], 1), ("a", 3, "mask", [], [], 0)], "cube_id string, roi_id int, kind string, xs array<int>, ys array<int>, radius int")
    points = spark.createDataFrame([(1, "a", 2, 2), (2, "b", 2, 2), (3, "b", 5, 5), (4, "c", 2, 2), (5, "a", None, 2), (6, None, 2, 2)], "id int, cube_id string, line int, sample int")
    got = {r["id"]: (r["top"], r["regions"]) for r in roi.hits(points, df).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: (None, 0)}
    every = {r["id"]: r["regions"] for r in roi.hits(points.drop("cube_id"), df).collect()}
    assert every == {1: 2, 2: 2, 3: 1, 4: 2, 5: 0, 6: 2}
    assert [r["regions"] for r in roi.hits(points.where("id = 1"), df.limit(0)).collect()] == [0]


def test_exact_sample(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 100 = 0 then 'few' else 'many' end as k", "id * 2 as v")
    got = stats.exact_sample(rows.repartition(7), 300, ["id"], ["k"])
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"few": 50, "many": 300}
    key = lambda df: sorted(r["id"] for r in df.collect())
    assert key(got) == key(stats.exact_sample(rows.coalesce(1), 300, ["id"], ["k"])) != key(stats.exact_sample(rows, 300, ["id"], ["k"], seed=1))
    assert stats.exact_sample(rows, 10, ["id"]).count() == 10 and stats.exact_sample(rows, 9000, ["id"]).count() == 5000
    assert stats.exact_sample(rows.limit(0), 10, ["id"], ["k"]).count() == 0 and stats.exact_sample(rows.limit(0), 10, ["id"]).count() == 0
    assert stats.exact_sample(rows.unionAll(rows), 40, ["k"], ["k"]).groupBy("k").count().where("count = 40").count() == 2  # equal ids


def test_numbered(spark):
    rows = spark.range(3000).selectExpr("id", "id % 3 * (id % 2) as k", "struct(id * 7919 % 3001 as o, id as i) as o")
    got = {(r["k"], r["o"]["o"]): r["n"] for r in numbered(rows, ["k"], ["o"], "n").collect()}
    by = {}
    for i in range(3000):
        by.setdefault(i % 3 * (i % 2), []).append(i * 7919 % 3001)
    assert got == {(k, o): n for k, all_ in by.items() for n, o in enumerate(sorted(all_), 1)}
    assert numbered(rows.limit(0), ["k"], ["o"], "n").count() == 0


def test_whole_groups():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(40):
        k = np.sort(rng.integers(0, 9, 60))
        table = pa.table({"k": k, "j": k % 2})
        cuts = np.sort(rng.integers(0, 61, 6))
        batches = [b for a, z in zip(np.r_[0, cuts], np.r_[cuts, 60]) for b in table.slice(a, z - a).to_batches()]
        out = list(whole_groups(iter(batches), ["k", "j"], int(rng.integers(1, 30))))
        assert pa.concat_tables(out).to_pydict() == table.to_pydict()
        assert sum(len(set(t.column("k").to_pylist())) for t in out) == len(set(k.tolist()))


def flood(on, four):
    """Components by search, numbered by their first pixel."""
    label, n = {}, 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([] if four else [(1, 1), (1, -1), (-1, 1), (-1, -1)])
    for start in sorted(on):
        if start in label:
            continue
        n += 1
        todo = [start]
        while todo:
            p = todo.pop()
            if p in on and p not in label:
                label[p] = n
                todo += [(p[0] + dy, p[1] + dx) for dy, dx in steps]
    return label


@pytest.mark.parametrize("tile", [(3, 4), (1, 1), (256, 5), (4, 4096)])
def test_components_over_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(segment, "STRIP", tile[0])
    monkeypatch.setattr(segment, "COLUMN", tile[1])
    rng = np.random.default_rng(5)
    cubes = {c: {(int(y), int(x)) for y, x in zip(*np.nonzero(rng.random((11, 17)) < share))} for c, share in (("a", 0.5), ("b", 0.62), ("c", 0.02))}
    mask = spark.createDataFrame([(c, y, x) for c, on in cubes.items() for y, x in on], "cube_id string, line int, sample int")
    for connectivity in (4, 8):
        got = {(r["cube_id"], r["line"], r["sample"]): r["label"] for r in segment.labels(mask.union(mask.limit(5)), connectivity).collect()}
        assert got == {(c, *p): k for c, on in cubes.items() for p, k in flood(on, connectivity == 4).items()}
    filled = {(r["cube_id"], r["line"], r["sample"]) for r in segment.fill_holes(mask, 11, 17).collect()}
    want = set()
    for c, on in cubes.items():
        off = flood({(y, x) for y in range(11) for x in range(17)} - on, True)
        outside = {k for (y, x), k in off.items() if y in (0, 10) or x in (0, 16)}
        want |= {(c, *p) for p in on} | {(c, *p) for p, k in off.items() if k not in outside}
    assert filled == want


def test_masks_of_many_cubes(spark):
    """A mask with cube ids selects pixels of those cubes; one without applies to each."""
    cells = [(c, y, x, [float(y), float(x), math.nan if (c, y, x) == ("b", 0, 0) else 1.0]) for c in "ab" for y in range(4) for x in range(4)]
    pixels = spark.createDataFrame(cells, "cube_id string, line int, sample int, spectrum array<float>")
    own = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 2, 1), ("b", 3, 3, 1)], "cube_id string, line int, sample int, roi_id int")
    places = lambda df: sorted((r["cube_id"], r["line"], r["sample"]) for r in df.collect())
    assert places(roi.select_pixels(pixels, own)) == [("a", 1, 1), ("a", 1, 2), ("b", 3, 3)]
    assert len(places(roi.select_pixels(pixels, own.drop("cube_id")))) == 6
    kept = roi.apply_mask(pixels, own).where(~F.isnan(F.col("spectrum")[0]))
    assert places(kept) == [("a", 1, 1), ("a", 1, 2), ("b", 3, 3)]
    assert roi.union(own, own).count() == 3 and roi.intersect(own, own.where("cube_id = 'a'")).count() == 2 and places(roi.subtract(own, own.where("cube_id = 'a'"))) == [("b", 3, 3)]
    assert {(r["cube_id"], r["x0"], r["x1"]) for r in roi.bounds(own).collect()} == {("a", 1, 2), ("b", 3, 3)}
    assert roi.dilate(own, 4, 4).where("cube_id = 'b'").count() == 3 and roi.erode(roi.dilate(own, 4, 4)).where("cube_id = 'b'").count() == 0
    assert places(roi.edges(own, 4, 4)) == [("a", 1, 1), ("a", 1, 2), ("b", 3, 3)]
    means = {(r["cube_id"], r["band"]): r["mean"] for r in stats.roi_mean_spectrum(pixels, own).collect()}
    assert means == {("a", 0): 1.0, ("a", 1): 1.5, ("a", 2): 1.0, ("b", 0): 3.0, ("b", 1): 3.0, ("b", 2): 1.0}
    ends = {(r["cube_id"], r["band"]): (r["min"], r["max"]) for r in stats.band_minmax(pixels, mask=own).collect()}
    assert ends[("a", 1)] == (1.0, 2.0) and ends[("b", 1)] == (3.0, 3.0)


def test_components_and_scales_of_each_cube(spark):
    from hyperloom.operators import decompose

    rng = np.random.default_rng(2)
    x = {c: rng.normal(size=(40, 5)) * scale + scale for c, scale in (("a", 1.0), ("b", 50.0))}
    rows = spark.createDataFrame([(c, i, 0, v.tolist()) for c, m in x.items() for i, v in enumerate(m)], "cube_id string, line int, sample int, spectrum array<double>").repartition(5)
    got = {}
    for r in decompose.project_each(rows, 3).collect():
        got.setdefault(r["cube_id"], {})[r["line"]] = r["scores"]
    for c, m in x.items():
        values, vectors = np.linalg.eigh(np.cov(m.T))
        v = vectors[:, ::-1][:, :3]
        v = v * np.sign(v[np.abs(v).argmax(0), range(3)])
        assert np.allclose([got[c][i] for i in range(40)], (m - m.mean(0)) @ v)
    out = decompose.scaled(decompose.project_each(rows, 3), 3).groupBy("cube_id").agg(*[f(F.col("scores")[i]).alias(f"{n}{i}") for i in range(3) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    assert all(list(r)[1:] == [0.0, 1.0] * 3 for r in out.collect())
