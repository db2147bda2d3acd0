import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.functions import color
from hyperloom.functions.formula import FormulaError, compile_formula
from hyperloom.functions.valid import nearest_rank
from hyperloom.model import PIXELS, ROIS, BatchOptions, Header
from hyperloom.operators import decompose, preprocess, roi, segment, stats
from hyperloom.plans import pipelines

NAN, INF = float("nan"), float("inf")


def pixels(spark, rows, cube="c"):
    """rows: {(line, sample): spectrum}"""
    return spark.createDataFrame([(cube, y, x, [float(v) for v in s]) for (y, x), s in rows.items()], PIXELS)


def spectra(df):
    return {(r["line"], r["sample"]): list(r["spectrum"]) for r in df.collect()}


def one(spark, spectrum):
    return pixels(spark, {(0, 0): spectrum})


def mask(spark, cells, cube="c"):
    return spark.createDataFrame([(cube, y, x) for y, x in cells], "cube_id string, line int, sample int")


def test_snv(spark):
    assert np.allclose(spectra(preprocess.snv(one(spark, [1, 2, 3])))[0, 0], [-1.2247449, 0, 1.2247449])
    assert spectra(preprocess.snv(one(spark, [2, 2, 2])))[0, 0] == [0, 0, 0]
    got = spectra(preprocess.snv(one(spark, [1, NAN, 3, INF])))[0, 0]
    assert got[0] == -1 and math.isnan(got[1]) and got[2] == 1 and got[3] == INF
    both = one(spark, [1, NAN, 3, INF, 7])
    assert np.allclose(spectra(preprocess.snv(both))[0, 0], spectra(preprocess.snv_expression(both))[0, 0], equal_nan=True)


def test_msc_restores_the_mean(spark):
    base = np.array([1.0, 2.0, 4.0, 3.0])
    rows = {(0, i): a + m * base for i, (a, m) in enumerate([(0, 1), (1, 2), (-1, 0.5)])}
    mean = np.mean(list(rows.values()), axis=0)
    for s in spectra(preprocess.msc(pixels(spark, rows))).values():
        assert np.allclose(s, mean, atol=1e-5)


def test_absorbance(spark):
    got = spectra(preprocess.absorbance(one(spark, [1, 0.1, 0.0001, 0, -1])))[0, 0]
    assert np.allclose(got, [0, 1, 4, 4, 4], atol=1e-6)
    with pytest.warns(UserWarning):
        preprocess.absorbance(one(spark, [1]), calibrated=False)


def test_calibrate(spark):
    white = pixels(spark, {(0, 0): [10, 10], (1, 0): [8, NAN]})
    dark = pixels(spark, {(0, 0): [2, 2]})
    got = spectra(preprocess.calibrate(pixels(spark, {(0, 0): [10, 2], (1, 0): [NAN, 1]}), white, dark))
    assert np.allclose(got[0, 0], [0.99, 0]) and math.isnan(got[1, 0][0]) and got[1, 0][1] == 0


def test_nearest_bands():
    assert preprocess.nearest_bands([450, 500, 0], [400, 500]) == [0, 1, 1]
    assert preprocess.nearest_bands([1, 2, 3], [], 5) == [0, 2, 4]


def test_savgol(spark):
    assert np.allclose(preprocess.savgol_coefficients(5, 2, 0) * 35, [-3, 12, 17, 12, -3])
    assert np.allclose(preprocess.savgol_coefficients(5, 2, 1) * 10, [-2, -1, 0, 1, 2])
    x = np.arange(12.0)
    got = spectra(preprocess.savgol(one(spark, x * x), 12, 5, 2, 1))[0, 0]
    assert np.allclose(got[2:-2], 2 * x[2:-2])
    bad = spectra(preprocess.savgol(one(spark, [1, 2, NAN, 4, 5, 6, 7, 8]), 8, 3, 1, 0))[0, 0]
    assert math.isnan(bad[2]) and bad[1] == 0 and bad[3] == 0
    with pytest.warns(UserWarning):
        preprocess.savgol(one(spark, [1, 2, 3]), 3, 5, 2, 0)
    with pytest.raises(ValueError):
        preprocess.savgol_coefficients(5, 2, 3)


@pytest.mark.parametrize("tile", [2, 128])
def test_median_over_tiles(spark, tile):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 7)).astype(np.float32)
    a[2, 3] = NAN
    got = spectra(preprocess.median_filter(pixels(spark, {(y, x): [a[y, x]] for y in range(5) for x in range(7)}), 3, 5, 7, tile))
    pad = np.pad(a, 1, mode="edge")
    for y in range(5):
        for x in range(7):
            near = sorted(pad[y : y + 3, x : x + 3].ravel().tolist(), key=lambda v: -INF if math.isnan(v) else v)
            assert got[y, x][0] == pytest.approx(near[4], nan_ok=True)


def test_rotate(spark):
    p = pixels(spark, {(y, x): [y * 10 + x] for y in range(2) for x in range(3)})
    assert preprocess.rotate(p, 360, 2, 3) is p
    turned = preprocess.rotate(p, 90, 2, 3)
    assert turned.agg(F.max("line"), F.max("sample")).first() == (2, 1)


def test_nearest_rank_conventions(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("v"))
    got = nearest_rank(rows, [], "v", [("lo", 2.0, "plain"), ("render", 98.0, "render_high"), ("hi", 98.0, "plain"), ("top", 100.0, "plain")]).first()
    assert tuple(got) == (2, 97, 98, 99)
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert nearest_rank(four, [], "v", [("m", 50.0, "plain")]).first()[0] == 3
    tied = spark.createDataFrame([(7.0,)] * 50 + [(9.0,)], "v double")
    assert nearest_rank(tied, [], "v", [("m", 50.0, "plain"), ("t", 99.0, "plain")]).first() == (7, 9)


def test_large_ranks_match_sorting(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=20000), 2)
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)], "k int, v double")
    for r in nearest_rank(df, ["k"], "v", [("a", 1.0, "plain"), ("b", 37.5, "plain"), ("c", 99.0, "plain")]).collect():
        own = np.sort(v[np.arange(len(v)) % 3 == r["k"]])
        assert [r["a"], r["b"], r["c"]] == [own[int(len(own) * p / 100)] for p in (1, 37.5, 99)]


def test_stats_of_invalid_bands(spark):
    p = pixels(spark, {(0, 0): [NAN, 1], (0, 1): [INF, 3]})
    got = {r["band"]: r for r in stats.band_stats(p).collect()}
    assert tuple(got[0])[2:] == (0, 0, 0, 0) and tuple(got[1])[2:] == (1, 3, 2, 1)
    ends = {r["band"]: (r["min"], r["max"]) for r in stats.band_minmax(p).collect()}
    assert ends[0] == (INF, INF)
    assert stats.band_stats(p.limit(0)).count() == 0


def test_roi_mean_keeps_the_denominator(spark):
    p = pixels(spark, {(0, 0): [2], (0, 1): [NAN]})
    m = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "roi_id int, line int, sample int")
    assert stats.roi_mean_spectrum(p, m).first()["mean"] == 1
    assert stats.roi_mean_spectrum(p, m, valid_only=True).first()["mean"] == 2


def test_formulas(spark):
    df = one(spark, [4, 9, -1])
    f = lambda text, **k: df.select(compile_formula(text, [400, 500, 600], **k)).first()[0]
    assert f("sqrt(B[1]) + B{510}") == 11 and f("-2^2") == -4 and f("2^3^2") == 512 and f("1+2^3") == 9 and f("(1+2)^2") == 9
    assert f("B[1]/0") == 0 and f("log(0)") == 0 and f("sqrt(B[3])") == 0 and f("1/(1/0)") == 0
    assert f("MAX(B[1], min(B[2], 7))") == 7 and f("round(2.5)") == 2 and f("B[99]") == -1 and f("B[1]", excluded=[(390, 410)]) == 0
    assert f("PI - E") == pytest.approx(math.pi - math.e) and f("2e1 * .5") == 10
    for bad in ("sqrt(1", "max(1)", "foo(1)", "1 +", "1 2", "B{x}", ""):
        with pytest.raises(FormulaError):
            f(bad)


def test_rois(spark):
    rows = [(1, "rect", [1, 2], [1, 1], 0), (2, "circle", [4], [4], 1), (3, "polygon", [0, 4, 4, 0], [0, 0, 4, 4], 0), (4, "polygon", [0, 4], [0, 4], 0), (5, "mask", [1, 3], [2, 2], 0), (6, "rect", [50, 2], [50, 2], 0)]
    df = spark.createDataFrame([(i, k, x, y, r, 0, None, None, None, None) for i, k, x, y, r in rows], ROIS)
    got = roi.rasterise(df, 10, 10)
    assert {r["roi_id"]: r["count"] for r in got.groupBy("roi_id").count().collect()} == {1: 6, 2: 5, 3: 16, 5: 2}
    assert roi.hit(df, 1, 1).first()[0] == 3 and roi.hit(df, 1, 1, last=False).first()[0] == 1 and roi.hit(df, 9, 9).first()[0] is None
    assert roi.simplify([(0, 0), (5, 1), (10, 0), (10, 10)]) == [(0, 0), (10, 0), (10, 10)]
    block = mask(spark, [(y, x) for y in (3, 4, 5) for x in (3, 4, 5)])
    assert roi.erode(block).count() == 1 and roi.dilate(block, 10, 10).count() == 21 and roi.edges(block, 10, 10).count() == 8


def test_components_and_holes(spark):
    cells = [(0, 0), (1, 1), (1, 2), (4, 4), (4, 5), (5, 5), (0, 5)]
    got = {(r["line"], r["sample"]): r["label"] for r in segment.labels(mask(spark, cells)).collect()}
    assert got == {(0, 0): 1, (1, 1): 1, (1, 2): 1, (0, 5): 2, (4, 4): 3, (4, 5): 3, (5, 5): 3}
    ring = mask(spark, [(y, x) for y in range(1, 4) for x in range(1, 4) if (y, x) != (2, 2)])
    assert segment.fill_holes(ring, 6, 6).count() == 9
    spiral = mask(spark, [(0, x) for x in range(9)] + [(y, 8) for y in range(9)] + [(8, x) for x in range(9)] + [(y, 0) for y in range(2, 9)] + [(2, x) for x in range(7)])
    assert segment.labels(spiral, 4).select("label").distinct().count() == 1


def test_missing_pixels_are_no_background(spark):
    # a hole open to the missing pixels of the last line, and one around a missing pixel
    on = [(0, x) for x in range(6)] + [(1, 0), (1, 2), (1, 3), (1, 5), (2, 0), (2, 1)]
    there = on + [(1, 1), (1, 4)]
    image = mask(spark, there)
    filled = {(r["line"], r["sample"]) for r in segment.fill_holes(mask(spark, on), 3, 6, image).collect()}
    assert filled == set(there)
    assert segment.fill_holes(mask(spark, on), 3, 6).count() == len(on) + 1


def test_numbers_round_exactly(spark):
    from hyperloom.sources.sinks import general

    known = {9 / 64: "0.14062", 7 / 64: "0.10938", 0.00390625: "0.0039062", -0.140625: "-0.14062", 0.123455: "0.12346" if "%.4e" % 0.123455 == "1.2346e-01" else "0.12345", 100000.5: "1E+05", None: None, float("-inf"): "-Infinity"}
    df = spark.createDataFrame([(v,) for v in known], "v double")
    assert [r[0] for r in df.select(general(F.col("v"), 5)).collect()] == list(known.values())


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [5, 3, 1, 0.2]
    p = pixels(spark, {(i, 0): s for i, s in enumerate(x)})
    x = x.astype(np.float32).astype(float)
    c = decompose.principal(p, 4)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(c.explained, values[::-1] / values.sum()) and np.allclose(np.abs(c.loadings), np.abs(vectors[:, ::-1]), atol=1e-6)
    n = decompose.nipals(p, 3)
    assert np.allclose(np.abs(n.loadings.T @ c.loadings[:, :3]), np.eye(3), atol=1e-3)
    j = decompose.principal(p, 2, compat="jacobi100")
    assert np.allclose(np.abs(j.loadings), np.abs(c.loadings[:, :2]), atol=1e-6)
    with pytest.raises(ValueError):
        decompose.principal(p, 5)


def test_pls_matches_least_squares_with_all_but_one_component(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    x = np.c_[x, x[:, 0] + x[:, 1]]  # rank 3
    y = x @ [1, -2, 0.5, 0] + 4 + rng.normal(size=80) * 0.01
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "spectrum array<double>, y double")
    m = decompose.train_pls(df, 3)
    fit = np.c_[x, np.ones(80)] @ np.linalg.lstsq(np.c_[x, np.ones(80)], y, rcond=None)[0]
    assert np.allclose(x @ m.coefficients + m.intercept, fit, atol=1e-6) and m.r2 > 0.999
    scaled = decompose.train_pls(df, 3, scale=True)
    assert np.allclose(x @ scaled.coefficients + scaled.intercept, fit, atol=1e-6)
    with pytest.raises(ValueError):
        decompose.train_pls(df, 4)
    with pytest.raises(ValueError):
        decompose.train_pls(df.withColumn("y", F.lit(1.0)), 1)


def test_spectral_angle(spark):
    got = {r["sample"]: r["angle"] for r in decompose.spectral_angle(pixels(spark, {(0, 0): [2, 4], (0, 1): [0, 0], (0, 2): [-2, 1]}), [1, 2]).collect()}
    assert got[0] == pytest.approx(0, abs=1e-7) and math.isnan(got[1]) and got[2] == pytest.approx(math.pi / 2)
    with pytest.raises(ValueError):
        decompose.spectral_angle(one(spark, [1, 2]), [0, 0])


def test_colors(spark):
    got = spark.range(1).select(color.colormap(F.lit(0.5)).alias("c"), color.hue_color(F.lit(120.0)).alias("h"), color.clamp(F.lit(None).cast("double")).alias("n")).first()
    assert tuple(got["c"]) == (127, 255, 127) and tuple(got["h"]) == (0, 255, 0) and got["n"] is None


def test_mosaic(spark):
    cubes = pixels(spark, {(0, 0): [1], (1, 0): [2]}, "b").union(pixels(spark, {(0, 0): [3], (0, 1): [4]}, "a"))
    sizes = spark.createDataFrame([("b", "b", 2, 1, 1), ("a", "a", 1, 2, 1)], "cube_id string, path string, lines int, samples int, bands int")
    got = {k: v[0] for k, v in spectra(preprocess.mosaic(cubes, sizes)).items()}
    assert got[0, 0] == 3 and got[0, 1] == 4 and got[0, 2] == 1 and got[1, 2] == 2 and math.isnan(got[1, 0])
    with pytest.raises(ValueError):
        preprocess.mosaic(cubes, sizes.withColumn("bands", F.when(F.col("path") == "a", 2).otherwise(1)))


def test_pipelines(spark):
    p = pixels(spark, {(y, x): [y + 1.0, x + 2.0, 3.0, 4.0 + y * x] for y in range(3) for x in range(3)})
    h = Header(3, 3, 4)
    o = BatchOptions(snv=True, msc=True, segment=False)
    assert np.allclose(list(spectra(pipelines.batch(p, h, o)).values()), list(spectra(preprocess.snv(p)).values()))
    assert np.allclose(list(spectra(pipelines.sequential(p, h, o)).values()), list(spectra(preprocess.msc(preprocess.snv(p))).values()))
    turned = pipelines.interactive(p, h, BatchOptions(median=True), degrees=90)
    assert turned.count() == 9
    means, empty = pipelines.extract(p, h, o)
    assert means.count() == 1 and empty.count() == 0


def test_numbers_of_csv_files(spark):
    from hyperloom.sources.sinks import general

    known = {123456.0: "1.2346E+05", 12345.0: "12345", 0.00001: "1E-05", 0.0000012: "1.2E-06", 0.5: "0.5", 100.0: "100", -2.50: "-2.5", 0.0: "0", 99999.6: "1E+05", NAN: "NaN", INF: "Infinity", 1e100: "1E+100", 0.000123456: "0.00012346"}
    df = spark.createDataFrame([(k,) for k in known], "v double")
    assert [r[0] for r in df.select(general(F.col("v"), 5)).collect()] == list(known.values())


def test_region_edits(spark):
    df = spark.createDataFrame([(1, "rect", [1, 2], [1, 3], 0, 0, "a", "", 5.0, ""), (2, "mask", [4], [4], 0, 0, "b", "", 7.0, "n")], ROIS)
    assert [r["variety"] for r in roi.edited(df, 2, variety="c", brix=None).orderBy("roi_id").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        roi.edited(df, 1, brix=101)
    with pytest.raises(ValueError):
        roi.edited(df, 1, kind="rect")
    assert roi.small_as_pixel(df).orderBy("roi_id").first()["kind"] == "pixel"
    m = spark.createDataFrame([(2, 3, 4), (2, 5, 4)], "roi_id int, line int, sample int")
    r = roi.boxed(df, m).where("roi_id = 2").first()
    assert (r["kind"], r["xs"], r["ys"], r["brix"], r["notes"]) == ("rect", [4, 2], [3, 3], None, "n")


def test_small_helpers(spark):
    p = pixels(spark, {(y, x): [float(y), float(x)] for y in range(30) for x in range(30)})
    lo, hi = stats.sampled_limits(p, 900).select("lo", "hi").first()
    assert 0 <= lo <= 3 and 26 <= hi <= 29
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 4.0)], "id int, x double, y double")
    assert stats.nearest_point(points, 3, 5, 10).first()[0] == 2 and stats.nearest_point(points, 99, 99, 10).first()[0] is None
    a = spark.createDataFrame([(1.0, 2.0)], "wl double, value double")
    b = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0)], "wl double, value double")
    assert sorted(tuple(r) for r in stats.side_by_side(a, b).na.fill(-1.0).collect()) == [(1.0, 2.0, 3.0), (2.0, -1.0, 4.0)]
    assert Header(1, 1, 2, wavelengths=(400.0, 500.0)).resolution == 50


def test_formulas_read_invalid_cells_as_zero(spark):
    for bad in (NAN, INF, -INF):
        assert one(spark, [bad, 2]).select(compile_formula("B[1]+B[2]+1", [400, 500])).first()[0] == 3


def test_labels_of_very_many_cubes(spark):
    cells = spark.range(40_000).select(F.col("id").cast("string").alias("cube_id"), F.explode(F.array(F.lit(0), F.lit(2))).alias("line"), F.lit(1).alias("sample"))
    got = segment.labels(cells).groupBy("cube_id").agg(F.count("*").alias("n"), F.max("label").alias("m")).where("n = 2 and m = 2").count()
    assert got == 40_000


@pytest.mark.parametrize("strip", [1, 3, 256])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_across_strips(spark, monkeypatch, strip, connectivity):
    monkeypatch.setattr(segment, "STRIP", strip)
    rng = np.random.default_rng(strip + connectivity)
    on = rng.random((17, 19)) < 0.5
    seen, want = set(), {}
    for y, x in zip(*np.nonzero(on)):
        if (y, x) in seen:
            continue
        number, todo = len(set(want.values())) + 1, [(int(y), int(x))]
        seen.add((int(y), int(x)))
        while todo:
            r, c = todo.pop()
            want[r, c] = number
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    n = (r + dy, c + dx)
                    if (connectivity == 8 or dy == 0 or dx == 0) and 0 <= n[0] < 17 and 0 <= n[1] < 19 and on[n] and n not in seen:
                        seen.add(n)
                        todo.append(n)
    got = {(r["line"], r["sample"]): r["label"] for r in segment.labels(mask(spark, list(want)), connectivity).collect()}
    assert got == want


def test_moments_of_large_values_keep_their_digits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) + 1e7
    df = spark.createDataFrame([("c", i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "cube_id string, line int, sample int, spectrum array<double>").repartition(7)
    got = {(r["i"], r["j"]): r["covariance"] for r in stats.covariance(df).collect()}
    want = np.cov(x.T)
    assert all(got[i, j] == pytest.approx(want[i, j], rel=1e-6, abs=1e-8) for i in range(3) for j in range(i, 3)) and len(got) == 6


def test_options(spark):
    from hyperloom.sources import sinks

    x = np.arange(12.0)
    p = one(spark, x * x)
    plain, per_nm = (spectra(pipelines.batch(p, Header(1, 1, 12, wavelengths=tuple(400 + 5 * x)), BatchOptions(savgol=True, window=5, segment=False, per_nm=n)))[0, 0] for n in (False, True))
    assert np.allclose(np.array(plain) / 5, per_nm) and np.allclose(plain[2:-2], 2 * x[2:-2])
    assert one(spark, [4.0]).select(compile_formula("sqrt(B[1])", [400], strict=True)).first()[0] == 2
    with pytest.raises(Exception, match="no finite result"):
        one(spark, [0.0]).select(compile_formula("1/B[1]", [400], strict=True)).collect()
    means = spark.createDataFrame([("img_7", 1, [1.0, 2.0])], "cube_id string, roi_id int, mean array<double>")
    table = sinks.formatted(sinks.batch_table(means, [400.0, 401.0]), 5, ["Image_Name", "Instance_ID"])
    problems = spark.createDataFrame([("a", "no objects found"), ("b", "bad header")], "file string, problem string")
    got = sorted(map(tuple, sinks.with_problems(table, problems).collect()))
    assert got == [("a", "NO_OBJECTS_FOUND", None, None), ("b", "ERROR: bad header", None, None), ("img_7", "Instancia_001", "1", "2")]
