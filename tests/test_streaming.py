"""Files that arrive in any order, and formulas."""

import os
import time

import numpy as np
import pytest

from hyperloom.functions import formula
from hyperloom.model import BatchOptions
from hyperloom.streaming.folder import NO_DATA, watch

from test_sources import make

OPTIONS = BatchOptions(segment=False)


def move(a, b, *names):
    for n in names:
        os.rename(a / n, b / n)


def until(check, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.5)
    return False


def test_headers_wait_for_their_data(spark, tmp_path):
    """Over a restart, whichever file comes first; a header whose data never comes is reported after the deadline."""
    folder, aside, out, problems = (tmp_path / n for n in ("in", "aside", "out", "problems"))
    folder.mkdir()
    aside.mkdir()
    for k, n in enumerate(("early", "late", "both", "never")):
        make(aside, n, values=np.full((5, 3, 4), k))
    (aside / "note.txt").write_text("x")
    move(aside, folder, "early.raw", "late.hdr", "both.hdr", "both.raw", "never.hdr", "note.txt")

    def cubes():
        return {r["cube_id"]: list(r["mean"]) for r in spark.read.parquet(str(out)).collect()} if any(out.glob("batch=*/*.parquet")) else {}

    def left_out():
        return {os.path.basename(r["file"]): r["problem"] for r in spark.read.parquet(str(problems)).collect()} if any(problems.glob("batch=*/*.parquet")) else {}

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        watch(spark, str(folder), str(out), str(tmp_path / "cp"), OPTIONS, deadline=30, problems=str(problems)).awaitTermination(120)
        assert cubes() == {"both": [2.0] * 5} and left_out() == {}
        move(aside, folder, "early.hdr", "late.raw")
        q = watch(spark, str(folder), str(out), str(tmp_path / "cp"), OPTIONS, deadline=30, problems=str(problems), trigger={"processingTime": "1 second"})
        try:
            assert until(lambda: left_out() == {"never.hdr": NO_DATA} and len(cubes()) == 3)
        finally:
            q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert cubes() == {"both": [2.0] * 5, "early": [0.0] * 5, "late": [1.0] * 5}


WL = [400.0, 500.0, 600.0]


def test_formulas_of_numbers_and_conditions(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, 2.0, nan],), ([0.0, -4.0, inf],), ([0.5, 0.25, 3.0],)], "spectrum array<float>")
    cases = {
        "B[1] + B[2] * 2": [5, -8, 1], "B{400}/B{500}": [0.5, 0, 2], "1/B[3]": [0, 0, 1 / 3], "atan(1 / B[3])": [np.pi / 2, np.pi / 2, np.arctan(1 / 3)], "atan(-1/B[1])": [-np.pi / 4, -np.pi / 2, np.arctan(-2)],
        "0/0": [0] * 3, "log(B[1])": [0, 0, np.log(0.5)], "sqrt(B[2])": [2**0.5, 0, 0.5], "IIF(B[1] > B[2], 1, -1)": [-1, 1, 1], "b[1] = 0": None,
        "B[1] > 0.4 AND NOT (B[2] = 2 OR B[3] <> 0)": [0, 0, 0], "B[1] > 0.4 and not B[2] = 2 or B[1] = 0": [0, 1, 1], "iif(sqrt(B[2]) = sqrt(B[2]), 1, 0)": [1, 0, 1], "sqrt(B[2]) <> 0": [1, 1, 1],
        "sqrt(B[2]) >= 0 OR sqrt(B[2]) < 0": [1, 0, 1], "7.5 % 2 - 7.5 % -2 + -7.5 % 2": [-1.5] * 3, "5 % 0": [0] * 3, "min(B[1], sqrt(B[2]))": [1, 0, 0.5], "max(1, sqrt(B[2]))": [2**0.5, 0, 1],
        "-2^2 + 2^3^0.5": [-4 + 2 ** (3**0.5)] * 3, "(1 < 2) = 1": None, "1 AND 2 > 1": None, "IIF(1, 2, 3)": None, "IIF(1 > 0, 2, 3 > 1)": None, "NOT 1": None, "1 = 2 = 3": None, "sqrt(1 > 2)": None, "1 <": None, "AND": None,
        "/".join(["B[2]"] * 40): [2.0**-38, (-4.0) ** -38, 4.0**38], "iif(" * 6 + "B[1] > 0" + ", B[1] > 1, B[2] > 0)" * 6: [1, 0, 1],
    }
    for text, want in cases.items():
        if want is None:
            with pytest.raises(formula.FormulaError):
                formula.compile_formula(text, WL)
        else:
            assert [r[0] for r in df.select(formula.compile_formula(text, WL)).collect()] == pytest.approx(want), text
    formula.register(spark, "some_ratio", "(B{500} - B{400}) / (B{500} + B{400})", WL)
    df.createOrReplaceTempView("some_pixels")
    found = spark.sql("select some_ratio(spectrum) as v from some_pixels where some_ratio(spectrum) > 0")
    assert sorted(r[0] for r in found.collect()) == pytest.approx([1 / 3, 1])
    assert "Lambda" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(formula.FormulaError):
        formula.register(spark, "a b", "1", WL)
    with pytest.raises(Exception, match="no finite result"):
        df.select(formula.compile_formula("1/B[3]", WL, strict=True)).collect()
    assert len(formula.formula_sql("+".join(["B[1]/B[2]"] * 60), WL)) < 200_000
