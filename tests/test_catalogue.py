"""Every registered cube query against its SQL on DuckDB."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from hyperloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == plain(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def matrix(spark, sf_dir):
    """The virtual cube's places and spectra, in order."""
    rows = sorted(((r["line"], r["sample"]), list(r["spectrum"])) for r in catalogue.cube(spark, sf_dir).collect())
    return [k for k, _ in rows], np.array([v for _, v in rows])


def leading(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    v = vectors[:, ::-1][:, :k]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])


def by_place(df, names):
    return {(r["line"], r["sample"]): [r[n] for n in names] for r in df.collect()}


def test_scores_of_principal_components(spark, sf_dir, matrix):
    places, x = matrix
    want = (x - x.mean(0)) @ leading(x, 3)
    got = by_place(catalogue.queries()["pca_scores"](spark, sf_dir), ("pc1", "pc2", "pc3"))
    assert np.allclose([got[p] for p in places], want, atol=2e-6)


def test_components_as_colours(spark, sf_dir, matrix):
    places, x = matrix
    fit = x[[y % 4 == 0 and s % 4 == 0 for y, s in places]]
    t = (x - fit.mean(0)) @ leading(fit, 3)
    want = (t - t.min(0)) / (t.max(0) - t.min(0)) * 255
    got = by_place(catalogue.queries()["pca_rgb"](spark, sf_dir), "rgb")
    assert all(abs(g - w) <= 1 and g <= w + 1e-6 for p, row in zip(places, want) for g, w in zip(got[p], row))


def test_nipals_on_the_matrix_itself(spark, sf_dir, matrix):
    places, x = matrix
    rest = x - x.mean(0)
    loadings = []
    for _ in range(3):
        t, before = rest[:, 0].copy(), 0.0
        for _ in range(100):
            p = rest.T @ t
            p /= np.linalg.norm(p)
            t = rest @ p
            if abs(t @ t - before) < 1e-6:
                break
            before = t @ t
        loadings.append(p)
        rest = rest - np.outer(t, p)
    got = by_place(catalogue.queries()["nipals"](spark, sf_dir), ("pc1", "pc2", "pc3"))
    assert np.allclose([got[p] for p in places], (x - x.mean(0)) @ np.array(loadings).T, atol=1e-5)


def test_layers_of_the_analysed_cube(spark, sf_dir, matrix):
    places, x = matrix
    t = x @ leading(x, 5)
    t = (t - t.min(0)) / (t.max(0) - t.min(0))
    want = np.c_[x.mean(1), x.min(1), x.max(1), x.max(1) - x.min(1), t]
    got = {}
    for r in catalogue.queries()["analysed_cube"](spark, sf_dir).collect():
        got[r["line"], r["sample"], r["band"]] = r["value"]
    assert len(got) == want.size
    assert all(abs(got[(*p, b)] - v) < 2e-6 for p, row in zip(places, want) for b, v in enumerate(row))
