import numpy as np
import pytest

from hyperloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    v = {}
    for i, x, *_ in rows:
        if i is None or x is None or not len(x) or any(c is None or not np.isfinite(c) for c in x):
            continue
        v[i] = [int(np.floor(1024 * float(np.float32(c)))) for c in x]
    out = []
    for q in v:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, r + 1, c, -t) for r, (t, c) in enumerate(s)]
    return sorted(out)


def search(spark, rows, **k):
    return sorted(tuple(r) for r in topk.search(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA), **k).collect())


@pytest.mark.parametrize("block", [16, 2048])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, [float(c) for c in centres[i % 12] + rng.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # equal vectors: ties go to the smaller id
    assert search(spark, rows) == brute(rows)


def test_edges(spark, clashing):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 0.0]), (5, [0.5, -1.0]), (6, [0.5, -1.0]), (None, [1.0, 1.0]), (7, []), (100, [-1.0, 0.0]), (0, [1.0, 2.0]), (5, [0.5, -1.0])]
    got = search(spark, rows)
    assert got == brute(rows) and len(got) == 6
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    assert sorted(tuple(r) for r in topk.search(clashing(df)).collect()) == got
    assert topk.search(df.limit(0)).count() == 0
    assert search(spark, [(100, [1.0])]) == [] and search(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert search(spark, [(0, [1.0, 0.0])] + [(i, [0.0, 0.0]) for i in range(1, 15)]) == brute([(0, [1.0, 0.0])] + [(i, [0.0, 0.0]) for i in range(1, 15)])


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4) * 1e5]) for i in range(120)]
    assert search(spark, rows) == brute(rows)


def test_vectors_of_any_length_score_by_what_both_have(spark):
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=int(rng.integers(1, 7)))]) for i in range(300)]
    got = search(spark, rows)
    assert got == brute(rows) and len(got) == 30
    for more in (rows + [(1000 + i, [1.0, 2.0]) for i in range(600)], rows + [(1000 + i, [0.5] * 9) for i in range(600)]):  # another commonest length
        assert search(spark, more) == brute(more)
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    con.execute("create view embeddings as select vec_id, cast(embedding as float[]) as embedding from frame")
    assert sorted(con.execute(topk.ORACLE).fetchall()) == got


def test_products_beyond_64_bits_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e30, 0.0]), (2, [3e6, -1.0]), (3, [-1e6, 1e6]), (100, [1.9e6, 0.0])]
    got = search(spark, rows)
    assert got == brute([r for r in rows if r[0] not in (1, 2)]) and {r[2] for r in got} == {0, 3, 100}


def test_expansion_is_ordered_and_stops():
    """Annuli come in falling order of their bounds, no vector beats its annulus's bound, and hopeless ones are left out."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 8)) * 4000
    x = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 8)) * 60).astype(np.int64)
    pivots, edges = topk.fit(x)
    d = topk.distances(x, pivots)
    near, r = d.argmin(1), d.min(1)
    place = near * topk.ANNULI + (r[:, None] >= edges[near]).sum(1)
    of = np.unique(place)
    parts = [np.flatnonzero(place == p) for p in of]
    directory = topk.Directory(pivots, of // topk.ANNULI, of % topk.ANNULI, *(np.array([f(p) for p in parts]) for f in (lambda p: r[p].min(), lambda p: r[p].max(), lambda p: (x[p].astype(float) ** 2).sum(1).max(), lambda p: 1)))
    q = x[:40]
    exact = q @ x.T
    least = np.sort(exact, 1)[:, -10]
    order, stop = directory.expansion(q, least)
    visited = 0
    for i in range(len(q)):
        inside = set(order[i, : stop[i]].tolist())
        assert all(exact[i, parts[e]].max() < least[i] for e in range(len(of)) if e not in inside)
        visited += stop[i]
    assert visited < 0.5 * len(q) * len(of)
    tighter, fewer = directory.expansion(q, least + 1000)
    assert (tighter == order).all() and (fewer <= stop).all()
