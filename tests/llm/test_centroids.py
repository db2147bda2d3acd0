import hashlib

import numpy as np
import pytest

from hyperloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract, row by row."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x):
            kept.append((i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in x)))
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:40]
    c = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(c))

    for _ in range(5):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            own = [v for (_, v), j in zip(kept, of) if j == k]
            if own:
                c[k] = [sum(d) // len(own) for d in zip(*own)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    per = {}
    for _, k, d in found:
        per[k] = per.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, k, d, per[k], sum(per.values()), sha[k]) for i, k, d in found), key=repr)


def vectors(n, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 64))
    return [(i, [float(np.float32(c)) for c in middle[i % 12] + spread * rng.normal(size=64)]) for i in range(n)]


def run(spark, rows):
    return sorted((tuple(r) for r in centroids.cluster(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("rows", [vectors(260), vectors(90, 1, 3.0), vectors(30)], ids=["groups", "no groups", "fewer than centroids"])
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_edges(spark, clashing):
    rows = vectors(60)
    x = rows[0][1]
    rows += [(70, None), (71, []), (72, x[:63]), (73, [*x, 0.0]), (74, [None, *x[1:]]), (75, [float("nan"), *x[1:]]), (76, [float("inf"), *x[1:]])]
    rows += [(None, x), (5, rows[5][1]), (5, rows[6][1])] + [(100 + i, x) for i in range(50)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 113
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    assert sorted((tuple(r) for r in centroids.cluster(clashing(df).repartition(5)).collect()), key=repr) == got
    assert centroids.cluster(df.limit(0)).count() == 0 and run(spark, [(1, None)]) == []


def test_components_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=64) * 10.0 ** (i % 6)]) for i in range(120)]
    assert run(spark, rows) == brute(rows)
    big = [(i, [float(np.float32(c)) for c in rng.normal(size=64)]) for i in range(3)] + [(3, [1e6] * 64)]
    assert [r[0] for r in run(spark, big)] == [0, 1, 2]


@pytest.mark.parametrize("large", [1, 100_000])
def test_search_finds_the_nearest_and_compares_less(large):
    rng = np.random.default_rng(2)
    c = (rng.normal(size=(40, 64)) * np.linspace(300, 1, 64) * large).astype(np.int64)
    c[7] = c[3]
    x = c[rng.integers(0, 40, 3000)] + rng.integers(-20 * large, 20 * large, (3000, 64))
    x[:5] = c[7]
    d = ((x[:, None] - c) ** 2).sum(2)
    k, least, compared = centroids.nearest(x, c, np.arange(64))
    assert (k == d.argmin(1)).all() and (least == d.min(1)).all() and (k[:5] == 3).all()
    assert compared < 0.4 * x.shape[0] * 40 * 64
    worse = centroids.nearest(x, c, np.arange(64)[::-1].copy())
    assert (worse[0] == k).all() and worse[2] > compared
