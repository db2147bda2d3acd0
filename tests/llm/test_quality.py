from pyspark.sql import functions as F

from hyperloom.llm import quality
from hyperloom.llm.common import remainder


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 5) == 0
    model = quality.train(docs, labels, ~held, max_train=1500)
    got = quality.score(docs.join(labels.where(held).select("doc_id"), "doc_id"), model).join(labels, "doc_id").withColumn("p", (F.col("score") >= 0.3).cast("int"))
    table = {(r["quality"], r["p"]): r["count"] for r in got.groupBy("quality", "p").count().collect()}
    good = table.get((1, 1), 0) / sum(v for (q, _), v in table.items() if q == 1)
    poor = table.get((0, 0), 0) / sum(v for (q, _), v in table.items() if q == 0)
    assert good >= 0.98 and poor >= 0.9


def small(docs, spark):
    rows = [(i, f"the quiet river ran by number {i} of the old houses", "en") for i in range(60)] + [(100 + i, "BUY!! NOW!! BUY!! NOW!! CHEAP!!", "en") for i in range(40)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in rows] + [(5, None, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs(rows), labels


def test_edges(docs, spark, clashing):
    d, labels = small(docs, spark)
    model = quality.train(clashing(d), clashing(labels), F.lit(True))
    odd = clashing(docs([(1, None), (2, ""), (3, " \n "), (None, "the old houses"), (4, "the old river " * 30_000), (4, "the old river " * 30_000), (5, "BUY!! NOW!! CHEAP!!")]))
    got = {}
    for r in quality.score(odd, model).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert got[1] == got[2] == got[3] == [model.base] and got[4][0] == got[4][1] and got[5][0] < 0.3 < got[None][0]
    kept = quality.keep(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, None}
    assert 5 not in {r["doc_id"] for r in kept.collect()}
    assert quality.score(odd.limit(0), model).count() == 0 and quality.keep(odd.limit(0), model).count() == 0
    blank = quality.train(d, labels.limit(0), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, blank).collect())


def test_fit_repeats(docs, spark):
    d, labels = small(docs, spark)
    a, b = (quality.train(d, labels, F.lit(True)) for _ in range(2))
    assert a.temperature == b.temperature and all((x == y).all() for x, y in zip(a.layers, b.layers))


def test_scores_against_a_plain_loop(spark):
    """Pooled vectors and the network, token by token."""
    import zlib

    import numpy as np

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, m).collect()}
    for r in docs.collect():
        tokens = (r["text"] or "").split()
        if not tokens:
            assert got[r["doc_id"]] == m.base
            continue
        word, form, last, counts = np.zeros(quality.DIMENSIONS), np.zeros(quality.DIMENSIONS), None, {}
        for t in tokens:
            slot = zlib.crc32(quality.edges(t)[1].lower().encode()) % quality.SLOTS
            word += m.words[slot]
            form += m.shapes[quality.SLOTS - 1 if slot == last else zlib.crc32(quality.shape(t).encode()) % (quality.SLOTS - 1)]
            counts[slot] = counts.get(slot, 0) + 1
            last = slot
        n = len(tokens)
        x = np.concatenate([word / n, form / n, [np.log1p(n), len(counts) / n, sum(c * c for c in counts.values()) / n**2]])
        w1, b1, w2, b2 = m.layers
        z = np.maximum((x - m.center) / m.scale @ w1 + b1, 0) @ w2 + b2[0]
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z / m.temperature))) < 1e-3


def test_edges_of_tokens():
    import random
    import re

    plain = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
    r = random.Random(0)
    for _ in range(3000):
        t = "".join(r.choice("aZ9_é漢-!.\u0301'") for _ in range(r.randrange(0, 9)))
        assert quality.edges(t) == plain.match(t).groups()


def test_tokens_of_a_million_characters_take_linear_time(docs, spark):
    import time

    n = 1_000_000
    odd = ["a" + "-" * n + "b", "-" * n, "-" * n + "a", "a" + "-" * n, "a" * n, ("a-" * n)[:n], "A" + "." * n + "1"]
    began = time.perf_counter()
    for t in odd:
        quality.Slots().of(t)
    assert time.perf_counter() - began < 10
    d, labels = small(docs, spark)
    model = quality.train(d, labels, F.lit(True))
    assert quality.score(docs(odd), model).count() == len(odd)
