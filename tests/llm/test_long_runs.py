"""Long runs of every class of character and ids at both ends of a long, through all operators."""

import zlib

import pytest

from pyspark.sql import functions as F

from hyperloom.llm import bestfit, centroids, collocations, decontaminate, langid, licences, lines, minhash, packing, pii, quality, topk, warc

ENDS = [-(2**63), 2**63 - 1, -1, 0, 10**18]
UNITS = ["-", "1", "a", "A", " ", "\n", "\t", ".", "é", "漢", "́", "‍", "\U0001f600", "\x00", "1-", "a@", "x.", "1.1.", "a b ", "a\n", "4111 ", "_", "'", "<", "::", "٣"]
LENGTH = 60_000


@pytest.fixture(scope="module")
def runs():
    texts = [u * (LENGTH // len(u)) for u in UNITS]
    texts += ["a" + "-" * LENGTH + "b", "-" * LENGTH + " mit license", "cc by " * 8_000, "", None]
    return list(zip(ENDS + list(range(1, 1 + len(texts) - len(ENDS))), texts))


@pytest.fixture
def table(docs, runs):
    return docs([(i, t, "en" if i % 2 else "de") for i, t in runs]).repartition(4)


def ids(df, name="doc_id"):
    return sorted(r[0] for r in df.select(name).collect())


def test_a_row_a_document(spark, table, runs):
    every = sorted(i for i, _ in runs)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in every], "doc_id long, quality int, toxic int")
    assert ids(lines.dedup(table)) == every
    assert ids(langid.predict(table, langid.train(table, F.lit(True)))) == every
    assert ids(quality.score(table, quality.train(table, labels, F.lit(True)))) == every
    assert ids(pii.pseudonymise(table.select("doc_id", "text"), "key")) == every
    assert ids(licences.scan(table)) == every


def test_groups(table, runs):
    got = {r["doc_id"]: r for r in minhash.groups(table).collect()}
    assert sorted(got) == sorted(i for i, _ in runs)
    for i, text in runs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        assert got[i]["n_shingles"] == len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ())


@pytest.mark.parametrize("pack,window", [(packing, 2048), (bestfit, 1024)])
def test_every_token_is_packed_once(table, runs, pack, window):
    got = pack.digests(pack.pack(table)).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in runs}
    for i, _ in runs:
        own = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and max(n for _, n in own) <= window
    assert sum(r["length"] for r in got if r["doc_id"] == runs[-1][0]) == 1  # a null text is its end id


def test_leaks_and_phrases(spark, table, runs):
    items = spark.createDataFrame([(i, t) for i, t in runs], "item_id long, text string")
    assert set(ids(decontaminate.hits(table, items))) <= {i for i, _ in runs}
    phrases = collocations.mine(table, least=2).collect()
    assert {r["lang"] for r in phrases} <= {"en", "de"} and all(r["a"] >= 2 for r in phrases)


def test_records_and_vectors(spark, runs):
    pages = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in runs], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert sorted(got) == sorted(i for i, _ in runs)
    assert all(got[i]["payload_bytes"] == len((t or "").encode()) for i, t in runs)
    x = spark.createDataFrame([(i, [((zlib.crc32(b"%d %d" % (i, k)) % 997) - 498) / 500 for k in range(64)]) for i, _ in runs], "vec_id long, embedding array<float>")
    queries = {i for i, _ in runs if i % 100 == 0}
    assert set(ids(topk.search(x), "query_id")) == queries
    assert ids(centroids.cluster(x), "vec_id") == sorted(i for i, _ in runs)
