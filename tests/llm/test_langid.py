from pyspark.sql import functions as F

from hyperloom.llm import langid
from hyperloom.llm.common import remainder


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = remainder("doc_id", 4) == 2
    got = langid.predict(docs, langid.train(docs, ~held))
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    assert got.where("score < 0 or score > 1").count() == 0 and got.count() == docs.count()


def test_edges(docs, clashing):
    rows = [(i, "the cat and the dog sat there", "en") for i in range(30)] + [(100 + i, "der hund und die katze sitzen", "de") for i in range(30)]
    model = langid.train(docs(rows), F.lit(True))
    long = "der hund und die katze " * 20_000
    odd = [(1, None), (2, ""), (3, "123 !!! ..."), (None, "the cat"), (4, long), (4, long), (5, "漢字"), (6, "́")]
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.predict(clashing(docs(odd)), model).collect()}
    assert got[1, "und"]["score"] == 0 and got[2, "und"]["rejected"] and (3, "und") in got and (6, "und") in got
    assert (None, "en") in got and (4, "de") in got and any(k[0] == 5 and k[1] != "und" for k in got)
    assert langid.predict(docs(odd).limit(0), model).count() == 0
    empty = langid.train(docs(rows).limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs([(1, "the cat")]), empty).collect()} == {"und"}


def test_labels_are_no_inputs(docs):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(50 + i, "der hund und", "de") for i in range(20)]
    model = langid.train(docs(rows), F.lit(True))
    a, b = (langid.predict(docs([(i, "the dog", lang)]), model).first() for i, lang in ((1, "en"), (2, "de")))
    assert (a["lang_pred"], a["score"]) == (b["lang_pred"], b["score"])


def grams(text):
    """Byte n-grams of 2 to 5 within words with a space at each end, hashed as the operator states."""
    clean = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
    padded = b" " + b" ".join(clean.split()) + b" "
    out = []
    for size in langid.SIZES:
        for i in range(len(padded) - size + 1):
            g = padded[i : i + size]
            if b" " in g[1:-1] or g == b"  ":
                continue
            h = size
            for b in g:
                h = (h ^ b) * 0x01000193 % 2**32
            h ^= h >> 15
            h = h * 0x85EBCA6B % 2**32
            out.append(h >> 16)
    return out


def test_scores_against_ngrams_one_by_one(spark):
    """The folded table over whole slices against logits averaged n-gram by n-gram."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, F.lit(True), max_train=150)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    seen = 0
    for r in docs.collect():
        found = grams(r["text"] or "")
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        z = (sum(model.table[g].astype(float) for g in found) / max(1, len(found)) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert abs(got[r["doc_id"]]["score"] - p.max()) < 1e-5 and got[r["doc_id"]]["lang_pred"] == model.languages[int(p.argmax())]
        assert got[r["doc_id"]]["rejected"] == (p.max() < model.threshold)
        seen += 1
    assert seen > 100
