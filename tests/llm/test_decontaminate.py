import random

import pytest

from hyperloom.llm import decontaminate as dec

ITEMS = "item_id long, text string"
rng = random.Random(0)
VOCABULARY = [f"word{i}" for i in range(3000)] + ["the", "of", "and", "to"] * 300


def sentence(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."


def make(r):
    items = [(i, " ".join(sentence(r, r.randrange(4, 18)) for _ in range(r.randrange(1, 5)))) for i in range(40)]
    items.append((99, " ".join(sentence(r, 20) for _ in range(12))))  # longer than a passage
    docs, leaks = [], set()
    for d in range(60):
        text = " ".join(sentence(r, 15) for _ in range(r.randrange(1, 20)))
        if d % 3 == 0:
            k = r.randrange(len(items))
            at = r.randrange(len(text))
            at = text.find(" ", at)
            text = f"{text[:at]} {items[k][1]} {text[at:]}"
            leaks.add((d, items[k][0]))
        docs.append((d, text))
    return items, docs, leaks


def brute(items, docs):
    out = set()
    for d, t in docs:
        w = dec.words(t)
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        flat = f" {' '.join(w)} "
        for i, x in items:
            q, a = dec.question_and_answer(x)
            if (q or a) and dec.overlap(q, have, flat) >= 0.5 and dec.overlap(a, have, flat) >= 0.5:
                out.add((d, i))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, spark, seed):
    items, rows, leaks = make(random.Random(seed))
    got = {(r["doc_id"], r["item_id"]) for r in dec.hits(docs(rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(items, rows) and got >= leaks
    clean = {r["doc_id"] for r in dec.clean(docs(rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


def test_index_blocks_give_the_same(docs, spark, monkeypatch):
    items, rows, _ = make(random.Random(3))
    benchmark = spark.createDataFrame(items, ITEMS)
    key = lambda df: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    whole = key(dec.hits(docs(rows), benchmark))
    monkeypatch.setattr(dec, "ITEMS_PER_INDEX", 9)
    assert key(dec.hits(docs(rows), benchmark)) == whole


def test_wand_finds_all_above_the_threshold():
    r = random.Random(4)
    items, rows, _ = make(r)
    parts = [p for _, t in items for p in dec.parts(t)]
    frequency = {}
    for p in parts:
        for w in set(p):
            frequency[w] = frequency.get(w, 0) + 1
    index = dec.build(items, frequency, len(parts), sum(map(len, parts)) / len(parts))
    for least in (0.02, 0.1, 0.3, 0.6):
        for _ in range(60):
            terms = r.sample(range(len(index.term)), min(len(index.term), r.randrange(1, 60)))
            score = {}
            for t in terms:
                for p, x in zip(index.postings[t].tolist(), index.impacts[t].tolist()):
                    score[p] = score.get(p, 0) + x
            want = {p: round(s, 9) for p, s in score.items() if s >= least - 1e-9}
            assert {p: round(s, 9) for p, s in dec.wand(index, terms, least)} == want


def test_edges(docs, spark, clashing):
    benchmark = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, ""), (3, "one two three four five six seven. and that is it."), (3, "one two three four five six seven. and that is it.")], ITEMS)
    long = "filler " * 60_000 + "one two three four five six seven. and that is it."
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "One two THREE four five six seven, and that is it"), (4, "a b c d e f")]
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in dec.hits(clashing(docs(rows)), clashing(benchmark)).collect())
    assert got == [(-1, 3), (3, 3), (3, 3)]
    kept = dec.clean(clashing(docs(rows)), benchmark)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 4]
    assert dec.hits(docs(rows), benchmark.limit(0)).count() == 0 and dec.hits(docs(rows).limit(0), benchmark).count() == 0


@pytest.mark.parametrize("per_index", [1, 10_000])
def test_every_text_of_an_item_id_counts(docs, spark, monkeypatch, per_index):
    monkeypatch.setattr(dec, "ITEMS_PER_INDEX", per_index)
    r = random.Random(5)
    items = [(1, sentence(r, 12)), (1, sentence(r, 14)), (1, sentence(r, 14)), (2, sentence(r, 12))]
    rows = [(k, f"{sentence(r, 30)} {t} {sentence(r, 30)}") for k, (_, t) in enumerate(items)] + [(9, f"{items[0][1]} {sentence(r, 200)} {items[2][1]}")]
    got = sorted((r["doc_id"], r["item_id"]) for r in dec.hits(docs(rows), spark.createDataFrame(items, ITEMS)).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 2), (9, 1)]
    assert [r["doc_id"] for r in dec.clean(docs([*rows, (10, "quite clean")]), spark.createDataFrame(items, ITEMS)).collect()] == [10]
