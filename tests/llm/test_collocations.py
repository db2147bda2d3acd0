import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hyperloom.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, subsumed=100):
    """The contract, phrase by phrase; rows of (text, lang)."""
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for m in range(1, 6):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        candidates = [p for p, a in own.items() if len(p) > 1 and a >= least]
        found = []
        for p in candidates:
            a = own[p]
            if any(len(q) > len(p) and subsumed * a <= 100 * own[q] and any(q[i : i + len(p)] == p for i in range(len(q))) for q in candidates):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(n, seed=0, langs=("en", "de", None)):
    """Texts of a small vocabulary with set phrases among random words."""
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "of", "and", "Ärger", "x-y", "new", "york", "city", "hall", "b", "c", "d", "é", "漢字", " w", "in", "spite", "Ofthe"]
    phrases = ["New York City Hall", "in spite of the", "a a a a a a a", "kick\tthe  bucket", "x y z u v w"]
    out = []
    for i in range(n):
        parts = [str(rng.choice(phrases)) if rng.random() < 0.25 else str(rng.choice(vocabulary)) for _ in range(rng.integers(0, 40))]
        out.append((rng.choice([" ", "  ", "\t"]).join(p + str(rng.choice(["", "", "", ".", ",", "\n", ";:", "\x0c"])) for p in parts), langs[i % len(langs)]))
    return out


def run(spark, rows, parts=3, **k):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(parts)
    return sorted(tuple(r) for r in collocations.mine(df, **k).collect())


@pytest.mark.parametrize("words", [50, 1 << 20])
def test_against_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(collocations, "SHARD_WORDS", words)
    rows = texts(240)
    got = run(spark, rows, least=8)
    assert got == brute(rows, 8) and len({r[0] for r in got}) == 3
    assert any(len(r[2].split(" ")) == 5 for r in got)


def test_filters_that_admit_everything_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rows = texts(90, 1)
    assert run(spark, rows, least=5) == brute(rows, 5)


def test_first_phrases_of_a_language(spark, monkeypatch):
    monkeypatch.setattr(collocations, "DEALT", 3)
    rows = texts(150, 2, langs=("en",))
    got = run(spark, rows, least=3, top=7)
    assert got == brute(rows, 3, top=7) and [r[1] for r in got] == list(range(1, 8))
    assert run(spark, rows, least=3, subsumed=60) == brute(rows, 3, subsumed=60)


def test_edges(spark, docs, clashing):
    rows = [(None, "en"), ("", None), (" \t\n..", "xx"), ("a b " * 60, "en"), ("A B", None), ("word" * 5000, "en"), ("a b " * 60, "en"), ("q." * 300, "fr"), ("", "")]
    got = run(spark, rows, least=100)
    assert got == brute(rows, 100) and {r[0] for r in got} == {"en"}
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in collocations.mine(clashing(df), least=100).collect()) == got
    assert collocations.mine(df.limit(0)).count() == 0
    assert run(spark, [(None, "en"), ("", None)]) == []


def test_a_long_text_is_cut_without_losing_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TEXT_BYTES", 64)
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["a", "b", "c,", "ddd", "e" * 200], 3000))
    assert run(spark, [(text, "en")], least=20) == brute([(text, "en")], 20)


def test_automaton_counts_links_and_states():
    rng = np.random.default_rng(4)
    sequence = rng.integers(0, 5, 400).astype(np.int32)
    a = collocations.Automaton(sequence, 5)
    while len(a.levels) < 5:
        a.extend(a.open())
    truth = Counter(tuple(sequence[i : i + m].tolist()) for m in range(1, 6) for i in range(len(sequence) - m + 1) if (sequence[i : i + m] > 0).all())
    of = lambda m, k: tuple(sequence[a.levels[m - 1].place[k] :][:m].tolist())
    for m, level in enumerate(a.levels, 1):
        assert {of(m, k): int(n) for k, n in enumerate(level.count)} == {p: n for p, n in truth.items() if len(p) == m}
        if m > 1:
            assert all(of(m - 1, level.link[k]) == of(m, k)[1:] and of(m - 1, level.prefix[k]) == of(m, k)[:-1] for k in range(len(level.count)))
    found = Counter()
    states = list(a.states())
    for place, longest, shortest, n in states:
        for m in range(shortest, longest + 1):
            found[tuple(sequence[place + longest - m : place + longest].tolist())] += n
    assert found == truth and len(states) < len(truth)


def test_a_full_shard_fits_a_small_worker(spark):
    """Texts of two full shards, all of whose phrases are left: what a task holds for one of them, and for the batch that brings it."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = rng.zipf(1.3, 1_200_000) % 100_000
    df = spark.createDataFrame([(i, " ".join(map(str, words[i : i + 1000].tolist())), "en") for i in range(0, len(words), 1000)], "doc_id long, text string, lang string").coalesce(1)
    found = collocations.shards(df).select("words", "sequence").collect()
    assert sum(len(r["sequence"]) // 4 for r in found) == len(words) + 1200
    largest = max(found, key=lambda r: len(r["sequence"]))
    every = collocations.Filter(np.full(1, 2**64 - 1, np.uint64))
    tracemalloc.start()
    automaton, _, _ = collocations.walk("en", [bytes(w) for w in largest["words"]], bytes(largest["sequence"]), [every] * collocations.LENGTH)
    assert sum(1 for _ in automaton.states()) > 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_shards_of_mixed_languages_are_filled(spark, monkeypatch):
    """Each pass pays for each shard and for each different word of it, so languages that alternate must not end shards early."""
    monkeypatch.setattr(collocations, "SHARD_WORDS", 1000)
    df = spark.createDataFrame([(" ".join(f"w{(i * k) % 37}" for k in range(99)), f"l{i % 10}") for i in range(200)], "text string, lang string").coalesce(1)
    sizes = [(r["lang"], len(r["sequence"]) // 4) for r in collocations.shards(df).collect()]
    assert sum(n for _, n in sizes) == 200 * 100 and max(n for _, n in sizes) <= 1100
    assert len(sizes) == 20


@pytest.mark.parametrize("bound, value", [("HELD_WORDS", 200), ("HELD_VOCABULARY", 12), ("BATCH_BYTES", 500)])
def test_bounds_change_no_result(spark, monkeypatch, bound, value):
    monkeypatch.setattr(collocations, "bounded_batches", lambda *a, **k: None)
    monkeypatch.setattr(collocations, bound, value)
    rows = texts(120, 5)
    assert run(spark, rows, least=4) == brute(rows, 4)


def test_hashes_depend_on_word_and_language_alone():
    words = sorted({b"a" * n for n in range(1, 200)} | {b"\x00" * n for n in range(1, 70)} | {str(i).encode() for i in range(20_000)} | {"é漢".encode() * 11, b"ab", b"ba"})
    own = collocations.hashes("en", pa.array(words, pa.binary()))
    assert len(set(own.tolist())) == len(words)
    assert not set(own.tolist()) & set(collocations.hashes("de", pa.array(words, pa.binary())).tolist())
    some = np.random.default_rng(6).permutation(len(words))[:9_000]
    assert (collocations.hashes("en", pa.array([b"x", *(words[i] for i in some)], pa.binary())[1:]) == own[some]).all()
    assert len(collocations.hashes("en", pa.array([], pa.binary()))) == 0


@pytest.mark.parametrize("most", [3, 1 << 40, (1 << 63) - 1])
def test_distinct_numbers_in_one_sort(most):
    key = np.random.default_rng(7).integers(0, most, 5_000, endpoint=True)
    key[1000:2000] = key[:1000]
    key[7] = most
    _, first, of, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    assert all((a == b).all() for a, b in zip(collocations.distinct(key), (first, of, count)))
    assert [len(x) for x in collocations.distinct(key[:0])] == [0, 0, 0]
