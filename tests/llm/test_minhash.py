import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hyperloom.llm import minhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.groups(df).collect()}


def corpus(seed, families=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out, k = [], 0
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 8, 12, 40, 200]))]
        for _ in range(rng.choice([1, 2, 4, 9])):
            copy = [w if rng.random() > 0.012 else rng.choice(vocabulary) for w in base]
            out.append((k, rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            k += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    assert got(docs(rows)) == brute(rows)


@pytest.mark.parametrize("small,block", [(64, 512), (4, 8)])
def test_chained_copies_in_large_buckets(docs, monkeypatch, small, block):
    """Copies that drift: neighbours are linked, far ones aren't, and many share buckets without being linked."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "OPEN_BLOCK", block)
    monkeypatch.setattr(minhash, "GROUP", 8)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    rows, now = [], list(base)
    for i in range(45):
        rows.append((i, " ".join(now)))
        now[rng.randrange(150)] = f"n{i}"
    rows += [(100 + i, " ".join(w if rng.random() > 0.03 else f"z{i}{j}" for j, w in enumerate(base))) for i in range(45)]
    assert got(docs(rows)) == brute(rows)


def test_near_pair_in_a_crowd_of_unlike_leaders(docs):
    """The only near pair of the table; in all of its buckets an unlike document of a smaller id leads."""
    rng = random.Random(2)
    parts = [[f"p{i}w{j}" for j in range(60)] for i in range(12)]
    rows = [(i, " ".join(w for p in sorted(rng.sample(range(12), 5)) for w in parts[p]) + " " + " ".join(f"o{i}x{j}" for j in range(150))) for i in range(600)]
    one = [w for p in parts for w in p]
    changed = set(range(30, 720, 72))
    rows += [(1100, " ".join(one)), (1101, " ".join(f"z{k}" if k in changed else w for k, w in enumerate(one)))]
    want = brute(rows)
    assert [i for i, (_, _, kept) in want.items() if not kept] == [1101]
    assert got(docs(rows)) == want


def test_edges(docs, clashing):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, long), (8, long + " end"), (9, "Ä ö ü ß é"), (10, "ä ö ü ß é"), (11, "a\xa0b c d e f"), (12, "x\x00y z")]
    df = clashing(docs(rows))
    assert got(df) == brute(rows)
    assert minhash.groups(df.limit(0)).count() == 0
    out = minhash.groups(docs([(None, "one two"), (None, "one two"), (4, "one two"), (4, "one two")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in out) == [(-1, -1, True), (-1, -1, True), (4, 4, True), (4, 4, True)]
    kept = minhash.dedup(clashing(docs([(1, "a b c"), (2, "a b c"), (None, "a b c")])))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1] and kept.columns == df.columns


def test_estimates_are_corrected():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.85):
        a = rng.integers(0, 2**63, 4000).astype(np.uint64)
        b = np.r_[a[: int(4000 * share)], rng.integers(0, 2**63, 4000 - int(4000 * share)).astype(np.uint64)]
        r = minhash.registers(np.r_[a, b], np.array([4000, 4000]))
        e = minhash.estimate(r[:1], r[1:], np.array([4000]), np.array([4000]))[0]
        true = share / (2 - share)
        assert abs(e - true) < 0.2


def test_registers_hold_zeros_and_mantissa():
    h = np.array([12345678901234567], np.uint64)
    r = minhash.registers(h, np.array([1]))[0]
    for k in range(4):
        with np.errstate(over="ignore"):
            v = int(h[0] * minhash._HASHES[k]) | 1
        zeros = 64 - v.bit_length()
        assert r[k] >> 10 == zeros and r[k] & 1023 == ((v << (zeros + 1)) & (2**64 - 1)) >> 54


def test_hashes_ignore_where_a_text_stands():
    texts = pa.array(["a b c d e f", None, "", "x y", "A b C d e f"])
    hashes, counts = minhash.shingles(texts)
    assert counts.tolist() == [2, 0, 0, 1, 2] and hashes[:2].tolist() == hashes[-2:].tolist()


def test_rows_that_repeat_a_document(docs, clashing):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (2, "other words"), (3, None), (3, None), (3, "k"), (5, "x y z"), (None, "q"), (None, "q"), (6, "six")]
    df = clashing(docs(rows)).withColumnRenamed("a", "gone")
    kept = minhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, "a b c d e f"), (2, "other words"), (3, None), (6, "six"), (None, "q"), (None, "q")], key=repr)
