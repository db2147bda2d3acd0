import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hyperloom.llm import packing


def truth():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, texts):
    """Every id in exactly one piece, sequences gapless, and ids those of the tokenizer."""
    encode = truth()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in texts.items():
        ids, at = encode(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            own = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, len(by_sequence)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    padding, n = check(packing.digests(packing.pack(docs)).collect(), texts)
    assert padding <= 0.01 * 2048 * n


def test_edges(docs, clashing):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "a", 5: "\x00 <|endoftext|> é漢"}
    rows = packing.digests(packing.pack(clashing(docs(list(texts.items()))))).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5}
    assert [r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack(docs([(1, "x")]).limit(0)).count() == 0
    twice = packing.pack(docs([(7, "same text"), (7, "same text"), (None, "x")])).collect()
    assert sum(r["length"] for r in twice if r["doc_id"] == 7) == 2 * len(truth()("same text")) and any(r["doc_id"] is None for r in twice)


def test_added_tokens_are_found_in_texts(docs):
    texts = {1: "a <|endoftext|> b", 2: "\x00 <|endoftext|> é漢", 3: "<|endoftext|><|endoftext|>\n", 4: "<|endoftext", 5: "x  <|endoftext|>  y", 6: None, 7: "", 8: "word " * 30_000}
    assert 50256 in truth()(texts[1])
    check(packing.digests(packing.pack(docs(list(texts.items())))).collect(), texts)


def test_solver_fills_windows():
    h = np.zeros(2048, np.int64)
    h[[1000, 1048, 500, 700, 848]] = [40, 40, 30, 30, 30]
    patterns, counts = packing.solve(h)
    assert (np.isin(patterns.sum(1), [2048])).all()
    used = np.zeros(2048, np.int64)
    for p, c in zip(patterns, counts):
        for x in p[p > 0]:
            used[x] += c
    assert (used <= h).all() and used.sum() >= 0.9 * h.sum()


def test_least_squares_is_non_negative_and_fits():
    rng = np.random.default_rng(0)
    h = np.zeros(2048, np.int64)
    h[rng.integers(1, 2048, 500)] = rng.integers(1, 50, 500)
    p = packing.combinations(h)
    x = packing.nnls(p, h)
    assert (x >= 0).all()
    gradient = np.zeros(len(p))
    fit = np.bincount(p.ravel(), np.where(p > 0, x[:, None], 0).ravel(), 2048) - h
    gradient = np.where(p > 0, fit[p], 0).sum(1)
    assert (gradient[x > 1e-6].__abs__() < 3).all() and gradient.min() > -3


def test_blocks_of_a_large_table_stay_whole():
    lengths = np.random.default_rng(1).integers(1, 9000, 700)
    sequences = packing.pack_block(lengths, *(lambda p, c: (p, c))(*packing.solve(np.bincount(lengths % 2048, minlength=2048) * (np.arange(2048) > 0))))
    seen = np.zeros(int(lengths.sum()), int)
    base = np.r_[0, np.cumsum(lengths)]
    for s in sequences:
        assert sum(n for _, _, n in s) <= 2048
        for row, start, n in s:
            assert start + n <= lengths[row]
            seen[base[row] + start : base[row] + start + n] += 1
    assert (seen == 1).all()
    assert all(t & (t - 1) == 0 for t in (sum(n for _, _, n in s) for s in sequences))


def test_runs_of_any_length(docs):
    """White space, letters and wide characters in runs around and far beyond the limit."""
    n = packing.LONG_RUN
    texts = {1: " " * 1_000_000, 2: "x" + "\n" * 5_000_000 + "y", 3: "a" * (n + 5), 4: "\u00a0 " * n, 5: "\u3000" * n, 6: "b" * (n - 1) + " c", 7: "<|endoftext|>" + " " * (n + 1) + "<|endoftext|>", 8: "plain text"}
    rows = packing.digests(packing.pack(docs(list(texts.items())))).collect()
    check(rows, texts)
    import pyarrow as pa

    assert packing.long_runs(pa.array([texts[i] for i in range(1, 9)])) == [0, 1, 2, 3, 4, 6]
    assert packing.long_runs(pa.array(["a " * n, None, ""])) == []


def test_random_strings_have_the_tokenizers_ids():
    rng = np.random.default_rng(5)
    alphabet = list("ab CD\n\t'09.,!?-é漢\u00a0\u3000\u200d😀") + ["'s", "'ll", "<|endoftext|>", "  ", "\r\n", "ﬁ", "İ"]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(4000)]
    encode, fast = truth(), packing._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert all(fast.encode(t, allowed_special="all") + [1] == encode(t) for t in texts)


def test_patterns_keep_documents_whole():
    """What the least-squares patterns are for: far fewer documents' remainders are cut than by the greedy packing alone, in as many sequences."""
    lengths = np.random.default_rng(7).lognormal(6.2, 1.1, 6000).astype(int) + 1
    histogram = np.bincount(lengths % 2048, minlength=2048) * (np.arange(2048) > 0)
    patterns, counts = packing.solve(histogram)
    order = np.argsort(-counts, kind="stable")

    def cut(sequences):
        pieces = {}
        for s in sequences:
            for row, _, n in s:
                pieces[row] = pieces.get(row, 0) + (n < 2048)
        return sum(n > 1 for n in pieces.values())

    some, none = packing.pack_block(lengths, patterns[order], counts[order]), packing.pack_block(lengths, patterns[:0], counts[:0])
    assert (counts[:, None] * (patterns > 0)).sum() > 0.3 * histogram.sum()
    assert cut(some) < 0.7 * cut(none) and len(some) <= len(none) + 11
