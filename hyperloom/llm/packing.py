"""Sequence packing by non-negative least squares over length combinations.

Documents are tokenised once. Every full window of 2048 ids is a sequence of its own; what is left of each document (its
remainder, 1 to 2047 ids) is packed. Shallow combinations of remainder lengths that fill a window exactly, or nearly so, are
enumerated; their repeat counts are solved by non-negative least squares against the histogram of remainder lengths over the
whole input, and rounded down. The counts then guide every block of documents; what they leave is packed greedily,
largest first, cutting a piece where the window ends.

Sizes: the histogram has 2047 entries and the solution a few thousand patterns, whatever the input. Tokenised documents
go once to the shared folder; there is no shuffle of texts or ids. A block holds ``BLOCK_IDS`` ids at most plus one document.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, stored, utf8_parts

WINDOW = 2048
END_ID = 1
BLOCK_IDS = 2_000_000

PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def _encoding(path: str):
    """The vocabulary at ``path`` (ranks of byte strings), as an encoder of whole texts that knows the added tokens of the tokenizer file beside it, if there is one."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    whole, added = os.path.splitext(path)[0] + ".json", {}
    if os.path.exists(whole):
        with open(whole, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


#: Texts with a longer run of bytes without ASCII white space, or of white space and bytes beyond ASCII alone, are left to the tokenizer itself.
LONG_RUN = 1 << 17
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ASCII_SOLID = ~_ASCII_SPACE
_ASCII_SOLID[128:] = False


def long_runs(column: pa.Array) -> list[int]:
    """Rows whose texts have a run of ``LONG_RUN`` bytes: the faster encoder's pattern fails on white space of about a million characters."""
    raw, offsets = utf8_parts(column)
    out = []
    for row in np.flatnonzero(np.diff(offsets) >= LONG_RUN).tolist():
        own = raw[offsets[row] : offsets[row + 1]]
        if any(np.diff(np.r_[-1, np.flatnonzero(kind[own]), len(own)]).max() > LONG_RUN for kind in (_ASCII_SPACE, _ASCII_SOLID)):
            out.append(row)
    return out


def tokenise(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: each text's ids, then ``end_id``, as little-endian 32-bit words. Null texts count as empty.

    Ids are those of ``tokenizers`` with ``byte_bpe_50k.json``. Its ranks file and added tokens go through a faster encoder of the same ids, but for texts with very
    long runs, which go through ``tokenizers``; tests hold the one against the other. ``vocabulary`` is the path of another ranks file, with its tokenizer file beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        encoder, whole = _encoding(path), None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                slow = long_runs(part.column("text"))
                if slow and whole is None:
                    from tokenizers import Tokenizer

                    whole = Tokenizer.from_file(os.path.splitext(path)[0] + ".json")
                aside = {row: whole.encode(texts[row], add_special_tokens=False).ids for row in slow}
                ids = [aside[row] if row in aside else encoder.encode(t or "", allowed_special="all") for row, t in enumerate(texts)]
                for x in ids:
                    x.append(end_id)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def combinations(histogram: np.ndarray, window: int = WINDOW, triples_per_length: int = 3) -> np.ndarray:
    """Patterns of two or three remainder lengths with a count that sum to the window; zero stands for no third length."""
    present = np.flatnonzero(histogram[:window])
    present = present[present > 0]
    if not len(present):
        return np.zeros((0, 3), np.int64)
    here = np.zeros(window + 1, bool)
    here[present] = True
    small = present[present <= window // 2]
    pairs = small[here[window - small]]
    found = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    # for each longest length, the triples whose smaller parts are the most frequent
    for a in present[present >= window // 3]:
        b = present[(present <= a) & (present < window - a)]
        c = window - a - b
        b, c = b[(c >= 1) & (c <= b)], c[(c >= 1) & (c <= b)]
        ok = here[c]
        b, c = b[ok], c[ok]
        best = np.argsort(-np.minimum(histogram[b], histogram[c]), kind="stable")[:triples_per_length]
        found.append(np.stack([np.full(len(best), a), b[best], c[best]], 1))
    return np.unique(np.sort(np.concatenate(found), 1)[:, ::-1], axis=0)


def nnls(patterns: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that makes the lengths used by ``patterns`` meet the histogram in least squares (accelerated projected gradient)."""
    if not len(patterns):
        return np.zeros(0)
    target = histogram.astype(float).copy()
    target[0] = 0.0
    n = len(target)
    used = patterns > 0

    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), np.where(used, x[:, None], 0.0).ravel(), n)

    def gradient(x: np.ndarray) -> np.ndarray:
        r = product(x) - target
        return np.where(used, r[patterns], 0.0).sum(1)

    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue, for the step
        w = np.where(used, product(v)[patterns], 0.0).sum(1)
        norm = np.linalg.norm(w)
        v = w / max(norm, 1e-12)
    step = 1.0 / max(norm, 1e-12)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0.0, y - step * gradient(y))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / t2 * (z - x)
        x, t = z, t2
    return x


def solve(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole repeat counts: rounded down, then cut back where rounding still asks for more than there is."""
    patterns = combinations(histogram)
    x = nnls(patterns, histogram)
    counts = np.floor(x + 1e-6).astype(np.int64)
    keep = x > 1e-3 * max(1.0, x.max(initial=0.0))
    patterns, counts, x = patterns[keep], counts[keep], x[keep]
    left = histogram.astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        counts[k] = min(counts[k], (left[lengths] // times).min())
        left[lengths] -= counts[k] * times
    return patterns, counts


def pack_block(lengths: np.ndarray, patterns: np.ndarray, share: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Sequences of (row, start, length) of a block's documents; each id is in one piece, and all but the last few are full.

    ``share``: how often each pattern is due in this block.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    queues: dict[int, list[int]] = {}
    for row, n in enumerate(lengths.tolist()):
        for s in range(0, n - WINDOW + 1, WINDOW):
            sequences.append([(row, s, WINDOW)])
        if n % WINDOW:
            queues.setdefault(n % WINDOW, []).append(row)
    start_of = lengths - lengths % WINDOW

    for pattern, due in zip(patterns.tolist(), share.tolist()):
        parts = [x for x in pattern if x]
        for _ in range(due):
            if any(len(queues.get(x, ())) < parts.count(x) for x in parts):
                break
            sequences.append([(row, int(start_of[row]), x) for x in parts for row in [queues[x].pop()]])
    # what the patterns leave: largest first; the piece that passes the window's end is cut there
    current: list[tuple[int, int, int]] = []
    room = WINDOW
    for n in sorted(queues, reverse=True):
        for row in queues[n]:
            start, left = int(start_of[row]), n
            while left:
                take = min(left, room)
                current.append((row, start, take))
                start, left, room = start + take, left - take, room - take
                if not room:
                    sequences.append(current)
                    current, room = [], WINDOW
    # the last one is cut into powers of two, which need no padding
    rest = WINDOW - room
    while rest:
        size = 1 << (rest.bit_length() - 1)
        rest -= size
        out, left = [], size
        while left:
            row, start, n = current[0]
            take = min(left, n)
            out.append((row, start, take))
            left -= take
            current[0] = (row, start + take, n - take)
            if take == n:
                current.pop(0)
        sequences.append(out)
    return sequences


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 ids.

    Result: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``, one row a piece; pieces of one sequence are gapless
    from offset 0. Null and empty texts are documents of one id (1). Repeated rows are packed as often as they occur; a null
    doc_id stays null. Columns beyond doc_id and text are ignored. An empty table gives no rows.
    """
    return pack_ids(stored(tokenise(docs, vocabulary), "packing-ids"))


def pack_ids(tokens: DataFrame) -> DataFrame:
    """``tokens``: stored rows of doc_id and ids."""
    rest = ((F.length("ids") / 4).cast("int") % WINDOW).alias("rest")
    histogram = np.zeros(WINDOW, np.int64)
    for rest_length, n in tokens.groupBy(rest).count().collect():  # 2048 rows at most
        histogram[rest_length] = n
    patterns, counts = solve(histogram)
    order = np.argsort(-counts, kind="stable")
    patterns, counts = patterns[order], counts[order]
    total = int(histogram.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0
        held: list[pa.RecordBatch] = []
        n_ids = 0
        for batch in batches:
            at = 0
            for i, size in enumerate((pc.binary_length(batch.column("ids")).to_numpy() // 4).tolist()):
                n_ids += size
                if n_ids >= BLOCK_IDS:
                    held.append(batch.slice(at, i + 1 - at))
                    at = i + 1
                    first, out = emit(held, first)
                    yield from out
                    held, n_ids = [], 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            _, out = emit(held, first)
            yield from out

    def emit(held: list[pa.RecordBatch], first: int) -> tuple[int, Iterator[pa.RecordBatch]]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("ids").to_pylist()
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        offsets = np.r_[0, np.cumsum(lengths)]
        flat = np.frombuffer(b"".join(ids), "<u4")
        share = np.ceil(counts * (len(lengths) / max(1, total))).astype(np.int64)
        sequences = pack_block(lengths, patterns, share)
        doc_ids = table.column("doc_id").combine_chunks()
        return first + len(sequences), rows(sequences, doc_ids, offsets, flat, lengths, first)

    def rows(sequences, doc_ids, offsets, flat, lengths, first) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(sequences), 256):
            some = sequences[lo : lo + 256]
            row, start, n = (np.array([p[k] for s in some for p in s], np.int64) for k in range(3))
            sequence = np.repeat(np.arange(first + lo, first + lo + len(some)), [len(s) for s in some])
            end = np.cumsum(n)
            new = np.r_[True, sequence[1:] != sequence[:-1]]
            offset = end - n - np.maximum.accumulate(np.where(new, end - n, 0))
            values = np.concatenate([flat[a : a + k] for a, k in zip((offsets[row] + start).tolist(), n.tolist())])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), pa.array(start), pa.array(n), ids, pa.array(lengths[row]), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return tokens.mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` (unsigned crc32 of the ids as little-endian unsigned 32-bit words) in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            ids = batch.column("ids")
            offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length")), pa.array(crc, pa.int64()), *(batch.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
