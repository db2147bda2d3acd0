"""Sequence packing by best-two-fit: documents stay whole wherever they fit.

Only documents of more than ``WINDOW`` ids are cut, into pieces of ``WINDOW`` ids of which the first may be shorter; a full piece is a sequence
of its own. All other pieces are packed whole. A sequence is filled greedily with the largest unpacked piece that still fits. When none does and
room is left, its smallest piece is replaced by those two unpacked pieces that fill the room and the smallest one's place most tightly, if any two fill
more than it does. Pieces of under a sixth of a sequence take no part in exchanges: they are worth more later, where they fill what is left by themselves.

Documents are tokenised once, to the shared folder; there is no shuffle. A task packs blocks of ``BLOCK_IDS`` ids (and one document more at most); pieces of
a size are interchangeable, so a block's state is one stack of rows for each of at most ``WINDOW`` sizes. What a block's last sequences leave
open is all that packing the whole table at once could save: about one sequence in ``BLOCK_IDS / WINDOW``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import stored
from .packing import tokenise

WINDOW = 1024
END_ID = 2
BLOCK_IDS = 4_000_000

PIECES = "doc_id long, piece int, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


class Sizes:
    """How many unpacked pieces there are of each size; the largest that fits a room is found in a bit set."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        self.bits = sum(1 << size for size, n in enumerate(self.counts) if n and size)

    def largest(self, room: int) -> int:
        """The largest size of at most ``room``, or 0."""
        return (self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.bits & ((1 << (room + 1)) - 1) else 0

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.bits ^= 1 << size

    def give(self, size: int) -> None:
        if not self.counts[size]:
            self.bits |= 1 << size
        self.counts[size] += 1

    def two(self, room: int, more_than: int, least: int = 1) -> tuple[int, int]:
        """The two unpacked pieces of ``least`` or more with the largest sum of at most ``room``, if it is over ``more_than``; else (0, 0). Equal sums: the larger first piece."""
        found, best = (0, 0), more_than
        a = self.largest(room - 1)
        while a >= least and 2 * a > best:
            b = self.largest(min(room - a, a))
            if b == a and self.counts[a] < 2:
                b = self.largest(a - 1)
            if b >= least and a + b > best:
                found, best = (a, b), a + b
                if best == room:
                    break
            a = self.largest(a - 1)
        return found


def fill(counts: np.ndarray, window: int = WINDOW, replace: bool = True) -> list[list[int]]:
    """Sequences, as the sizes of their pieces, that hold ``counts[size]`` pieces of each size.

    ``replace=False`` leaves the exchange of the smallest piece out: the greedy packing alone.
    """
    left, out = Sizes(counts), []
    while left.bits:
        sequence, room = [], window
        while size := left.largest(room):
            left.take(size)
            sequence.append(size)
            room -= size
        if replace and room and len(sequence) > 1:
            smallest = sequence[-1]
            a, b = left.two(room + smallest, smallest, max(1, window // 6))
            if a:
                left.take(a)
                left.take(b)
                left.give(smallest)
                sequence[-1:] = [a, b]
        out.append(sequence)
    return out


def pack_block(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (row, start, length) of a block's documents; the exchange is kept where it doesn't cost a sequence."""
    first = (lengths - 1) % window + 1
    rest = (lengths - first) // window
    out = [[(row, int(first[row]) + k * window, window)] for row in np.flatnonzero(rest).tolist() for k in range(int(rest[row]))]
    order = np.argsort(-first, kind="stable")
    stacks: dict[int, list[int]] = {}
    for row, size in zip(order[::-1].tolist(), first[order[::-1]].tolist()):
        stacks.setdefault(size, []).append(row)
    counts = np.bincount(first, minlength=window + 1)
    exchanged, greedy = fill(counts, window), fill(counts, window, replace=False)
    for sizes in exchanged if len(exchanged) <= len(greedy) else greedy:
        out.append([(stacks[size].pop(), 0, size) for size in sizes])
    return out


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All documents as pieces of sequences of at most ``WINDOW`` ids.

    Result: ``doc_id, piece, start, length, ids, doc_tokens, sequence_id, offset``, one row a piece; pieces of one sequence are gapless from
    offset 0 and stand together. Null and empty texts are documents of one id (2). Repeated rows are packed as often as they occur; a null doc_id
    stays null; equal sizes are packed in the table's order. Columns beyond doc_id and text are ignored. An empty table gives no rows.
    """
    return pack_ids(stored(tokenise(docs, vocabulary, END_ID), "bestfit-ids"))


def pack_ids(tokens: DataFrame) -> DataFrame:
    """``tokens``: stored rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []
        n_ids = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False) // 4
            at = 0
            for i, size in enumerate(sizes.tolist()):
                n_ids += size
                if n_ids >= BLOCK_IDS:
                    held.append(batch.slice(at, i + 1 - at))
                    sequences, rows = emit(held, first)
                    first += sequences
                    yield from rows
                    held, n_ids, at = [], 0, i + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield from emit(held, first)[1]

    def emit(held: list[pa.RecordBatch], first: int) -> tuple[int, Iterator[pa.RecordBatch]]:
        table = pa.Table.from_batches(held)
        ids = table.column("ids").to_pylist()
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        sequences = pack_block(lengths)
        return len(sequences), pieces(sequences, table.column("doc_id").combine_chunks(), ids, lengths, first)

    return tokens.mapInArrow(run, PIECES)


def pieces(sequences: list, doc_ids: pa.Array, ids: list[bytes], lengths: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(sequences), 256):
        some = sequences[lo : lo + 256]
        row, start, n = (np.array([p[k] for s in some for p in s], np.int64) for k in range(3))
        sequence = np.repeat(np.arange(first + lo, first + lo + len(some)), [len(s) for s in some])
        end = np.cumsum(n)
        before = end - n
        offset = before - before[np.searchsorted(sequence, sequence)]
        raw = b"".join(ids[r][4 * a : 4 * (a + k)] for r, a, k in zip(row.tolist(), start.tolist(), n.tolist()))
        values = pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array(np.frombuffer(raw, "<i4")))
        piece = np.where(start == 0, 0, -(-start // WINDOW)).astype(np.int32)
        columns = [doc_ids.take(pa.array(row)), pa.array(piece), pa.array(start), pa.array(n), values, pa.array(lengths[row]), pa.array(sequence), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def digests(packed: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` (unsigned crc32 of the ids as little-endian unsigned 32-bit words) in place of ids."""
    names = packed.columns
    schema = T.StructType([T.StructField("ids_crc32", T.LongType()) if f.name == "ids" else f for f in packed.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(names.index("ids"))
            offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
            crc = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays([crc if c == "ids" else batch.column(k) for k, c in enumerate(names)], names=schema.names)

    return packed.mapInArrow(run, schema)
