"""Benchmark decontamination by BM25 with block-max WAND.

The benchmark's items are the indexed side: their document frequencies and impacts are computed in Spark, and the
index goes to the tasks in blocks of at most ``ITEMS_PER_INDEX`` items. Every training document is cut into
overlapping passages; each passage is a query against the index, and all items whose score is at least ``LEAST_SCORE`` of what the item's own
text would score are retrieved. Hits are verified on whole texts: the share of the item's question and of its answer (its last sentence)
whose five-word shingles the document holds.

Blocks hold parts of like length. For a whole batch of passages at once, the sums over their distinct words of each word's largest impact in a
block bound what any item of the block can score; WAND runs for the passages for which some block is left, over its cursors' finer blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free, slices, stored

K1, B = 1.2, 0.75
#: A passage is two half-passages of so many words; each half but the first and last is in two passages.
HALF = 64
#: Longer items are indexed in parts of at most so many words, each with hits of its own.
PART = 64
ITEMS_PER_INDEX = 10_000
#: Blocks of parts, whose bounds are summed for every passage: so many, or so many parts each if that makes more.
PART_BLOCKS, BLOCK_PARTS = 64, 64
POSTINGS_PER_BLOCK = 16
LEAST_SCORE = 0.6
LEAST_OVERLAP = 0.5
SHINGLE = 5

WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words up to its last sentence, and those of its last sentence; an item of one sentence is all question."""
    sentences = [w for w in (words(s) for s in re.split(r"(?<=[.?!])\s+|\n+", text or "")) if w]
    if len(sentences) < 2:
        return (sentences[0] if sentences else []), []
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def parts(text: str | None) -> list[list[str]]:
    w = words(text)
    n = max(1, math.ceil(len(w) / PART))
    size = math.ceil(len(w) / n) if w else 0
    return [w[i : i + size] for i in range(0, len(w), size)] if w else []


@dataclass
class Index:
    """Postings of an index block: parts in ascending number, with impacts relative to the part's own score, in blocks with their maxima."""

    term: dict[str, int]
    postings: list[np.ndarray]
    impacts: list[np.ndarray]
    block_last: list[np.ndarray]
    block_max: list[np.ndarray]
    upper: np.ndarray
    #: Largest impact of each term in each block of parts.
    part_blocks: np.ndarray
    block_size: int
    #: Each part's row in ``rows``.
    item: list[int]
    rows: list[tuple[int, str]]


def build(rows: list[tuple[int, str]], frequency: dict[str, int], n_parts: int, mean_length: float) -> Index:
    term: dict[str, int] = {}
    lists: list[list[tuple[int, float]]] = []
    item: list[int] = []
    for row, part in sorted(((k, p) for k, (_, t) in enumerate(rows) for p in parts(t)), key=lambda x: len(x[1])):
        counts: dict[str, int] = {}
        for w in part:
            counts[w] = counts.get(w, 0) + 1
        weight = {}
        for w, c in counts.items():
            idf = math.log(1 + (n_parts - frequency[w] + 0.5) / (frequency[w] + 0.5))
            weight[w] = idf * c * (K1 + 1) / (c + K1 * (1 - B + B * len(part) / mean_length))
        own = sum(weight.values())
        for w, x in weight.items():
            t = term.setdefault(w, len(term))
            if t == len(lists):
                lists.append([])
            lists[t].append((len(item), x / own))
        item.append(row)
    postings = [np.array([p for p, _ in x], np.int64) for x in lists]
    impacts = [np.array([i for _, i in x]) for x in lists]
    size = max(1, min(BLOCK_PARTS, -(-len(item) // PART_BLOCKS)))
    part_blocks = np.zeros((len(lists), -(-len(item) // size)), np.float32)
    for t, (p, i) in enumerate(zip(postings, impacts)):
        np.maximum.at(part_blocks[t], p // size, i.astype(np.float32))
    cuts = [np.arange(0, len(x), POSTINGS_PER_BLOCK) for x in lists]
    return Index(
        term, postings, impacts,
        [p[np.minimum(c + POSTINGS_PER_BLOCK, len(p)) - 1] for p, c in zip(postings, cuts)],
        [np.maximum.reduceat(i, c) for i, c in zip(impacts, cuts)],
        np.array([i.max() for i in impacts] or [0.0]),
        part_blocks, size, item, rows,
    )


class Cursor:
    """A place in one term's postings."""

    __slots__ = ("postings", "impacts", "last", "most", "upper", "at", "part")

    def __init__(self, index: Index, term: int):
        self.postings, self.impacts = index.postings[term], index.impacts[term]
        self.last, self.most, self.upper = index.block_last[term], index.block_max[term], index.upper[term]
        self.at, self.part = 0, int(self.postings[0])

    def seek(self, part: int) -> None:
        self.at += int(np.searchsorted(self.postings[self.at :], part))
        self.part = int(self.postings[self.at]) if self.at < len(self.postings) else 1 << 62

    def block(self, part: int) -> tuple[float, int]:
        """Largest impact and last part of the block that would hold ``part``."""
        k = int(np.searchsorted(self.last, part))
        return (float(self.most[k]), int(self.last[k])) if k < len(self.last) else (0.0, 1 << 62)


def wand(index: Index, terms: list[int], least: float, first: int = 0, stop: int = 1 << 62) -> list[tuple[int, float]]:
    """All parts from ``first`` to before ``stop`` whose score over the distinct ``terms`` is ``least`` or more, by block-max WAND."""
    cursors = [Cursor(index, t) for t in terms]
    if first:
        for c in cursors:
            c.seek(first)
    found = []
    least -= 1e-9
    while True:
        cursors = sorted((c for c in cursors if c.part < stop), key=lambda c: c.part)
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c.upper
            if bound >= least:
                pivot = i
                break
        if pivot < 0:
            return found
        part = cursors[pivot].part
        while pivot + 1 < len(cursors) and cursors[pivot + 1].part == part:
            pivot += 1
        blocks = [c.block(part) for c in cursors[: pivot + 1]]
        if sum(m for m, _ in blocks) < least:
            # no part up to the nearest block end can reach the threshold with these terms alone
            after = min(e for _, e in blocks) + 1
            if pivot + 1 < len(cursors):
                after = min(after, cursors[pivot + 1].part)
            for c in cursors[: pivot + 1]:
                c.seek(max(after, part + 1) if after > part else part + 1)
        elif cursors[0].part == part:
            score = sum(float(c.impacts[c.at]) for c in cursors[: pivot + 1])
            if score >= least:
                found.append((part, score))
            for c in cursors[: pivot + 1]:
                c.seek(part + 1)
        else:
            for c in cursors[:pivot]:
                if c.part < part:
                    c.seek(part)


def passages(index: Index, found: list[list[str]]) -> Iterator[tuple[int, list[int], int, int]]:
    """(document, distinct terms, first part, stop) of the passages and blocks of parts whose bounds allow a hit."""
    get = index.term.get
    sizes = np.array([len(w) for w in found])
    ids = np.fromiter((get(w, -1) for d in found for w in d), np.int64, int(sizes.sum()))
    # passage k of a document holds its words from k * HALF on, 2 * HALF of them at most
    n_passages = np.maximum(1, -(-sizes // HALF) - 1)
    first = np.r_[0, np.cumsum(n_passages)]
    known = np.flatnonzero(ids >= 0)
    document = np.repeat(np.arange(len(found)), sizes)[known]
    half = (known - (np.cumsum(sizes) - sizes)[document]) // HALF
    n_terms = len(index.term)
    both = [first[document] + p for p in (half, half - 1)]
    inside = [both[0] < first[document + 1], half > 0]
    pairs = np.concatenate([p[ok] * n_terms + ids[known][ok] for p, ok in zip(both, inside)])
    pairs = np.unique(pairs.astype(np.int32) if first[-1] * n_terms < 1 << 31 else pairs)
    if not len(pairs):
        return
    of, term = pairs // n_terms, pairs % n_terms
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    bound = np.add.reduceat(index.part_blocks[term], starts, axis=0)
    ends = np.r_[starts[1:], len(of)]
    owner = np.repeat(np.arange(len(found)), n_passages)
    for k, block in zip(*(x.tolist() for x in np.nonzero(bound >= LEAST_SCORE - 1e-4))):
        yield int(owner[of[starts[k]]]), term[starts[k] : ends[k]].tolist(), block * index.block_size, (block + 1) * index.block_size


def overlap(wanted: list[str], have: set[tuple[str, ...]], sequence: str) -> float:
    """Share of ``wanted``'s distinct shingles that a document has; a shorter one counts whole, if it stands in the document."""
    if not wanted:
        return 1.0
    if len(wanted) < SHINGLE:
        return float(f" {' '.join(wanted)} " in sequence)
    own = {tuple(wanted[i : i + SHINGLE]) for i in range(len(wanted) - SHINGLE + 1)}
    return len(own & have) / len(own)


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def hits(docs: DataFrame, benchmark: DataFrame, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """One row for each document and benchmark item that it leaks: best passage score, and overlaps of question and answer.

    Null and empty texts on either side match nothing, nor do items without an id. Repeated rows of a document are reported as often as they occur; different
    texts of one item_id are searched and verified one by one, and the one of the best score is reported. Other columns are ignored; an empty table gives no rows. The corpus is read once for
    each ``ITEMS_PER_INDEX`` items, so that a broadcast index has a bound.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    tokens = rows.mapInArrow(_part_terms, "part long, size int, terms array<string>")
    n_parts, mean_length = tokens.agg(F.count("*"), F.avg("size")).first()
    out = None
    if n_parts:
        frequency = stored(tokens.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "benchmark-terms")
        n_items = rows.count()
        n_blocks = -(-n_items // ITEMS_PER_INDEX)
        for k in range(n_blocks):
            block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
            used = block.mapInArrow(_part_terms, "part long, size int, terms array<string>").select(F.explode("terms").alias("term")).distinct()
            index = build(sorted(tuple(r) for r in block.collect()), {r["term"]: r["n"] for r in frequency.join(used, "term").collect()}, n_parts, mean_length)
            some = _search(docs, index, least_overlap)
            out = some if out is None else out.union(some)
    return out if out is not None else spark.createDataFrame([], HITS)


def _part_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [p for t in batch.column("text").to_pylist() for p in parts(t)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), pa.array([len(p) for p in found], pa.int32()), pa.array([sorted(set(p)) for p in found], pa.list_(pa.string()))], names=["part", "size", "terms"])


def _search(docs: DataFrame, index: Index, least_overlap: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        wanted = [question_and_answer(t) for _, t in own.rows]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = [words(t) for t in part.column("text").to_pylist()]
                scores: dict[tuple[int, int], float] = {}
                for d, terms, first, stop in passages(own, found):
                    for p, s in wand(own, terms, LEAST_SCORE, first, stop):
                        key = d, own.item[p]
                        scores[key] = max(s, scores.get(key, 0.0))
                found_hits: dict[tuple[int, int], tuple[float, float, float]] = {}
                shingles: tuple[int, set, str] | None = None
                for (d, i), s in sorted(scores.items()):
                    if shingles is None or shingles[0] != d:
                        shingles = d, {tuple(found[d][k : k + SHINGLE]) for k in range(len(found[d]) - SHINGLE + 1)}, f" {' '.join(found[d])} "
                    q, a = (overlap(w, *shingles[1:]) for w in wanted[i])
                    if q >= least_overlap and a >= least_overlap:
                        key = d, own.rows[i][0]
                        found_hits[key] = max((s, q, a), found_hits.get(key, (0.0, 0.0, 0.0)))
                columns = list(zip(*((*k, *v) for k, v in found_hits.items()))) if found_hits else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with their columns as they are.

    Rows of a null doc_id and null or empty texts stay; rows that repeat a doc_id go together. Further columns of any name stay; an empty table gives no rows.
    """
    (name,) = free(docs, "leaky")
    leaky = hits(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaky, F.col("doc_id").cast("long") == F.col(name), "left_anti")
