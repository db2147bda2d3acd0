"""Line dedup by a tree of log templates.

Lines are parsed at a fixed depth: a leaf of the tree holds the lines of one token count and the same three leading tokens, fields
with digits masked. Within a leaf, lines that agree at three quarters of all their other positions share a template, whose
remaining positions are its variable fields. A template that occurs in ``MIN_DOCS`` different documents recurs: all of its occurrences are
dropped but the first, that with the smallest doc_id. Copies of one text count as one document, and the copies of the first keep
the line like the first does, so copied documents are left for document dedup.

Lines of one or two tokens ("Yes.", a menu's entries) say too little by themselves: such a line recurs where it and the line after it, or the
one before it, stand in ``MIN_DOCS`` different documents. Tokens are divided by white space; in Chinese, Japanese, Thai and Lao text each character is one.

A passage, a line of ``PASSAGE_TOKENS`` or more, recurs from two documents on unless they are versions of each other, with half of the larger one's
lines and half of its tokens in common (lines that begin alike count, so that edited ones do); versions are left for document dedup too.

Equal lines are merged before anything meets in a leaf, by partial sums. A leaf of very many lines gets the same templates as it would in one group: its first lines are
parsed, all others are held against their leaders in parts, and what agrees with none is parsed in order within groups that share some positions,
with an index of the leaders. Lines that make up a thousandth of all rows, a thousand at most, are looked up in a broadcast table, so no shuffle gathers them.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .collocations import Filter
from .common import bounded_batches, free, hot_values, mix, powers, slices, split_join, stored, utf8_parts

#: Leading tokens of a leaf.
DEPTH = 3
MIN_DOCS = 4
SIMILAR = 0.75
#: Lines of fewer tokens can't agree at ``SIMILAR`` of their positions unless they are equal.
LEAST_COMPARED = DEPTH + math.ceil(1 / (1 - SIMILAR))
PASSAGE_TOKENS = 50
#: Share of lines and of tokens that versions of a document have in common.
VERSION_SHARE = 0.5
#: Lines that one group of a leaf compares.
LEAF_LINES = 2000

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_Q = 0xD6E8FEB86659FD93
_FIELD, _FORWARD, _BACKWARD = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019), np.uint64(0x9FB21C651E98DF25)
_random = np.random.default_rng(7)
_BYTE = _random.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: First bytes of U+3000 to U+9FFF: characters that stand for a token each.
_WIDE = np.zeros(256, bool)
_WIDE[0xE3:0xEA] = True


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each token of concatenated texts; tokens with an ASCII digit are one field."""
    n = len(raw)
    space = _SPACE[raw]
    wide = _WIDE[raw]
    wide[:-1] |= (raw[:-1] == 0xE0) & (raw[1:] >= 0xB8) & (raw[1:] <= 0xBB)
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    begins[inner] = ~space[inner]
    alone = np.flatnonzero(wide)
    begins[alone] = True
    after = alone[alone + 3 < n] + 3
    begins[after] = ~space[after]
    starts = np.flatnonzero(begins)
    stop = np.r_[space, True]
    stop[offsets] = True
    stop[starts] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(_P, n), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(_P_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
    digits = np.zeros(n + 1, np.int32)
    np.cumsum(_DIGIT[raw], out=digits[1:])
    hashes[digits[ends] > digits[starts]] = _FIELD
    return starts, ends, hashes


def parse(column: pa.Array) -> list[pa.Array | np.ndarray]:
    """Row, line number, token count, hash of the leading tokens, hash of the line, and four bytes for each compared token, of every line that has tokens.

    A line of one or two tokens gives a row for each neighbour in its text, with the hash of both lines.
    """
    raw, offsets = utf8_parts(column)
    starts, _, h = tokens(raw, offsets)
    row = np.searchsorted(offsets[:-1], starts, side="right") - 1
    newlines = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=newlines[1:])
    number = newlines[starts] - newlines[offsets[row]]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[1:] != number[:-1])]) if len(starts) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(starts)])
    place = np.arange(len(starts)) - np.repeat(first, n)
    row, number = row[first], number[first]
    with np.errstate(over="ignore"):
        weighted = h * powers(_Q, int(n.max(initial=0)) + 1)[place]
        line = mix(np.add.reduceat(weighted, first) + n.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
        head = np.zeros(len(first), np.uint64)
        for k in range(DEPTH):
            has = n > k
            head[has] += weighted[first[has] + k]
        head = mix(head + np.uint64(DEPTH))
        full = n >= DEPTH
        compared = (place >= DEPTH) & np.repeat(n >= LEAST_COMPARED, n)
        ends = np.r_[0, np.cumsum(np.where(n >= LEAST_COMPARED, n - DEPTH, 0)[full]) * 4].astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), int(full.sum()), [None, pa.py_buffer(ends), pa.py_buffer((h[compared] & np.uint64(0xFFFFFFFF)).astype("<u4"))])
        # lines of one or two tokens, with the line after and the line before
        a = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
        both = line[a] * np.uint64(3) + line[a + 1]
        fore, back = n[a] < DEPTH, n[a + 1] < DEPTH
        short = np.r_[a[fore], a[back] + 1]
        pair = np.r_[mix(both[fore] ^ _FORWARD), mix(both[back] ^ _BACKWARD)]
    every = np.r_[np.flatnonzero(full), short]
    empty = pa.array([b""] * len(short), pa.binary())
    return [row[every], number[every].astype(np.int32), n[every].astype(np.int32), np.r_[head[full], pair].view(np.int64), np.r_[line[full], pair].view(np.int64), pa.concat_arrays([values, empty])]


def parsed(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, line_no, size, head, line, compared`` of every line that is looked at; ``copy`` is a hash of the whole text."""
    names = ["doc_id", "copy", "line_no", "size", "head", "line", "compared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, *columns = parse(part.column("text"))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("copy").take(at), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=names)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, copy long, line_no int, size int, head long, line long, compared binary")


def leaders(compared: np.ndarray) -> np.ndarray:
    """For each row, the row whose template it takes: rows in order, each joins the first leader that it agrees with."""
    n, width = compared.shape
    out = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        lead = left[0]
        same = (compared[left] == compared[lead]).mean(1) >= SIMILAR if width else np.ones(len(left), bool)
        same[0] = True
        out[left[same]] = lead
        left = left[~same]
    return out


def grouped(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``line, template, leaf, n, compared`` of lines clustered within the groups of ``keys``; a template is named by its leader's line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> pa.RecordBatch:
            compared = np.frombuffer(b"".join(r["compared"] for r in held), np.uint32).reshape(len(held), -1)
            lead = leaders(compared)
            return pa.RecordBatch.from_arrays(
                [pa.array([r["line"] for r in held], pa.int64()), pa.array([held[k]["line"] for k in lead.tolist()], pa.int64()), pa.array([r["leaf"] for r in held], pa.int64()), pa.array([r["n"] for r in held], pa.int64()), pa.array([r["compared"] for r in held], pa.binary())],
                names=["line", "template", "leaf", "n", "compared"],
            )

        at = None
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != at and held:
                    yield close()
                    held = []
                at = key
                held.append(r)
        if held:
            yield close()

    spread = lines.repartition(*keys).sortWithinPartitions(*keys, F.col("n").desc(), "line")
    return spread.select("line", "leaf", "n", "compared", *[k for k in keys if k != "leaf"]).mapInArrow(run, "line long, template long, leaf long, n long, compared binary")


class Leaders:
    """A leaf's leaders in order. Positions are dealt to so many sets that two lines which agree are equal in one of them."""

    def __init__(self, width: int) -> None:
        differ = width - math.ceil(SIMILAR * width)
        self.least = width - differ
        self.sets = [slice(k, None, differ + 1) for k in range(differ + 1)]
        self.lines = array("q")
        self.compared = np.zeros((64, width), np.uint32)
        self.index: dict[tuple[int, bytes], array] = {}

    def first(self, row: np.ndarray) -> int:
        """The first leader that ``row`` agrees with; -1 if there is none."""
        best = len(self.lines)
        for k, s in enumerate(self.sets):
            some = self.index.get((k, row[s].tobytes()), ())
            for at in range(0, len(some), 256):
                if some[at] >= best:
                    break
                piece = np.array(some[at : at + 256])
                hit = np.flatnonzero((self.compared[piece] == row).sum(1) >= self.least)
                if len(hit):
                    best = min(best, int(piece[hit[0]]))
                    break
        return best if best < len(self.lines) else -1

    def add(self, line: int, row: np.ndarray) -> None:
        n = len(self.lines)
        if n == len(self.compared):
            self.compared = np.concatenate([self.compared, np.zeros_like(self.compared)])
        self.compared[n] = row
        self.lines.append(line)
        for k, s in enumerate(self.sets):
            self.index.setdefault((k, row[s].tobytes()), array("i")).append(n)


def followed(lines: DataFrame, keys: list[str], grow: bool) -> DataFrame:
    """``line, template, leaf, n, compared, leads`` as from ``grouped``, row by row: only leaders are held.

    Rows with ``leads`` are leaders from the start. Others that agree with none become leaders if ``grow``, and have no template if not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for batch in batches:
            template = []
            for key, line, compared, leads in zip(zip(*(batch.column(k).to_pylist() for k in keys)), *(batch.column(c).to_pylist() for c in ("line", "compared", "leads"))):
                row = np.frombuffer(compared, np.uint32)
                if key != at:
                    at, known = key, Leaders(len(row))
                found = -1 if leads else known.first(row)
                if found < 0 and (leads or grow):
                    known.add(line, row)
                template.append(known.lines[found] if found >= 0 else line if leads or grow else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("line"), pa.array(template, pa.int64()), batch.column("leaf"), batch.column("n"), batch.column("compared"), batch.column("leads")],
                names=["line", "template", "leaf", "n", "compared", "leads"],
            )

    spread = lines.repartition(*keys).sortWithinPartitions(*keys, F.col("leads").desc(), F.col("n").desc(), "line")
    return spread.select("line", "leaf", "n", "compared", "leads", *[k for k in keys if k != "leaf"]).mapInArrow(run, "line long, template long, leaf long, n long, compared binary, leads boolean")


def by_text(rows: DataFrame) -> DataFrame:
    """``line, copy, size, head, doc_id, line_no, rows``: each different line of each different text, where it stands first, and in how many rows."""
    return rows.groupBy("line", "copy").agg(F.first("size").alias("size"), F.first("head").alias("head"), F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("rows")).select(
        "line", "copy", "size", "head", "at.doc_id", "at.line_no", "rows"
    )


def distinct_lines(texts: DataFrame) -> DataFrame:
    """``line, leaf, size, n, rows, first``: each different line, how many different texts and how many rows have it, and its first place."""
    lines = texts.groupBy("line").agg(F.first("size").alias("size"), F.first("head").alias("head"), F.count("*").alias("n"), F.sum("rows").alias("rows"), F.min(F.struct("doc_id", "line_no", "copy")).alias("first"))
    return lines.select("line", F.xxhash64("size", "head").alias("leaf"), "size", "n", "rows", "first")


def maybe_of(rows: DataFrame, found: DataFrame, column: str = "line") -> DataFrame:
    """The rows whose line (or other hash) is in the stored ``found`` and a few others: it is known to the tasks by one bit each, so that the others don't move."""
    known = rows.sparkSession.sparkContext.broadcast(Filter.of(found.select(F.col(column).alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.holds(batch.column(column).to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def crowded(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """``leaf, line, n, compared, lines`` of the lines that may share a template with another: of leaves of two lines or more that enough documents have."""
    lines = lines.where(F.col("size") >= LEAST_COMPARED).select("leaf", "line", "n")
    leaves = lines.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("lines")).where((F.col("docs") >= MIN_DOCS) & (F.col("lines") > 1))
    leaves = stored(leaves, "lines-leaves")
    found = stored(maybe_of(lines, leaves, "leaf").join(leaves, "leaf").select("leaf", "line", "n", "lines"), "lines-crowded")
    compared = maybe_of(rows.where(F.col("size") >= LEAST_COMPARED).select("line", "compared"), found).groupBy("line").agg(F.first("compared").alias("compared"))
    return found.join(compared, "line").select("leaf", "line", "n", "compared", "lines")


def sharing(lines: DataFrame) -> DataFrame:
    """``line, part`` of the lines that are equal to another of their leaf in one of the sets of positions: only lines of one part can agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, key = [], []
            for leaf, of, raw in zip(*(batch.column(c).to_pylist() for c in ("leaf", "line", "compared"))):
                row = np.frombuffer(raw, np.uint32)
                sets = Leaders(len(row)).sets
                line += [of] * len(sets)
                key += [int.from_bytes(blake2b(b"%d %d " % (leaf, k) + row[s].tobytes(), digest_size=8).digest(), "little", signed=True) for k, s in enumerate(sets)]
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(key, pa.int64())], names=["line", "key"])

    keys = lines.select("leaf", "line", "compared").mapInArrow(run, "line long, key long")
    least = keys.groupBy("key").agg(F.min("line").alias("least"), F.count("*").alias("n")).where("n > 1")
    links = keys.join(least, "key").select(F.col("line").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    return components(links).select(F.col("node").alias("line"), F.col("component").alias("part"))


def templates(lines: DataFrame) -> DataFrame:
    """``line, template`` of ``crowded`` lines."""
    small = grouped(lines.where(F.col("lines") <= LEAF_LINES), ["leaf"]).select("line", "template")
    large = stored(lines.where(F.col("lines") > LEAF_LINES).select("leaf", "line", "n", "compared", F.ceil(F.col("lines") / (8 * LEAF_LINES)).cast("int").alias("parts"), F.lit(False).alias("leads")), "lines-large")
    if large.isEmpty():
        return small
    # leaders among the first lines come before all others, so the rest can be held against them in parts
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.col("n").desc(), "line"))
    head = stored(followed(large.withColumn("place", place).where(F.col("place") <= LEAF_LINES), ["leaf"], True), "lines-heads")
    rest = large.join(head.select("line"), "line", "left_anti").withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    parts = large.select("leaf", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lead = head.where("line = template").withColumn("leads", F.lit(True)).join(parts, "leaf")
    columns = ["leaf", "line", "n", "compared", "leads", "part"]
    held = stored(followed(rest.select(columns).union(lead.select(columns)), ["leaf", "part"], False).where("not leads"), "lines-held")
    tail = held.where("template is null").drop("template")
    shared = stored(sharing(tail), "lines-shared")
    followers = followed(tail.join(shared, "line"), ["part"], True)
    others = tail.join(shared, "line", "left_anti").select("line", F.col("line").alias("template"))
    return reduce(DataFrame.union, [x.select("line", "template") for x in (small, head, held.where("template is not null"), followers, others)])


def recurring(texts: DataFrame, distinct: DataFrame, named: DataFrame, common: DataFrame) -> DataFrame:
    """``line, first_copy, first_line_no`` of the lines whose template occurs in ``MIN_DOCS`` different texts or more; ``named``: line, template.

    ``common``: hot lines of ``MIN_DOCS`` texts or more, which need no count of texts.
    """
    columns = ["line", F.col("first.copy").alias("first_copy"), F.col("first.line_no").alias("first_line_no")]
    alone = distinct.where(F.col("n") >= MIN_DOCS).join(named.select("line"), "line", "left_anti").select(columns)
    lines = named.join(maybe_of(distinct.select("line", "n", "first"), named), "line")
    wide = lines.groupBy("template").agg(F.max("n").alias("least"), F.sum("n").alias("most"), F.min("first").alias("first")).where(F.col("most") >= MIN_DOCS)
    # texts of several lines of one template count once; only templates whose lines have few texts each need a look
    sure = wide.where(F.col("least") >= MIN_DOCS)
    unsure = named.join(wide.where(F.col("least") < MIN_DOCS).select("template"), "template")
    enough = texts.join(F.broadcast(common), "line", "left_anti").select("line", "copy").join(unsure, "line")
    enough = enough.groupBy("template").agg(F.count_distinct("copy").alias("docs")).where(F.col("docs") >= MIN_DOCS).select("template")
    wide = sure.union(wide.join(enough, "template", "left_semi")).select("template", "first")
    return alone.union(named.join(wide, "template").select(columns))


def passages(texts: DataFrame, distinct: DataFrame, common: DataFrame) -> DataFrame:
    """``line, copy`` of the passages that an earlier, otherwise different text has; ``copy`` is the later one's.

    Only lines of fewer than ``MIN_DOCS`` texts are looked at, so a line makes ``MIN_DOCS - 2`` pairs with its first text at most.
    """
    rare = distinct.where(F.col("n").between(2, MIN_DOCS - 1) & (F.col("size") >= PASSAGE_TOKENS)).select("line")
    rare = stored(rare, "lines-rare")
    held = maybe_of(texts.join(F.broadcast(common), "line", "left_anti").select("line", "copy", "doc_id"), rare).join(rare, "line")
    by_line = held.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("doc_id", "copy"))).alias("t"))  # MIN_DOCS - 1 at most
    pairs = by_line.select("line", F.col("t")[0]["copy"].alias("a"), F.explode(F.slice("t", 2, MIN_DOCS)).alias("b")).select("line", "a", F.col("b.copy").alias("b"))
    pairs = stored(pairs, "lines-pairs")
    both = pairs.select("a", "b").distinct()
    heads = texts.where(F.col("size") >= DEPTH).select("copy", "head", "size")
    wanted = both.select(F.explode(F.array("a", "b")).alias("copy")).distinct()
    heads = heads.join(wanted, "copy", "left_semi").groupBy("copy", "head").agg(F.count("*").alias("lines"), F.sum("size").alias("tokens"))
    heads = stored(heads, "lines-heads-of-texts")
    sizes = heads.groupBy("copy").agg(F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"))
    theirs = both.join(heads.withColumnRenamed("copy", "b"), "b").join(heads.select(F.col("copy").alias("a"), "head"), ["a", "head"], "left_semi")
    alike = theirs.groupBy("a", "b").agg(F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"))
    for c in ("a", "b"):
        alike = alike.join(sizes.select(F.col("copy").alias(c), F.col("lines").alias(f"lines_{c}"), F.col("tokens").alias(f"tokens_{c}")), c)
    half = [F.col(x) >= VERSION_SHARE * F.greatest(f"{x}_a", f"{x}_b") for x in ("lines", "tokens")]
    return pairs.join(alike.where(~(half[0] & half[1])), ["a", "b"], "left_semi").select("line", F.col("b").alias("copy")).distinct()


def without(text: Column, drop: Column) -> Column:
    """``text`` without the lines whose numbers, rising, ``drop`` holds; work in proportion to the text."""

    def rest(lines: Column) -> Column:
        after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(drop, k - 1) + 1)
        until = lambda k: F.coalesce(F.get(drop, k), F.size(lines))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda k: F.slice(lines, after(k) + 1, until(k) - after(k)))), "\n")

    # let-bound, so that the text is split once
    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), rest), 1)


def dedup(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """The rows of ``docs`` with recurring lines cut from ``text``, and the counts ``n_lines`` and ``n_dropped`` beside.

    Null texts stay null, with null counts; an empty text is one line, which stays, as do lines of white space. Rows of a null doc_id keep all lines. Repeated rows are the same
    document and are treated alike. Ties in doc_id go to the earlier line. Further columns stay as they are, but for those named like the two counts, which are replaced. An
    empty table gives no rows. Texts of any length and number of lines are parsed and rewritten whole.
    """
    rows = stored(parsed(docs), "lines-parsed")
    texts = stored(by_text(rows.drop("compared")), "lines-texts")
    distinct = stored(distinct_lines(texts), "lines-distinct")
    hot = hot_values(distinct, "line", "rows")
    common = hot.join(distinct.where(F.col("n") >= MIN_DOCS), "line", "left_semi")
    named = stored(templates(crowded(distinct, rows)), "lines-templates")
    again = stored(recurring(texts, distinct, named, common), "lines-recurring")
    places = rows.select("doc_id", "copy", "line_no", "line")
    id_, copy, drop = free(docs, "doc", "copy", "drop")
    drops = (
        split_join(places, again, ["line"], hot).where("copy <> first_copy or line_no <> first_line_no").select("doc_id", "copy", "line_no")
        .union(split_join(places, stored(passages(texts, distinct, common), "lines-passages"), ["line", "copy"], hot).select("doc_id", "copy", "line_no")).distinct()
        .groupBy(F.col("doc_id").alias(id_), F.col("copy").alias(copy)).agg(F.sort_array(F.collect_list("line_no")).alias(drop))
    )
    others = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    marked = docs.select(*[F.col(f"`{c}`") for c in others]).join(drops, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(copy)), "left")
    has = F.col("text").isNotNull()
    counts = [F.when(has, F.size(F.split("text", "\n", -1))).alias(n_lines), F.when(has, F.coalesce(F.size(drop), F.lit(0))).alias(n_dropped)]
    text = F.when(F.col(drop).isNotNull(), without(F.col("text"), F.col(drop))).otherwise(F.col("text"))
    return marked.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in others], *counts)
