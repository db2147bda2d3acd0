"""Phrases that recur, scored by how much more often than their parts would meet by chance.

Texts become shards: runs of word numbers of one language, of about ``SHARD_WORDS`` words, with the shard's own vocabulary. Over each shard stands a
generalised suffix automaton, bounded at ``LENGTH`` words and built level by level: the substrings of a length extend those that are one word shorter, each
with its count of end positions and its suffix link, and substrings with the same end positions are one state. Its substrings and counts are reduced over
all shards.

A phrase can only reach ``LEAST`` occurrences if both phrases that are one word shorter do. So lengths are counted one after another, and each automaton
extends only what the lengths before have left. What they left is known to the tasks as one bit for each hash; a bit set by another phrase admits
work, never a wrong phrase, and the last pass counts whole phrases by their words. The bits have a bound (``MOST_BITS``), beyond which they just prune less.

A phrase lies inside a longer one of (nearly) its frequency exactly if it lies inside one that is one word longer and as frequent, since frequency
cannot rise on the way. So the automata's suffix links (without the first word) and prefixes (without the last one) decide subsumption.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, hot_values, mix, powers, split_join, stored

LENGTH = 5
LEAST = 100
#: A phrase goes if a longer one has this share, in percent, of its occurrences.
SUBSUMED = 100
TOP = 2000
NO_LANGUAGE = "und"
#: Words of a shard; a task's Python holds about 120 bytes for each of them while it walks an automaton.
SHARD_WORDS = 1 << 18
#: Words of the shards of all languages that a task fills at a time, and how many different ones there may be among them.
HELD_WORDS, HELD_VOCABULARY = 1 << 20, 1 << 18
#: Bytes of the Arrow batches in which texts and shards reach tasks.
BATCH_BYTES = 8 << 20
#: Bytes of a text that are split into words at a time.
TEXT_BYTES = 4 << 20
#: Bytes of the longest words that are hashed in columns, and the words of a column.
SHORT, COLUMN = 64, 1 << 13
#: Bits of a filter: sixteen for each frequent phrase, up to this bound.
MOST_BITS = 1 << 27
#: Parts into which a language's phrases are dealt before its first ones are taken.
DEALT = 64

BREAK = b"\xff"  # in no UTF-8 text
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")


class Shard:
    """Words of one language as numbers of their own vocabulary; number 0 is a break between pieces."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count(1).__next__, {BREAK: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self) -> tuple[list[bytes], bytes]:
        return list(self.numbers)[1:], np.concatenate(self.parts).astype("<i4").tobytes()


def words(text: bytes) -> list[bytes]:
    """Words and breaks of a lower-cased text."""
    return text.lower().translate(_SPLIT).replace(BREAK, b" \xff ").split()


def chunks(text: bytes) -> Iterator[bytes]:
    """A text cut at blanks into parts of about ``TEXT_BYTES``."""
    at = 0
    while len(text) - at > TEXT_BYTES:
        cut = text.find(b" ", at + TEXT_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def shards(docs: DataFrame) -> DataFrame:
    """``lang, n_words, words, sequence``: the words and breaks of all texts; no piece is cut, and none goes over a shard's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        total = known = 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                own = held.setdefault(langs[i], Shard())
                total, known = total - own.size, known - len(own.numbers)
                for part in chunks(text.as_py() or b""):
                    own.add(words(part))
                own.add([BREAK])
                total, known = total + own.size, known + len(own.numbers)
                full = [langs[i]] if own.size >= SHARD_WORDS else []
                while full or total >= HELD_WORDS or known >= HELD_VOCABULARY:
                    most = full.pop() if full else max(held, key=lambda k: held[k].size)
                    shard = held.pop(most)
                    total, known = total - shard.size, known - len(shard.numbers)
                    yield rows([(most, shard)])
        for lang, shard in held.items():
            yield rows([(lang, shard)])

    def rows(some: list[tuple[str, Shard]]) -> pa.RecordBatch:
        (lang, shard) = some[0]
        vocabulary, raw = shard.row()
        n = int(np.count_nonzero(np.frombuffer(raw, "<i4")))
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n]), pa.array([vocabulary], pa.list_(pa.binary())), pa.array([raw], pa.binary())], names=["lang", "n_words", "words", "sequence"])

    return docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text").mapInArrow(run, "lang string, n_words long, words array<binary>, sequence binary")


class Filter:
    """A set of 64-bit hashes as one bit each: it holds every one that it was given, and a few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """From a stored column ``key``; the bits are set by tasks."""
        size = 1 << max(6, min(MOST_BITS, 16 * max(1, keys.count())).bit_length())
        size = min(size, MOST_BITS)
        at = F.col("key").bitwiseAND(F.lit(size - 1))
        found = keys.groupBy(F.shiftright(at, 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(bits)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of numbers from 0 on: where each different one comes first, every place's rank among them, and how often each occurs."""
    n = len(key)
    shift = n.bit_length()
    if n and int(key.max()).bit_length() + shift < 64:
        # number and place in one word each, which sorts several times as fast as an argsort
        both = (key << shift) | np.arange(n)
        both.sort()
        order, key = both & ((1 << shift) - 1), both >> shift
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    of = np.empty(n, np.int32)
    of[order] = np.cumsum(new) - 1
    return order[begin], of, np.diff(begin, append=n)


@dataclass
class Level:
    """Substrings of one length: an end position's node, and each node's count, word, prefix, suffix link and one place."""

    node: np.ndarray  # of the substring that begins at a position; -1 for none
    count: np.ndarray
    place: np.ndarray
    prefix: np.ndarray
    link: np.ndarray


class Automaton:
    """A generalised suffix automaton over a sequence of numbers (0: break), of substrings of bounded length.

    A substring's occurrences are its end positions. ``link`` leads to the substring without its first word, whose end positions include its own: where both
    have equally many they are one state, and the state's longest substring stands for both.
    """

    def __init__(self, sequence: np.ndarray, n_words: int):
        self.sequence, self.n_words = sequence, n_words
        self.levels: list[Level] = []

    def open(self) -> np.ndarray:
        """The positions where a substring of the next length begins whose prefix and suffix are left."""
        if not self.levels:
            return np.flatnonzero(self.sequence)
        node = self.levels[-1].node
        return np.flatnonzero((node[:-1] >= 0) & (node[1:] >= 0))

    def extend(self, at: np.ndarray) -> Level:
        """Adds the next length, of the substrings that begin ``at`` these positions."""
        n = len(self.levels)
        if n:
            before = self.levels[-1].node
            key = before[at].astype(np.int64) * self.n_words + self.sequence[at + n]
        else:
            key = self.sequence[at].astype(np.int64)
        first, of, count = distinct(key)
        node = np.full(len(self.sequence), -1, np.int32)
        node[at] = of
        place = at[first]
        prefix, link = (before[place], before[place + 1]) if n else (np.full(len(place), -1, np.int32),) * 2
        self.levels.append(Level(node, count, place, prefix, link))
        return self.levels[-1]

    def longest(self, length: int) -> np.ndarray:
        """Of each substring of a length, whether it is its state's longest: none that is one word longer to the left ends at all its ends."""
        own = self.levels[length - 1]
        out = np.ones(len(own.count), bool)
        if length < len(self.levels):
            longer = self.levels[length]
            out[longer.link[longer.count == own.count[longer.link]]] = False
        return out

    def states_of(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First positions, shortest lengths and counts of the states whose longest substring has this length."""
        own = self.levels[longest - 1]
        nodes = np.flatnonzero(self.longest(longest))
        shortest = np.full(len(nodes), longest)
        at, count = own.link[nodes], own.count[nodes]
        for m in range(longest - 1, 0, -1):
            same = (shortest == m + 1) & (self.levels[m - 1].count[at] == count)
            shortest[same] = m
            at = np.where(same, self.levels[m - 1].link[at], 0)
        return own.place[nodes], shortest, count

    def states(self) -> Iterator[tuple[int, int, int, int]]:
        """(first position, longest length, shortest length, count) of each state."""
        for length in range(len(self.levels), 0, -1):
            place, shortest, count = self.states_of(length)
            yield from zip(place.tolist(), [length] * len(place), shortest.tolist(), count.tolist())


def hashes(lang: str, vocabulary: pa.Array) -> np.ndarray:
    """Words of a language as 64 bits each: a polynomial of the bytes of a short word, columns at a time, and xxhash of a long one."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    out = np.zeros(len(vocabulary), np.uint64)
    length = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(vocabulary[i].as_py(), seed)
    short = np.flatnonzero(length <= SHORT)
    for at in range(0, len(short), COLUMN):
        own = short[at : at + COLUMN]
        column = vocabulary.take(pa.array(own))
        begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(own)]
        sizes = length[own]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[begin[0] : begin[0] + sizes.sum()].astype(np.uint64)
        begin = begin - begin[0]
        place = np.arange(len(raw)) - np.repeat(begin, sizes)
        out[own] = mix(np.add.reduceat((raw + np.uint64(1)) * powers(0x9E3779B97F4A7C15, SHORT)[place], begin) ^ np.uint64(seed))
    return out


def walk(lang: str, vocabulary: pa.Array | list[bytes], raw: bytes, filters: list[Filter]) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The automaton of what the filters leave, and the positions and hashes of substrings of the next length."""
    if isinstance(vocabulary, list):
        vocabulary = pa.array(vocabulary, pa.binary())
    sequence = np.frombuffer(raw, "<i4")
    word = np.r_[np.zeros(1, np.uint64), hashes(lang, vocabulary)][sequence]
    automaton = Automaton(sequence, len(vocabulary) + 1)
    at, key = automaton.open(), word
    keys = key[at]
    for n, own in enumerate(filters, 1):
        at = at[own.holds(keys)]
        automaton.extend(at)
        whole = np.zeros(len(sequence), np.uint64)
        whole[at] = key[at]
        at = automaton.open() if n < LENGTH else at[:0]
        keys = mix(whole[at] * np.uint64(0x9E3779B97F4A7C15) + word[at + n])
        key = np.zeros(len(sequence), np.uint64)
        key[at] = keys
    return automaton, at, keys


def shard_of(batch: pa.RecordBatch, i: int) -> tuple[str, pa.Array, bytes]:
    return batch.column("lang")[i].as_py(), batch.column("words")[i].values, batch.column("sequence")[i].as_py()


def counted(parts: DataFrame, filters: list[Filter]) -> DataFrame:
    """``key, n``: the hashes of the substrings of the length after the filters', with their occurrences in each shard."""
    shared = parts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, vocabulary, raw = shard_of(batch, i)
                automaton, at, keys = walk(lang, vocabulary, raw, shared.value)
                level = automaton.extend(at)
                key = np.zeros(len(automaton.sequence), np.uint64)
                key[at] = keys
                yield pa.RecordBatch.from_arrays([pa.array(key[level.place].view(np.int64)), pa.array(level.count.astype(np.int64))], names=["key", "n"])

    return parts.select("lang", "words", "sequence").mapInArrow(run, "key long, n long")


def phrases(parts: DataFrame, filters: list[Filter]) -> DataFrame:
    """``lang, phrase, n_words, n``: what all filters leave, by its words: the substrings of each shard's states."""
    shared = parts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, vocabulary, raw = shard_of(batch, i)
                automaton, _, _ = walk(lang, vocabulary, raw, shared.value)
                for longest in range(LENGTH, 0, -1):
                    place, shortest, n = automaton.states_of(longest)
                    for m in range(1, longest + 1):
                        own = np.flatnonzero(shortest <= m)
                        yield from rows(lang, vocabulary, automaton.sequence, place[own] + (longest - m), m, n[own])

    def rows(lang: str, vocabulary: pa.Array, sequence: np.ndarray, place: np.ndarray, m: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.r_[0, pc.binary_length(vocabulary).to_numpy(zero_copy_only=False)].astype(np.int64)
        block = np.cumsum(64 + sum(size[sequence[place + k]] for k in range(m))) // BATCH_BYTES
        ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(place)]
        for begin, end in zip([0, *ends], ends):
            number = sequence[place[begin:end, None] + np.arange(m)].ravel() - 1
            offsets = pa.array(np.arange(0, len(number) + 1, m, dtype=np.int32))
            phrase = pc.binary_join(pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(number))), b" ").cast(pa.string())
            columns = [pa.repeat(lang, end - begin), phrase, pa.repeat(pa.scalar(m, pa.int32()), end - begin), pa.array(n[begin:end].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n_words", "n"])

    return parts.select("lang", "words", "sequence").mapInArrow(run, "lang string, phrase string, n_words int, n long")


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``LENGTH`` words that occur ``least`` times or more in a language (``lang, phrase, n_words, a``), and each language's words (``lang, n``)."""
    bounded_batches(docs.sparkSession, size=BATCH_BYTES)
    parts = stored(shards(docs), "collocations-shards")
    filters: list[Filter] = []
    for _ in range(LENGTH):
        keys = counted(parts, filters).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
        filters.append(Filter.of(stored(keys, "collocations-keys")))
    found = phrases(parts, filters).groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return stored(found, "collocations-phrases"), stored(parts.groupBy("lang").agg(F.sum("n_words").alias("n")), "collocations-words")


def looked_up(rows: DataFrame, found: DataFrame, name: str, out: str) -> DataFrame:
    """``rows`` with the occurrences of the phrase in column ``name`` as ``out``."""
    table = found.select("lang", F.col("phrase").alias(name), F.col("a").alias(out))
    return split_join(rows, table, ["lang", name], hot_values(rows.groupBy(name).agg(F.count("*").alias("n_rows")), name, "n_rows"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two to five words.

    Texts are lower-cased in A-Z, split into pieces at ``. , ; : ! ?`` and line ends and those into words at blanks and tabs. ``n`` counts a language's words and ``a`` a phrase's
    occurrences, overlaps included, ``least`` or more. Of all cuts of a phrase in two the one with the lowest floor(1000 a n / (l r)) counts, ``l`` and ``r`` being the parts'
    occurrences; ties go to the shorter first part. Phrases inside a longer one with ``subsumed`` percent of their occurrences go. Order: score and ``a``
    descending, then the phrase's bytes.

    Null texts are empty, and a null language is ``und``. Rows that repeat count as often as they occur. Other columns are ignored; an empty table gives no rows.
    """
    found, totals = frequent(docs, least)
    candidates = found.where(F.col("n_words") >= 2)
    longer = candidates.where(F.col("n_words") >= 3).withColumn("words", F.split("phrase", " ", -1))
    shorter = F.array(F.array_join(F.expr("slice(words, 1, n_words - 1)"), " "), F.array_join(F.expr("slice(words, 2, n_words - 1)"), " "))
    around = longer.select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = candidates.join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < subsumed * F.col("a")))
    left = stored(left.select("lang", "phrase", "n_words", "a"), "collocations-candidates")

    cuts = left.withColumn("words", F.split("phrase", " ", -1)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(words, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(words, k + 1, n_words - k)"), " ").alias("rest"))
    both = looked_up(looked_up(cuts, found, "first", "l"), found, "rest", "r")
    both = split_join(both, totals, ["lang"], hot_values(totals, "lang"))
    # whole numbers of up to 38 digits
    score = F.expr("cast((cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    lowest = both.select("lang", "phrase", F.struct(score.alias("score"), "k", "a", "l", "r", "n").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"))
    scored = lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same result in SQL, for the registered query.
ORACLE = rf"""
with pieces as (
  select coalesce(lang, '{NO_LANGUAGE}') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
f as materialized (
  select lang, m, phrase, count(*) as a from (
    select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) as phrase from w, range(1, {LENGTH + 1}) t(m)
  ) group by lang, m, phrase having count(*) >= {LEAST}
), c as (select lang, m, phrase, a, string_split(phrase, ' ') as w from f where m >= 2),
kept as (
  select * from c where not exists (
    select 1 from c longer where longer.lang = c.lang and longer.m > c.m and contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ') and 100 * longer.a >= {SUBSUMED} * c.a
  )
), cuts as (
  select kept.lang, kept.phrase, kept.a, k, f1.a as l, f2.a as r, n, cast((1000::hugeint * kept.a * n) // (f1.a::hugeint * f2.a) as bigint) as score
  from kept, range(1, {LENGTH}) t(k), f f1, f f2, totals
  where k < kept.m and f1.lang = kept.lang and f2.lang = kept.lang and totals.lang = kept.lang
    and f1.phrase = array_to_string(kept.w[1 : k], ' ') and f2.phrase = array_to_string(kept.w[k + 1 : kept.m], ' ')
), lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest qualify rank <= {TOP}
"""
