"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct five-word shingles, as 64-bit hashes. Each of 96 buckets sees the whole set through a hash
of its own and keeps its smallest value compressed to a register: the count of leading zeros and the 10 bits that follow
the first one (a single hash split over buckets would leave those of short documents empty). Bands of four registers find candidates; their Jaccard index is estimated from
equal registers less the collisions expected of compressed ones; pairs that the estimate doesn't rule out are confirmed on the full sets.

Equal sets are one node from the start, so copies are never paired. Within a band's bucket, candidates are linked to one leader
at a time instead of in all pairs. Only buckets whose nodes the leaders haven't joined are compared further, across components, inside tasks and in
blocks; a pair is compared in the first band that it shares, and from large buckets only confirmed links leave a task. So no link
is lost. At a similarity of 0.85 a pair misses all 24 bands with a probability of 2e-8, and the estimate (standard
error 0.036 there) rules a pair out only below 0.63.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounded_batches, free, mix, powers, runs, slices, stored, utf8_parts

WORDS = 5
BUCKETS, BAND = 96, 4
MANTISSA = 10
SLACK = 0.22
LEADER_ROUNDS = 2
#: Members of a star that one group compares with the leader.
GROUP = 256
#: Wanted ids that are broadcast at most: a few MB.
BROADCAST_IDS = 200_000
#: Buckets of more open nodes are compared in blocks of ``OPEN_BLOCK`` nodes, and their plausible pairs with full sets at hand.
SMALL_BUCKET = 64
OPEN_BLOCK = 512

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HASHES = _random.integers(1, 2**63, BUCKETS, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_Q = [np.uint64(pow(0xD6E8FEB86659FD93, k, 2**64)) for k in range(WORDS)]


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and each text's count.

    Words are runs of bytes other than space and 9-13; A-Z count as a-z. With one to four words the whole sequence is one shingle.
    """
    raw, offsets = utf8_parts(column)
    n_docs = len(offsets) - 1
    space = np.ones(len(raw) + 1, bool)
    space[:-1] = _SPACE[raw]
    inner = offsets[1:-1]
    edge = np.diff(space.astype(np.int8), prepend=1)
    begins = edge == -1
    begins[inner[inner < len(raw)]] |= ~space[inner[inner < len(raw)]]
    starts = np.flatnonzero(begins)
    # a word ends at the next space or document
    space[offsets] = True
    stops = np.flatnonzero(space)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(_P, len(raw)), out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * powers(_P_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, offsets[:-1])
        last = np.searchsorted(starts, offsets[1:])
        n = len(words)
        all_five = mix(reduce(np.add, (words[k : n - WORDS + 1 + k] * _Q[k] for k in range(WORDS)))) if n >= WORDS else np.zeros(0, np.uint64)
        out, counts = [], np.zeros(n_docs, np.int64)
        for d, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            if b - a >= WORDS:
                h = np.unique(all_five[a : b - WORDS + 1])
            elif b > a:
                h = mix(reduce(np.add, (words[a + k : a + k + 1] * _Q[k] for k in range(b - a))) + np.uint64(b - a))
            else:
                continue
            counts[d] = len(h)
            out.append(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def registers(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sets (none empty) to rows of 96 registers of 16 bits: leading zeros of the smallest hash, then its mantissa."""
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    out = np.empty((len(counts), BUCKETS), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(BUCKETS):
            least = np.minimum.reduceat(hashes * _HASHES[k], starts) | np.uint64(1)
            zeros = (63 - np.floor(np.log2(least.astype(np.float64) * (1 - 2.0**-53)))).astype(np.int64).clip(0, 63)
            after = (least << zeros.astype(np.uint64)) << np.uint64(1)
            out[:, k] = (zeros << MANTISSA) | (after >> np.uint64(64 - MANTISSA)).astype(np.int64)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard index from equal registers, corrected for registers that are equal by compression.

    Two different minima fall in one register with a probability of about 0.7213 * 2^-mantissa * n_a n_b / (n_a + n_b)^2.
    """
    equal = (a == b).mean(1)
    chance = 0.7213 * 2.0**-MANTISSA * n_a * n_b / (n_a + n_b) ** 2
    return (equal - chance) / (1 - chance)


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, registers`` of each text; the last two are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes, counts = shingles(part.column("text"))
                digest: list = [None] * len(counts)
                rows: list = [None] * len(counts)
                full = np.flatnonzero(counts)
                if len(full):
                    r = registers(hashes, counts[full])
                    at = 0
                    for k, d in enumerate(full.tolist()):
                        digest[d] = hashlib.blake2b(hashes[at : at + counts[d]].tobytes(), digest_size=16).digest()
                        rows[d] = r[k].tobytes()
                        at += counts[d]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(digest, pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "n_shingles", "digest", "registers"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``a, b, estimate`` of the pairs whose estimated index is ``least - SLACK`` or more."""
    one = nodes.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            na, nb = (np.asarray(batch.column(c), dtype=float) for c in ("na", "nb"))
            e = estimate(a, b, na, nb)
            # sizes alone bound the index
            keep = pa.array((e >= least - SLACK) & (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(e).filter(keep)], names=["a", "b", "estimate"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long, estimate double")


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a: leader, b: member) with 100 * intersection >= percent * union on full sets.

    Sets travel once, to their leader's groups of at most ``GROUP`` members; large stars are split, each part with a copy of the leader's set.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    members = pairs.join(sizes, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    leaders = sizes.select(F.col("a").alias("doc_id"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = stored(members.union(leaders), "minhash-wanted")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for lead, doc, raw in zip(batch.column("leader").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("set").to_pylist()):
                other = np.frombuffer(raw, np.uint64)
                if lead == doc:
                    leader, own = lead, other
                    continue
                if lead != leader:
                    continue  # the leader's row is not there
                both = common(own, other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    a.append(lead)
                    b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    by_star = sorted_sets(docs, wanted).repartition("leader", "part").sortWithinPartitions("leader", "part", (F.col("doc_id") != F.col("leader")))
    return by_star.mapInArrow(compare, "a long, b long")


def sorted_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rows of doc_id and others) with the document's ``set``, sorted 64-bit hashes."""
    keep = [c for c in wanted.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                hashes, counts = shingles(piece.column("text"))
                ends = np.cumsum(counts)
                sets = [hashes[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), piece.column("doc_id"), pa.array(sets, pa.binary())], names=[*keep, "doc_id", "set"])

    types = dict(wanted.dtypes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # few wanted ids are broadcast, and the texts stay where they are; more of them meet the texts by hash
    met = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    return texts.join(met, "doc_id").select(*keep, "doc_id", "text").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), "doc_id long", "set binary"]))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def open_pairs(r: np.ndarray, n: np.ndarray, component: np.ndarray, block: np.ndarray, band: int, i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows a < b of a bucket's group that may be linked, and their estimates: of different components, plausible, and in their first common band."""
    a_out, b_out, e_out = [], [], []
    for a in range(len(r) - 1):
        b = np.arange(a + 1, len(r))
        b = b[(component[b] != component[a]) & ((block[b] != block[a]) if i != j else True)]
        if not len(b):
            continue
        equal = r[b] == r[a]
        e = equal.mean(1)
        chance = 0.7213 * 2.0**-MANTISSA * n[a] * n[b] / (n[a] + n[b]) ** 2
        e = (e - chance) / (1 - chance)
        first = equal.reshape(len(b), -1, BAND).all(2).argmax(1)
        ok = (e >= least - SLACK) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9) & (first == band)
        a_out.append(np.full(ok.sum(), a))
        b_out.append(b[ok])
        e_out.append(e[ok])
    if not a_out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(a_out), np.concatenate(b_out), np.concatenate(e_out)


#: Where a pair of blocks of one bucket meets.
PLACE = ["band", "key", "i", "j"]


def _group_arrays(group: pa.Table) -> tuple:
    r = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(group), BUCKETS)
    band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
    return r, np.asarray(group.column("n_shingles"), dtype=float), np.asarray(group.column("component")), np.asarray(group.column("block")), band, i, j


def open_candidates(rows: DataFrame, least: float) -> DataFrame:
    """``a, b``: plausible pairs across components of small buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, PLACE):
            a, b, _ = open_pairs(*_group_arrays(group), least)
            node = np.asarray(group.column("doc_id"))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, "a long, b long")


def plausible_members(rows: DataFrame, least: float) -> DataFrame:
    """The rows of each group that are in one of its plausible pairs, with their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, PLACE):
            a, b, _ = open_pairs(*_group_arrays(group), least)
            if len(a):
                yield from group.take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()

    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, rows.schema)


def open_links(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: confirmed links across components of large buckets, enough to join what is linked within each group (rows carry full sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, PLACE):
            arrays = _group_arrays(group)
            a, b, e = open_pairs(*arrays, percent / 100)
            node = np.asarray(group.column("doc_id"))
            sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            root = {c: c for c in arrays[2].tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            out = []
            for k in np.argsort(-e, kind="stable").tolist():
                x, y = int(a[k]), int(b[k])
                cx, cy = find(int(arrays[2][x])), find(int(arrays[2][y]))
                if cx == cy:
                    continue
                both = common(sets[x], sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    root[max(cx, cy)] = min(cx, cy)
                    out.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; ``component_id`` is the smallest doc_id
    reachable and ``kept`` marks it. Null and empty texts, and texts of white space, have an empty set and stand alone. Rows of a
    null doc_id are never linked and are kept, with a null component. Rows that repeat a doc_id are one document, also with different
    texts: any of them links it, and ``n_shingles`` is the row's own. Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(sketch(docs), "minhash-sketch")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = stored(linked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "minhash-nodes")
    width = 2 * BAND
    keys = F.posexplode(F.array(*[F.xxhash64(F.substring("registers", k * width + 1, width)) for k in range(BUCKETS // BAND)]))
    bands = nodes.select("node", keys.alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    members = stored(bands.join(shared, ["band", "key"]), "minhash-members")
    found = None
    parts = None

    def with_parts() -> DataFrame:
        if parts is None:
            return members.withColumn("component", F.col("node"))
        return members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def verify(candidates: DataFrame) -> bool:
        """Adds confirmed links; says whether there was any candidate."""
        nonlocal found, parts
        near = plausible(candidates, nodes, percent / 100)
        near = near.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
        near = stored(near.select("a", "b"), "minhash-candidates")
        if near.isEmpty():
            return False
        links = stored(confirmed(docs, near, percent), "minhash-links")
        found = links if found is None else found.union(links)
        parts = stored(components(found), "minhash-components")
        return True

    for turn in range(LEADER_ROUNDS):
        now = with_parts()
        leader = now.groupBy("band", "key").agg(
            (F.min(F.struct("node", "component")) if turn == 0 else F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn)))).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi")
        ).where("lo <> hi").select("band", "key", F.col("l.node").alias("a"), F.col("l.component").alias("ca"))
        if not verify(now.join(leader, ["band", "key"]).where("component <> ca").select("a", F.col("node").alias("b")).distinct()):
            break
    # whatever the rounds found: that no leader resembles its bucket says nothing of two other members
    now = with_parts()
    split = now.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    blocks = F.ceil(F.col("n") / OPEN_BLOCK).cast("int")
    rows_open = (
        now.join(split.select("band", "key", "n", blocks.alias("blocks")), ["band", "key"])
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "key", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "component", F.col("node").alias("doc_id"))
    )
    sketches = nodes.select(F.col("node").alias("doc_id"), "registers", "n_shingles")
    rows_open = stored(rows_open.join(sketches, "doc_id"), "minhash-open")
    pairs = stored(open_candidates(rows_open.where(F.col("n") <= SMALL_BUCKET), percent / 100).distinct(), "minhash-candidates")
    more = []
    if not pairs.isEmpty():
        more.append(stored(confirmed(docs, pairs, percent), "minhash-links"))
    # sketches alone move to every pair of blocks; full sets only where a document has a plausible partner
    large = stored(plausible_members(rows_open.where(F.col("n") > SMALL_BUCKET), percent / 100), "minhash-plausible")
    if not large.isEmpty():
        sets = sorted_sets(docs, stored(large.select("doc_id").distinct(), "minhash-wanted"))
        more.append(stored(open_links(large.join(sets, "doc_id"), percent), "minhash-links"))
    if more:
        found = reduce(DataFrame.union, more if found is None else [found, *more])
        parts = stored(components(found), "minhash-components")

    of_digest = nodes.select("digest", "node")
    if parts is not None:
        of_digest = of_digest.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("node"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n_shingles", "digest")
        .join(of_digest, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each document that stands for its group, with its columns as they are.

    Rows of a null doc_id all stay, and null and empty texts stand alone. Of rows that repeat a doc_id, that with the smallest text (null first) stays. Further columns
    of any name stay; an empty table gives no rows.
    """
    (name,) = free(docs, "gone")
    gone = groups(docs, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    # ids alone are counted; only rows that repeat one are compared, combined before they move
    repeated = stored(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name), "minhash-repeated")
    if repeated.isEmpty():
        return left
    same = F.col("doc_id") == F.col(name)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text")).alias("row")).select("row.*")
    return left.join(repeated, same, "left_anti").union(once)


#: The query's rows in SQL, from all pairs that share a shingle.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from w, unnest(range(1, greatest(2, len(ws) - 3))) t(i) where len(ws) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), c as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), e as (
  select x, y from c join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)
), both_ways as (
  select x, y from e union all select y, x from e
), walk(root, doc_id) as (
  select doc_id, doc_id from w union select k.root, b.y from walk k join both_ways b on b.x = k.doc_id
), least_root as (
  select doc_id, min(root) as component_id from walk group by doc_id
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from w left join n using (doc_id) join least_root using (doc_id)
"""
