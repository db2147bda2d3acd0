"""Exact top-k inner products by a pivot-distance index.

Vectors are quantised to whole numbers. Pivots are fitted on a bounded sample; every vector is keyed by its nearest pivot and its
distance from it, and each pivot's distances are cut into sorted annuli. The directory of annuli (at most ``PIVOTS * ANNULI`` rows) holds their smallest
and largest distance, largest norm and count. Large annuli are split into blocks of about ``BLOCK`` vectors, so that many equal vectors
don't meet in one task.

A query's k-th score among the sample's vectors bounds its k-th score from below. Its annuli are then expanded in the order of their
bounds: by the triangle inequality no vector of an annulus is nearer to q than |d(q, pivot) - r| for the nearest r in it, and
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2. The ``FIRST`` annuli come first; what they hold raises the k-th score, and the expansion goes on from there and stops
at the first annulus whose bound is below it. Queries travel in chunks to the blocks, where one matrix product scores a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, stored

PIVOTS, ANNULI = 16, 8
#: Vectors on which pivots and the annuli's edges are fitted, in expectation.
SAMPLE = 4096
BLOCK = 2048
CHUNK = 256
SCALE = 1024
#: Vectors of a larger squared norm (quantised) take no part: their products might not fit 64 bits.
LARGEST = 4e18
#: Annuli of a query that are expanded before its k-th score is looked at again.
FIRST = 8
LOWEST = np.iinfo(np.int64).min


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vec array<long>``: floor(1024 x) of each component; vectors null, empty, with a null or non-finite component or of a squared norm over ``LARGEST`` are left out."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm2 = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v * SCALE, F.lit(2.0)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good & (norm2 <= LARGEST))
    return rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v * SCALE)).alias("vec"))


def padded(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """``vectors`` with zeros up to the longest one's length, how many there are, and that length; so shorter ones score by what they have in common."""
    n, width = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width or 0) - F.size("vec"))
    return vectors.withColumn("vec", F.when(F.size("vec") == width, F.col("vec")).otherwise(F.concat("vec", zeros))), n, width


def fit(vectors: np.ndarray, seed: int = 5, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pivots (Lloyd's rounds from random rows) and each pivot's inner annulus edges (quantiles of its distances)."""
    rng = np.random.default_rng(seed)
    pivots = vectors[rng.choice(len(vectors), min(PIVOTS, len(vectors)), replace=False)].astype(float)
    for _ in range(rounds):
        near = distances(vectors, pivots).argmin(1)
        for p in range(len(pivots)):
            if (near == p).any():
                pivots[p] = vectors[near == p].mean(0)
    d = distances(vectors, pivots)
    near, r = d.argmin(1), d.min(1)
    grid = np.linspace(0, 1, ANNULI + 1)[1:-1]
    edges = np.array([np.quantile(r[near == p], grid) if (near == p).any() else np.full(ANNULI - 1, np.inf) for p in range(len(pivots))])
    return pivots, edges


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products; through floating point where that is exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if bound < 2**53 else q @ x.T


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
    """(vec_id, score) of one query's k best in a block: largest score, then smallest id; its own row and scores under ``least`` take no part."""
    ok = np.flatnonzero((scores >= least) & (ids != own))
    if len(ok) > k:
        cut = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= cut]
    order = ok[np.lexsort((ids[ok], -scores[ok]))][:k]
    return list(zip(ids[order].tolist(), scores[order].tolist()))


def kth_score(q: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among other vectors, whose ids differ from each other; the lowest number where there are fewer."""
    out = np.full(len(q), LOWEST)
    if len(ids) <= k:
        return out
    for at in range(0, len(q), CHUNK):
        scores = products(q[at : at + CHUNK], vectors)
        scores[own[at : at + CHUNK, None] == ids] = LOWEST
        out[at : at + CHUNK] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return out


@dataclass(frozen=True)
class Directory:
    """Annuli as parallel arrays: pivot, number, smallest and largest distance, largest squared norm, and blocks."""

    pivots: np.ndarray
    pivot: np.ndarray
    annulus: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    norm2: np.ndarray
    blocks: np.ndarray

    def expansion(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query its annuli in falling order of their bounds, and how many of them come before the first hopeless one."""
        d = distances(q, self.pivots)[:, self.pivot]
        gap = np.maximum(0, np.maximum(self.lo - d, d - self.hi) - 1e-6 * (1 + d))
        bound = ((q.astype(float) ** 2).sum(1)[:, None] + self.norm2 - gap**2) / 2
        bound += 1e-6 * (1 + np.abs(bound))
        return np.argsort(-bound, axis=1, kind="stable"), (bound >= least[:, None]).sum(1)


PLACE = ["pivot", "annulus", "block"]


def asked(queries: DataFrame, directory: Directory, first: int, last: int | None) -> DataFrame:
    """Chunks of queries (query_id, vec, least) at the blocks of their annuli from ``first`` to before ``last`` in the order of expansion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                q, least, own = matrix(part.column("vec")), np.asarray(part.column("least")), np.asarray(part.column("query_id"))
                order, stop = directory.expansion(q, least)
                wanted = np.arange(order.shape[1]) < stop[:, None]
                wanted[:, :first] = False
                if last is not None:
                    wanted[:, last:] = False
                reached = np.zeros_like(wanted)
                np.put_along_axis(reached, order, wanted, 1)
                for e in np.flatnonzero(reached.any(0)).tolist():
                    some = np.flatnonzero(reached[:, e])
                    raw, n = (q[some].tobytes(), own[some].tobytes(), least[some].tobytes()), int(directory.blocks[e])
                    columns = [[int(directory.pivot[e])] * n, [int(directory.annulus[e])] * n, list(range(n)), *([x] * n for x in raw)]
                    types = [pa.int32()] * 3 + [pa.binary()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*PLACE, "queries", "own", "least"])

    return queries.mapInArrow(run, "pivot int, annulus int, block int, queries binary, own binary, least binary")


def scored(blocks: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the k best of each block for each query that asks it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, PLACE):
            is_query = np.asarray(group.column("queries").is_valid())
            if is_query.all() or not is_query.any():
                continue
            some = group.filter(pa.array(~is_query))
            ids, x = np.asarray(some.column("vec_id")), matrix(some.column("vec").combine_chunks())
            ids, first = np.unique(ids, return_index=True)
            x = x[first]
            for r in group.filter(pa.array(is_query)).select(["queries", "own", "least"]).to_pylist():
                own, least = np.frombuffer(r["own"], np.int64), np.frombuffer(r["least"], np.int64)
                scores = products(np.frombuffer(r["queries"], np.int64).reshape(len(own), -1), x)
                found = [(int(own[i]), v, s) for i in range(len(own)) for v, s in best(scores[i], ids, int(own[i]), k, int(least[i]))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    both = blocks.select(*PLACE, "vec_id", "vec").unionByName(chunks, allowMissingColumns=True)
    return both.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def search(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each row whose vec_id is divisible by ``every`` with all other rows.

    Ties go to the smaller vec_id; a query of fewer than k other rows gets all of them. Rows of an equal vec_id are not each other's
    candidates; repeated rows of a query are one query, and a candidate that repeats counts once. Vectors null or with null or
    non-finite components, empty ones, those of a squared norm over ``LARGEST`` and rows of a null vec_id take no part. Vectors of different lengths score by the components
    that both have. Other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    out_type = "query_id long, rank int, vec_id long, score long"
    vectors, n, width = padded(quantised(embeddings))
    if not n:
        return spark.createDataFrame([], out_type)
    share = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    sample = {r["vec_id"]: r["vec"] for r in share.collect() or vectors.limit(1).collect()}  # about SAMPLE rows
    pivots, edges = fit(np.array(list(sample.values()), np.int64))
    known = spark.sparkContext.broadcast((np.array(list(sample), np.int64), np.array(list(sample.values()), np.int64)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("vec").flatten(), dtype=np.int64).reshape(batch.num_rows, -1)
                d = distances(x, pivots)
                near, r = d.argmin(1), d.min(1)
                annulus = (r[:, None] >= edges[near]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(near, pa.int32()), pa.array(annulus, pa.int32()), pa.array(r), pa.array((x.astype(float) ** 2).sum(1))],
                    names=["vec_id", "vec", "pivot", "annulus", "r", "norm2"],
                )

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                least = kth_score(matrix(batch.column("vec")), np.asarray(batch.column("query_id")), *known.value, k)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec"), pa.array(least)], names=["query_id", "vec", "least"])

    index = stored(vectors.mapInArrow(key, "vec_id long, vec binary, pivot int, annulus int, r double, norm2 double"), "topk-index")
    rows = index.groupBy("pivot", "annulus").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("norm2").alias("norm2"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).collect()
    directory = Directory(pivots, *(np.array([r[c] for r in rows]) for c in ("pivot", "annulus", "lo", "hi", "norm2", "blocks")))
    n_blocks = F.create_map(*[F.lit(x) for r in rows for x in (r["pivot"] * ANNULI + r["annulus"], r["blocks"])])[F.col("pivot") * ANNULI + F.col("annulus")]
    blocks = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int"))
    own = index.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.first("vec").alias("vec"))
    queries = stored(own.mapInArrow(seed, "query_id long, vec binary, least long"), "topk-queries")

    found = stored(ranked(scored(blocks, asked(queries, directory, 0, FIRST), k), k), "topk-first")
    reached = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    further = queries.join(reached, "query_id", "left").select("query_id", "vec", F.greatest("least", "kth").alias("least"))
    rest = scored(blocks, asked(further, directory, FIRST, None), k)
    return ranked(found.drop("rank").union(rest), k).select("query_id", "rank", "vec_id", "score")


#: The same result in SQL, for the registered query.
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as vec
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(embedding, lambda x: pow(1024 * cast(x as double), 2))) <= 4e18
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.vec, c.vec, true), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
