"""Centroid clustering in whole numbers, with partial-distance search.

Vectors are quantised to whole numbers, so every distance, sum and centroid is exact and does not depend on how rows are partitioned. Each round
assigns vectors to their nearest centroids in the tasks that read them, folds each task's rows into one count and sum a cluster, and merges those; ``k`` rows
of ``dimensions`` numbers reach the driver. Vectors never move.

The search for the nearest centroid adds up squared differences over the dimensions of the highest variance first, ``STEP`` of them at a time. The centroid
that is nearest so far is finished at once and bounds the others: a centroid is abandoned once its partial sum is strictly above that bound.
Those that are left at the end have been summed over all dimensions, and the smallest number among the nearest wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SALT = "2:"
STEP = 16
#: Rows for which partial sums with all centroids are held at a time.
ROWS = 2048
#: Whole components from here on take no part: their squared distances might not fit 64 bits.
LARGEST = 1 << 27


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vec array<int>``: floor(256 x) of the vectors of exactly 64 components, none of them null or non-finite, or of ``LARGEST`` or more in the result."""
    x = F.col("embedding").cast("array<double>")
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < LARGEST))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where((F.size("embedding") == DIMENSIONS) & fits)
    return rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v * SCALE).cast("int")).alias("vec"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact; through floating point where that is exact."""
    largest = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * largest * largest * x.shape[1] < 2**53:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many components were compared in all.

    ``order``: the dimensions, those of the highest variance first.
    """
    x, c = x[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    width = x.shape[1]
    partial = squares(x[:, :STEP], c[:, :STEP])
    compared = partial.size * min(STEP, width)
    guess = partial.argmin(1)
    best = ((x - c[guess]) ** 2).sum(1)
    compared += len(x) * max(0, width - STEP)
    row, k = np.nonzero(partial <= best[:, None])
    d = partial[row, k]
    for at in range(STEP, width, STEP):
        d = d + ((x[row, at : at + STEP] - c[k, at : at + STEP]) ** 2).sum(1)
        compared += len(row) * (min(at + STEP, width) - at)
        left = d <= best[row]
        row, k, d = row[left], k[left], d[left]
    # survivors are sorted by row, then by centroid: the first of the smallest distance counts
    first = np.lexsort((k, d, row))
    first = first[np.r_[True, row[first][1:] != row[first][:-1]]] if len(first) else first
    return k[first], d[first], compared


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def sums(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, componentwise sum) of each cluster that is nearest to some vector."""
    spark, width = vectors.sparkSession, centroids.shape[1]
    shared = spark.sparkContext.broadcast((centroids, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, by = shared.value
        count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column("vec").slice(at, ROWS)).astype(np.int64)
                k, _, _ = nearest(x, c, by)
                count += np.bincount(k, minlength=len(c))
                np.add.at(total, k, x)
        used = np.flatnonzero(count)
        names = ["cluster", "n", *(f"s{d}" for d in range(c.shape[1]))]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, d]) for d in range(c.shape[1]))], names=names)

    parts = vectors.mapInArrow(run, "cluster long, n long, " + ", ".join(f"s{d} long" for d in range(width)))
    # decimals: sums over any number of rows stay exact
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{d}").cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]).collect()
    return [(int(r["cluster"]), int(r["n"]), [int(r[f"s{d}"]) for d in range(width)]) for r in rows]


def by_variance(vectors: DataFrame) -> np.ndarray:
    """Dimensions in falling order of their variance over all vectors; equal ones in their own order."""
    row = vectors.agg(*[F.var_pop(F.get("vec", F.lit(d))) for d in range(DIMENSIONS)]).first()
    return np.argsort(-np.array(row, float), kind="stable")


def start(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes, in ascending order of hash; equal ids by their components. Rows of a null vec_id have no hash."""
    hashed = vectors.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256))
    return np.array([r["vec"] for r in hashed.orderBy("hash", "vec").limit(k).collect()], np.int64).reshape(-1, DIMENSIONS)


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after ``rounds`` rounds (fewer, where a round changes none), and the order of the dimensions."""
    centroids = start(vectors, k)
    if not len(centroids):
        return centroids, np.arange(DIMENSIONS)
    order = by_variance(vectors)
    for _ in range(rounds):
        new = centroids.copy()
        for cluster, n, total in sums(vectors, centroids, order):
            new[cluster] = [s // n for s in total]
        if (new == centroids).all():
            break
        centroids = new
    return centroids, order


def assign(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                k, d, _ = nearest(matrix(part.column("vec")), *shared.value)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(k.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Every vector with its cluster, squared distance, the inertia of its cluster and of all, and the digest of its final centroid.

    Vectors that are null, of another length, or that hold null or non-finite components or whole ones of ``LARGEST`` or more take no part. Repeated rows are vectors of
    their own; rows of a null vec_id are assigned and averaged like others but never start as centroids. With fewer than ``k`` vectors each starts as a
    centroid. Ties go to the smaller centroid. An inertia beyond 64 bits is null. Other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = stored(quantised(embeddings), "centroids-vectors")
    centroids, order = fit(vectors, k, rounds)
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    assigned = stored(assign(vectors, centroids, order), "centroids-assigned")
    per = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return assigned.select(
        "vec_id", "cluster", "distance",
        own([fits(per.get(c, 0)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(fits(sum(per.values()))).cast("long").alias("inertia"),
        own(digest, "string").alias("centroid_sha256"),
    )


def _oracle() -> str:
    """The same result in SQL, for the registered query; vec_id is unique there."""
    near = """a{0} as materialized (
  select vec_id, any_value(vec) as vec, arg_min(number, (d, number)) as cluster, min(d) as distance from (
    select v.vec_id, v.vec, c.number, cast(list_sum(list_transform(list_zip(v.vec, c.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v cross join c{0} c
  ) group by vec_id
)"""
    move = """c{1} as materialized (
  select c.number, coalesce(m.vec, c.vec) as vec from c{0} c left join (
    select cluster, list(cast(floor_of as bigint) order by i) as vec from (
      select cluster, i, (s - ((s % n) + n) % n) // n as floor_of from (
        select cluster, i, sum(cast(vec[i] as hugeint)) as s, count(*) as n from a{0}, range(1, 65) r(i) group by cluster, i
      )
    ) group by cluster
  ) m on m.cluster = c.number
)"""
    steps = [x for k in range(ROUNDS) for x in (near.format(k), move.format(k, k + 1))] + [near.format(ROUNDS)]
    return (
        f"""with v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as vec from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x) or abs({SCALE} * cast(x as double)) >= {LARGEST})) = 0
), c0 as materialized (
  select cast(row_number() over (order by hash) - 1 as integer) as number, vec from (select sha256('{SALT}' || vec_id) as hash, vec from v order by hash limit {CLUSTERS})
), """
        + ", ".join(steps)
        + f"""
select a.vec_id, a.cluster, a.distance, cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.distance) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c.vec, lambda x: cast(x as varchar)), ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on c.number = a.cluster"""
    )


ORACLE = _oracle()
