"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are the byte n-grams (2 to 5 bytes of UTF-8) of its words, with a space at each end, hashed to
2^16 buckets. Their embeddings are averaged and go through a linear softmax; both are trained by stochastic gradient descent in
numpy on a bounded sample of the labelled rows. Prediction folds embeddings and softmax into one table of logits a bucket, so
whole texts of any length are scored by table look-ups. Temperature and the rejection threshold are calibrated on sample rows that training didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, utf8_parts

BUCKETS = 1 << 16
DIMENSIONS = 16
SIZES = (2, 3, 4, 5)
#: Labelled rows that training takes, in expectation; whole texts.
MAX_TRAIN = 2000
EPOCHS = 6
#: Share of calibration texts that rejection may lose.
REJECTED_SHARE = 0.01
UNKNOWN = "und"

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[[b for b in range(128) if not (97 <= _CLEAN[b] <= 122)]] = 32


@dataclass
class Model:
    languages: list[str]
    #: Logits of each bucket, and of one more bucket that stands for no feature.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def features(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text begins in its slice's cleaned bytes, and for each n-gram size the bucket of the n-gram at each byte.

    Bytes at which no n-gram begins have bucket ``BUCKETS``.
    """
    raw, offsets = utf8_parts(column)
    n = len(offsets) - 1
    # a space before each text and after the last; runs of spaces become one
    data = np.full(len(raw) + n + 1, 32, np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    data[at] = _CLEAN[raw]
    starts = offsets[:-1] + np.arange(n)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[starts] = True
    new_starts = np.cumsum(keep)[starts] - 1
    data = data[keep].astype(np.uint32)
    space = data == 32
    found = []
    for size in SIZES:
        bucket = np.full(len(data), BUCKETS, np.int32)
        m = len(data) - size + 1
        if m > 0:
            h = np.full(m, size, np.uint32)
            good = ~(space[:m] & space[1 : 1 + m]) if size == 2 else np.ones(m, bool)
            for k in range(size):
                h = (h ^ data[k : k + m]) * np.uint32(0x01000193)
                if 0 < k < size - 1:
                    good &= ~space[k : k + m]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            bucket[:m] = np.where(good, (h >> np.uint32(16)).astype(np.int32), BUCKETS)
        found.append(bucket)
    return new_starts, found


def bags(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, and each text's distinct buckets with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                starts, found = features(part.column("text"))
                ends = np.r_[starts[1:], len(found[0])]
                bucket, count = [], []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    u, c = np.unique(np.concatenate([f[a:b] for f in found]), return_counts=True)
                    bucket.append(u[u < BUCKETS])
                    count.append(c[u < BUCKETS])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(bucket, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], names=[*keep, "bucket", "count"])

    bounded_batches(docs.sparkSession)
    types = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keep), "bucket array<int>", "count array<int>"]))


def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of ``n`` rows, by a hash of doc_id, the same at every run."""
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def train(docs: DataFrame, learnable: Column, max_train: int = MAX_TRAIN, seed: int = 7) -> Model:
    """Fit on at most about ``max_train`` rows that are ``learnable`` and have a text and a language."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    n = rows.select("doc_id").count()
    sample = bags(sampled(rows, n, max_train), ["doc_id", "lang"]).toArrow().to_pandas() if n else None
    if sample is None or not len(sample):
        return Model([], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(1), 1.0, 0.0)
    sample = sample[sample["bucket"].map(len) > 0].sort_values(["doc_id", "lang"], kind="stable")
    languages = sorted(sample["lang"].unique())
    label = sample["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    bucket = list(sample["bucket"])
    weight = [c / c.sum() for c in sample["count"]]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(label))
    held = order[: len(order) // 5]
    used = order[len(order) // 5 :]
    e = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, len(languages)), np.float32)
    b = np.zeros(len(languages), np.float32)
    total, step = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            rate = 0.5 * (1 - step / total)
            step += 1
            h = weight[i] @ e[bucket[i]]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            b -= rate * p
            # texts of many n-grams touch each embedding a little; the factor makes up for it
            e[bucket[i]] -= (rate * 50) * np.outer(weight[i], back)
    table = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    table[:-1] = e @ w
    logits = np.array([weight[i] @ table[bucket[i]] + b for i in held]).reshape(len(held), len(languages))
    temperature, threshold = calibrate(logits, label[held])
    return Model(languages, table, b, temperature, threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def calibrate(logits: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The temperature of the least log loss, and the probability below which the least certain texts are rejected."""
    if not len(label):
        return 1.0, 0.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(10), 60))
    loss = [-np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    return t, float(np.quantile(softmax(logits / t).max(1), REJECTED_SHARE, method="lower"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row, from whole texts alone.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter. ``score`` is the calibrated probability of
    ``lang_pred``; ``rejected`` marks texts less certain than the calibrated threshold, and all that are ``und``. Ties between languages go
    to the first by name. Rows that repeat are scored alike; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, object)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                letters = has_letter(part.column("text"))
                lang, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
                if len(names) and letters.any():
                    starts, found = features(part.column("text"))
                    total = sum(np.add.reduceat(m.table[f], starts, axis=0, dtype=np.float64) for f in found)
                    seen = sum(np.add.reduceat(f < BUCKETS, starts, dtype=np.int64) for f in found)
                    p = softmax((total / np.maximum(seen, 1)[:, None] + m.bias) / m.temperature)
                    best = p.argmax(1)
                    top = p[np.arange(n), best]
                    lang = np.where(letters, names[best], UNKNOWN)
                    score = np.where(letters, top, 0.0)
                    rejected = ~letters | (top < m.threshold)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script; nulls hold none."""
    raw, offsets = utf8_parts(column)
    ascii_letter = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_CLEAN[raw] - np.uint8(97) < 26, out=ascii_letter[1:])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(c.isalpha() for c in column[i].as_py() or "")
    return found
