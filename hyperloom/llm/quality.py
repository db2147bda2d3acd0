"""Document quality by random-indexing word vectors, pooled, and a two-layer network.

Every word hash has a fixed sparse random index vector. A word's vector is the sum of the index vectors of its neighbours over the sample's
texts, so words of like company have like vectors. Two views of a text are pooled: its words (lower case, letters and digits) and their shapes
(case, marks around them, whether a word repeats the one before). The pooled vectors go through a two-layer
numpy network whose probabilities are temperature-calibrated on sample rows that training didn't see.

Vectors and network are fitted on a bounded sample of labelled rows; scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices
from .langid import sampled

SLOTS = 1 << 14
DIMENSIONS, NONZERO = 48, 6
WINDOW = 2
HIDDEN = 24
#: Labelled rows that the fit takes, in expectation; whole texts.
MAX_TRAIN = 3000
EPOCHS = 40
THRESHOLD = 0.3

_WORD = re.compile(r"\w")


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    base: float


def index_vectors(seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((SLOTS, DIMENSIONS), np.float32)
    at = rng.integers(0, DIMENSIONS, (SLOTS, NONZERO))
    np.put_along_axis(out, at, rng.choice([-1.0, 1.0], (SLOTS, NONZERO)).astype(np.float32), 1)
    return out


def edges(token: str) -> tuple[str, str, str]:
    """What stands before a token's first letter, digit or underscore, from it to the last one, and after that; marks alone are all before."""
    if token.isalnum():
        return "", token, ""
    first = _WORD.search(token)
    if not first:
        return token, "", ""
    begin, end = first.start(), len(token) - _WORD.search(token[::-1]).start()
    return token[:begin], token[begin:end], token[end:]


def shape(token: str) -> str:
    """Marks before and after, and the case of what is between: ``THE!!`` is ``A!!``."""
    before, core, after = edges(token)
    case = "0" if any(c.isdigit() for c in core) else "" if not core else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa"
    return f"{before[:4]}{case}{after[:4]}"


class Slots:
    """Token to (word slot, shape slot), remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, tuple[int, int]] = {}
        self.most = most

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or "").split()
        known = self.known
        if len(known) > self.most:
            known.clear()
        for t in set(tokens).difference(known):
            core = edges(t)[1]
            known[t] = (zlib.crc32(core.lower().encode()) % SLOTS, zlib.crc32(shape(t).encode()) % (SLOTS - 1))
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        pairs = np.fromiter((x for t in tokens for x in known[t]), np.int32, 2 * len(tokens)).reshape(-1, 2)
        words, shapes = pairs[:, 0], pairs[:, 1].copy()
        shapes[1:][words[1:] == words[:-1]] = SLOTS - 1  # a word said again
        return words, shapes


def pooled(words: np.ndarray, shapes: np.ndarray, model_words: np.ndarray, model_shapes: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector, and three counts that say how much was pooled."""
    n = len(words)
    if not n:
        return np.zeros(2 * DIMENSIONS + 3, np.float32)
    used, times = np.unique(words, return_counts=True)
    ws = times @ model_words[used] / n
    used_shapes, shape_times = np.unique(shapes, return_counts=True)
    ss = shape_times @ model_shapes[used_shapes] / n
    return np.concatenate([ws, ss, [np.log1p(n), len(used) / n, (times.astype(float) ** 2).sum() / n**2]]).astype(np.float32)


def neighbours(sequences: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Word vectors: sums of neighbours' index vectors, damped and of unit length; slots never seen keep their index vector."""
    out = np.zeros_like(index)
    for s in sequences:
        for k in range(1, WINDOW + 1):
            if len(s) > k:
                np.add.at(out, s[k:], index[s[:-k]])
                np.add.at(out, s[:-k], index[s[k:]])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    unit = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
    return np.where(length > 0, out / np.maximum(length, 1e-9), unit).astype(np.float32)


def forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.maximum(x @ w1 + b1, 0)
    return h, h @ w2 + b2[0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, max_train: int = MAX_TRAIN, seed: int = 11) -> Model:
    """Fit on at most about ``max_train`` labelled rows that are ``learnable``. Labels that disagree on a doc_id count as 1."""
    quality = labels.where(F.col("quality").isNotNull() & learnable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n = quality.count()
    index = index_vectors()
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = sampled(texts, n, max_train).join(sampled(quality, n, max_train), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            both = [slots.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([w for w, _ in both], pa.list_(pa.int32())), pa.array([s for _, s in both], pa.list_(pa.int32()))], names=["doc_id", "quality", "words", "shapes"])

    bounded_batches(docs.sparkSession)
    sample = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, words array<int>, shapes array<int>").toArrow().to_pandas() if n else None
    size = 2 * DIMENSIONS + 3
    if sample is None or not len(sample):
        return Model(index, index, np.zeros(size), np.ones(size), [np.zeros((size, 1)), np.zeros(1), np.zeros(1), np.zeros(1)], 1.0, 0.5)
    sample = sample.sort_values("doc_id", kind="stable")
    words, shapes = list(sample["words"]), list(sample["shapes"])
    model_words, model_shapes = neighbours(words, index), neighbours(shapes, index)
    model_shapes[SLOTS - 1] = index[SLOTS - 1] / max(1e-9, float(np.linalg.norm(index[SLOTS - 1])))
    x = np.array([pooled(w, s, model_words, model_shapes) for w, s in zip(words, shapes)])
    y = (sample["quality"].to_numpy() > 0).astype(float)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    center, scale = x[used].mean(0), x[used].std(0) + 1e-3
    x = (x - center) / scale
    layers = [rng.normal(0, np.sqrt(2 / size), (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    first = [np.zeros_like(a) for a in layers]
    second = [np.zeros_like(a) for a in layers]
    step = 0
    for epoch in range(EPOCHS):
        for i in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            step += 1
            h, z = forward(x[i], layers)
            d = (sigmoid(z) - y[i]) / len(i)
            dh = np.outer(d, layers[2]) * (h > 0)
            for a, g, m, v in zip(layers, [x[i].T @ dh + 1e-4 * layers[0], dh.sum(0), h.T @ d, np.array([d.sum()])], first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z, truth = (forward(x[held], layers)[1], y[held]) if len(held) else (np.zeros(1), np.ones(1))
    grid = np.exp(np.linspace(np.log(0.3), np.log(8), 50))
    loss = [-(truth * np.log(sigmoid(z / t) + 1e-9) + (1 - truth) * np.log(1 - sigmoid(z / t) + 1e-9)).mean() for t in grid]
    return Model(model_words, model_shapes, center, scale, layers, float(grid[int(np.argmin(loss))]), float(y.mean()))


def scores(texts: list[str | None], slots: Slots, m: Model) -> np.ndarray:
    both = [slots.of(t) for t in texts]
    x = (np.array([pooled(w, s, m.words, m.shapes) for w, s in both]).reshape(len(both), -1) - m.center) / m.scale
    p = sigmoid(forward(x, m.layers)[1] / m.temperature)
    return np.where([len(w) > 0 for w, _ in both], p, m.base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row: the calibrated probability that the text is good, from the text alone.

    Null and empty texts, and texts of white space, score the sample's share of good rows. Rows that repeat score alike; other
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slots = Slots()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                p = scores(part.column("text").to_pylist(), slots, m)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns as they are; no shuffle.

    Null and empty texts score the sample's share of good rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slots = Slots()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield part.filter(pa.array(scores(part.column("text").to_pylist(), slots, m) >= threshold))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
