"""Principal components and PLS regression from distributed cross products; only band-by-band matrices reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .preprocess import doubles
from .roi import select_pixels
from .stats import cross_products, pixel_stats


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    #: Centred cross products.
    scatter: np.ndarray


def moments(pixels: DataFrame) -> Moments:
    """Count, mean and centred cross products of the rows without an invalid value, of all cubes together, in one pass; merged before they reach the driver."""
    found = cross_products(pixels.withColumn("cube_id", F.lit("all"))).first()
    if found is None or not found["n"]:
        raise ValueError("no valid rows")
    return _moments(found)


def _moments(found) -> Moments:
    mean = np.array(found["mean"])
    return Moments(found["n"], mean, np.array(found["scatter"]).reshape(len(mean), -1))


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    #: One column a component.
    loadings: np.ndarray
    explained: np.ndarray


def principal(pixels: DataFrame, k: int, compat: str | None = None) -> Components:
    """The k leading eigenvectors of the covariance (n - 1); signs make the largest loading positive.

    ``compat="jacobi100"`` stops a Jacobi solver after 100 rotations in all.
    """
    return components_of(moments(pixels), k, compat)


def components_of(m: Moments, k: int, compat: str | None = None) -> Components:
    if k > len(m.mean):
        raise ValueError("more components than bands")
    cov = m.scatter / max(1, m.n - 1)
    values, vectors = _jacobi(cov, 100) if compat == "jacobi100" else np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(len(order))] < 0, -1, 1)
    return Components(m.mean, vectors, values[order] / max(1e-300, values.sum()))


def _jacobi(a: np.ndarray, rotations: int, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    a, v = a.copy(), np.eye(len(a))
    for _ in range(rotations):
        off = np.abs(np.triu(a, 1))
        p, q = np.unravel_index(off.argmax(), off.shape)
        if off[p, q] < tolerance:
            break
        theta = 0.5 * np.arctan2(2 * a[p, q], a[q, q] - a[p, p])
        g = np.eye(len(a))
        g[p, p] = g[q, q] = np.cos(theta)
        g[p, q], g[q, p] = np.sin(theta), -np.sin(theta)
        a, v = g.T @ a @ g, v @ g
    return np.diag(a), v


def project(pixels: DataFrame, components: Components, centred: bool) -> DataFrame:
    """``scores array<double>`` beside the pixels' other columns; invalid cells count as 0 after centring."""
    mean = components.mean if centred else np.zeros_like(components.mean)
    names = [c for c in pixels.columns if c != "spectrum"]
    schema = pixels.select(*names, doubles().alias("scores")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("spectrum").flatten(), dtype=float).reshape(batch.num_rows, -1)
            t = np.where(np.isfinite(x), x - mean, 0) @ components.loadings
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, t.shape[1], dtype=np.int32)), pa.array(t.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), out], names=[*names, "scores"])

    return pixels.select(*names, doubles().alias("spectrum")).mapInArrow(run, schema)


def project_each(pixels: DataFrame, k: int, centred: bool = True) -> DataFrame:
    """``scores`` beside the pixels' other columns, by the k components of each pixel's own cube. Cubes without a valid pixel have no rows.

    Tasks fit a cube's components where its moments are merged; they meet its pixels by a join on cube_id, of a table that is stored first, so that it is broadcast if small.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["n"]:
                    c = components_of(_moments(r), k)
                    yield pa.RecordBatch.from_pydict({"cube_id": [r["cube_id"]], "__mean": [c.mean.tolist()], "__loadings": [c.loadings.T.ravel().tolist()]})

    fitted = stored(cross_products(pixels).mapInArrow(fit, "cube_id string, __mean array<double>, __loadings array<double>"), "components")
    names = [c for c in pixels.columns if c != "spectrum"]
    schema = pixels.select(*names, doubles().alias("scores")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column("cube_id").to_pylist(), object)
            for cube in dict.fromkeys(ids.tolist()):
                some = batch.filter(pa.array(ids == cube))
                x, mean, loadings = (np.asarray(some.column(c).slice(0, n).flatten(), dtype=float) for c, n in (("spectrum", len(some)), ("__mean", 1), ("__loadings", 1)))
                x = x.reshape(len(some), -1)
                t = np.where(np.isfinite(x), x - (mean if centred else 0), 0) @ loadings.reshape(k, -1).T
                out = pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, k, dtype=np.int32)), pa.array(t.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), out], names=[*names, "scores"])

    wide = pixels.select(*names, doubles().alias("spectrum")).join(fitted, "cube_id")
    return wide.select(*names, "spectrum", "__mean", "__loadings").mapInArrow(run, schema)


def refit_without(rows: DataFrame, outliers: list, k: int, key: str = "id") -> tuple[DataFrame, Components]:
    """The rows without the named samples, and components fitted again on what is left."""
    left = rows.where(~F.col(key).isin(outliers))
    return left, principal(left, k)


def scaled(scores: DataFrame, k: int) -> DataFrame:
    """Each component from 0 to 1 over all rows of its cube; a range under 1e-9 counts as 1."""
    ends = scores.groupBy("cube_id").agg(*[f(F.col("scores")[i]).alias(f"__{n}{i}") for i in range(k) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    one = lambda i: (F.col("scores")[i] - F.col(f"__lo{i}")) / F.when(F.col(f"__hi{i}") - F.col(f"__lo{i}") < 1e-9, F.lit(1.0)).otherwise(F.col(f"__hi{i}") - F.col(f"__lo{i}"))
    # of a known size: broadcast if small
    wide = scores.join(stored(ends, "ranges"), "cube_id")
    return wide.withColumn("scores", F.array(*[one(i) for i in range(k)])).select(*scores.columns)


def analysed(pixels: DataFrame, k: int = 10, mask: DataFrame | None = None) -> DataFrame:
    """``cube_id, line, sample, spectrum``: mean, min, max and range of each pixel, then k components fitted under the mask, not centred, scaled 0 to 1."""
    fit_on = select_pixels(pixels, mask)
    both = project(pixel_stats(pixels, "spectrum"), principal(fit_on, k), centred=False)
    return scaled(both, k).select("cube_id", "line", "sample", F.concat(F.array("mean", "min", "max", "range"), F.col("scores")).alias("spectrum"))


def pca_rgb(pixels: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """First three components, centred, each scaled to 0 ... 255, as r, g, b; fitted under the mask or on every fourth line and sample."""
    from ..functions.color import to_byte

    fit_on = pixels.where("line % 4 = 0 and sample % 4 = 0") if mask is None else select_pixels(pixels, mask)
    scores = scaled(project(pixels.select("cube_id", "line", "sample", "spectrum"), principal(fit_on, 3), centred=True), 3)
    return scores.select("cube_id", "line", "sample", *[to_byte(F.col("scores")[i]).alias(n) for i, n in enumerate("rgb")])


def nipals(rows: DataFrame, k: int = 3, iterations: int = 100, tolerance: float = 1e-6) -> Components:
    """Components by NIPALS, run on the cross products: loadings start from column 0's and are deflated in turn.

    Each iteration is the same as one over the scores: p becomes X'X p, and the score's squared length is p'X'X p.
    """
    m = moments(rows)
    s, total = m.scatter.copy(), np.trace(m.scatter)
    found, shares = [], []
    for _ in range(min(k, len(m.mean))):
        p, before = s[:, 0].copy(), 0.0
        if np.linalg.norm(p) < 1e-12:
            p = s[:, int(np.diag(s).argmax())].copy()
        if np.linalg.norm(p) < 1e-12:
            break
        p /= np.linalg.norm(p)
        for turn in range(iterations):
            tt = float(p @ s @ p)
            if abs(tt - before) < tolerance or turn + 1 == iterations:
                break
            before = tt
            p = s @ p
            p /= max(np.linalg.norm(p), 1e-300)
        tt = float(p @ s @ p)
        found.append(p)
        shares.append(tt / max(total, 1e-300))
        rest = np.eye(len(p)) - np.outer(p, p)
        s = rest @ s @ rest
    return Components(m.mean, np.array(found).T, np.array(shares))


@dataclass(frozen=True)
class Pls:
    coefficients: np.ndarray
    intercept: float
    r2: float = float("nan")
    rmse: float = float("nan")


def train_pls(rows: DataFrame, components: int, scale: bool = False) -> Pls:
    """PLS1 of ``y`` on ``spectrum`` from cross products (columns spectrum array, y double).

    Columns are centred, and with ``scale`` also divided by their sample deviation. Extraction stops where the covariance left
    is under 1e-10; R2 and RMSE are those of the rows without an invalid value, which train; no component at all, or as many components as rows or columns, is an error.
    """
    joint = rows.select(F.concat(doubles(), F.array(F.col("y").cast("double"))).alias("spectrum"), F.lit("all").alias("cube_id"))
    m = moments(joint)
    p = len(m.mean) - 1
    if components >= m.n or components >= p:
        raise ValueError("too many components for the rows and columns")
    xx, xy = m.scatter[:p, :p], m.scatter[:p, p].copy()
    unit = np.sqrt(np.diag(xx) / max(1, m.n - 1)) if scale else np.ones(p)
    unit = np.where(unit > 0, unit, 1.0)
    xx, xy = xx / np.outer(unit, unit), xy / unit
    rs: list[np.ndarray] = []
    ps: list[np.ndarray] = []
    b = np.zeros(p)
    for _ in range(components):
        size = np.linalg.norm(xy)
        if size < 1e-10:
            break
        w = xy / size
        r = w.copy()
        for pj, rj in zip(ps, rs):
            r -= (pj @ w) * rj
        tt = float(r @ xx @ r)
        if tt < 1e-10:
            break
        load, q = xx @ r / tt, float(r @ xy) / tt
        xy = xy - load * q * tt
        rs.append(r)
        ps.append(load)
        b += r * q
    if not rs:
        raise ValueError("no component could be extracted")
    b = b / unit
    # the fit's quality follows from the same moments
    sst = float(m.scatter[p, p])
    sse = max(0.0, sst - 2 * float(b @ m.scatter[:p, p]) + float(b @ m.scatter[:p, :p] @ b))
    return Pls(b, float(m.mean[p] - m.mean[:p] @ b), 1 - sse / sst if sst >= 1e-10 else 0.0, math.sqrt(sse / m.n))


def predict(pixels: DataFrame, model: Pls) -> DataFrame:
    """``prediction`` beside the columns of ``pixels``: intercept + sum of value * coefficient over the bands both have; invalid cells count as 0."""
    coef = F.array(*[F.lit(float(c)) for c in model.coefficients])
    n = F.least(F.size("spectrum"), F.lit(len(model.coefficients)))
    clean = F.transform(F.slice(doubles(), F.lit(1), n), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v))
    products = F.zip_with(clean, F.slice(coef, F.lit(1), n), lambda v, c: v * c)
    return pixels.withColumn("prediction", F.lit(model.intercept) + F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def spectral_angle(pixels: DataFrame, reference: list[float]) -> DataFrame:
    """``angle`` to a reference spectrum in radians; NaN where a band is NaN or the spectrum has no length. A reference without length is an error."""
    if float(np.linalg.norm(reference)) < 1e-10:
        raise ValueError("the reference spectrum has no length")
    ref = np.asarray(reference, dtype=float)
    names = [c for c in pixels.columns if c != "spectrum"]
    schema = pixels.select(*names, F.lit(0.0).alias("angle")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("spectrum").flatten(), dtype=float).reshape(batch.num_rows, -1)
            with np.errstate(divide="ignore", invalid="ignore"):
                angle = np.arccos(np.clip(x @ ref / (np.linalg.norm(x, axis=1) * np.linalg.norm(ref)), -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(angle, from_pandas=False)], names=[*names, "angle"])

    return pixels.select(*names, doubles().alias("spectrum")).mapInArrow(run, schema)


def pseudo_scatter(pixels: DataFrame) -> DataFrame:
    """Two cheap coordinates of a spectrum, not principal components: its mean, and the value at half its bands less that at a quarter."""
    s = doubles()
    n = F.size(s)
    half, quarter = ((n - n % k) / k for k in (2, 4))
    return pixels.select(
        "cube_id", "line", "sample", (F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n).alias("x"), (F.element_at(s, half.cast("int") + 1) - F.element_at(s, quarter.cast("int") + 1)).alias("y")
    )
