"""Validity, let-binding and nearest-rank selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def is_valid(v: Column, infinite: bool = False) -> Column:
    """Neither NaN nor, unless ``infinite``, an infinity; null counts as invalid."""
    ok = v.isNotNull() & ~F.isnan(v)
    return ok if infinite else ok & (F.abs(v) < float("inf"))


def valid(v: Column, infinite: bool = False) -> Column:
    """``v`` as a double, or null where it is invalid, so that aggregates skip it."""
    return F.when(is_valid(v, infinite), v.cast("double"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, also where lambdas in ``use`` refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def to_long(pixels: DataFrame, *keep: str) -> DataFrame:
    """One row a cell: cube_id, band, line, sample, value and the ``keep`` columns."""
    return pixels.select("cube_id", "line", "sample", *keep, F.posexplode("spectrum").alias("band", "value"))


def rank_index(n: Column, percent: float, convention: str = "plain") -> Column:
    """Zero-based rank of a percentile among n sorted values: int(n * p / 100), clamped.

    ``render_high`` is one lower: int(n * p / 100) - 1.
    """
    k = F.floor(n * F.lit(percent) / 100).cast("long")
    if convention == "render_high":
        k = k - 1
    return F.greatest(F.lit(0), F.least(k, n - 1))


#: Rank error of the brackets in which exact ranks are looked for.
_BRACKET = 0.002


def nearest_rank(rows: DataFrame, keys: list[str], value: str, wanted: list[tuple[str, float, str]]) -> DataFrame:
    """``keys`` and one exact order statistic a column: (name, percent, convention) of ``wanted``; null values are skipped.

    No group is ever sorted as a whole: one sketch brackets all ranks, a second pass counts what lies below each bracket without leaving code generation, and a third one
    orders the few values within the brackets alone. Where there are ``keys``, the brackets and counts (a row a group) are stored, so that Spark knows their size and rows of a large group don't
    move to meet them.
    """
    order = sorted(wanted, key=lambda w: w[1])
    at = range(len(order))
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    cuts = [c for _, p, _ in order for c in (max(0.0, p / 100 - _BRACKET), min(1.0, p / 100 + _BRACKET))]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("__v", cuts, int(2 / _BRACKET)).alias("__q"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    low = [F.col("__min") if cuts[2 * i] <= 0 else F.col("__q")[2 * i] for i in at]
    high = [F.col("__max") if cuts[2 * i + 1] >= 1 else F.col("__q")[2 * i + 1] for i in at]
    ends = [c.alias(f"__{n}{i}") for i in at for n, c in (("lo", low[i]), ("hi", high[i]))]
    known = (lambda some, name: stored(some, name)) if keys else (lambda some, name: some)
    brackets = known(sketch.select(*keys, *ends), "brackets")
    met = lambda some: rows.join(some, keys) if keys else rows.crossJoin(F.broadcast(some))  # noqa: E731  (a row a group)
    v = F.col("__v")
    below = [F.count(F.when(v < F.col(f"__lo{i}"), 1)).alias(f"__b{i}") for i in at]
    kept = [F.first(f"__{n}{i}").alias(f"__{n}{i}") for i in at for n in ("lo", "hi")]
    totals = known(met(brackets).groupBy(*keys).agg(F.count("*").alias("__n"), *below, *kept), "brackets-counted")
    inside = [v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}")) for i in at]
    near = met(totals).where(_any(inside))
    of = F.explode(F.filter(F.array(*[F.when(inside[i], F.lit(i)) for i in at]), lambda i: i.isNotNull()))
    pick = lambda f: F.element_at(F.array(*[f(i) for i in at]), F.col("__i") + 1)
    near = near.withColumn("__i", of).select(*keys, "__i", "__v", pick(lambda i: F.col(f"__b{i}")).alias("__b"), pick(lambda i: rank_index(F.col("__n"), *order[i][1:])).alias("__k"))
    counted = near.groupBy(*keys, "__i", "__v").agg(F.count("*").alias("__c"), F.first("__b").alias("__b"), F.first("__k").alias("__k"))
    place = Window.partitionBy(*keys, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.withColumn("__upto", F.sum("__c").over(place) + F.col("__b")).where("__upto > __k")
    picked = {name: F.min(F.when(F.col("__i") == i, v)).alias(name) for i, (name, _, _) in enumerate(order)}
    picked = [picked[name] for name, _, _ in wanted]
    return found.groupBy(*keys).agg(*picked) if keys else found.agg(*picked)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
