"""Joins by the nearest value of an ordered column, with tables of any size on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

DIRECTIONS = ("nearest", "backward", "forward")


def _ordered(df: DataFrame, column: str) -> Column:
    """The column as a number; null where it is null or NaN."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(column).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("long")
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c), c)


def nearest_join(left: DataFrame, right: DataFrame, on: str, keep: list[str], by: list[str] | None = None, direction: str = "nearest") -> DataFrame:
    """Every row of ``left`` with the columns ``keep`` of the row of ``right`` whose ``on`` is nearest to its own among those of equal ``by``, and their ``distance``.

    Ties go to the lowest ``on``, then to the smallest values of ``keep``. ``backward`` takes the last one up to the row, ``forward`` the first one from it on (as-of joins). Rows without
    any match, or whose ``on`` or ``by`` is null or NaN, have nulls. ``on`` is of one type on both sides: a number, a date or a timestamp (distances in days or microseconds).

    Both sides' distinct values are dealt to ranges by (``by``, ``on``), so a key with most of the rows is spread. Each range gets the last value before it and the first one after it from a summary of a
    row a key and range, and is then read once in each order.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    by = by or []
    clash = {*keep, "distance"} & {*left.columns}
    if clash:
        raise ValueError(f"columns of these names on the left: {sorted(clash)}")
    place = [*by, "__x"]
    known = lambda df: df.withColumn("__x", _ordered(df, on)).dropna(subset=place)
    one = known(right).groupBy(*place).agg(F.min(F.struct(*keep)).alias("__r"))
    one = one.select(*place, F.struct(F.col("__x").alias("x"), F.col("__r").alias("r")).alias("__v"))
    asked = known(left).select(*place).distinct()
    both = one.unionByName(asked, allowMissingColumns=True)
    ranges = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written at once: ranges are drawn from a sample and would differ the next time
    dealt = stored(both.repartitionByRange(ranges, *place).withColumn("__range", F.spark_partition_id()), "nearest")

    ends = dealt.groupBy(*by, "__range").agg(F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    rows = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*by).orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select(*by, "__range", F.last("__most", True).over(rows).alias("__before"), F.last("__least", True).over(back).alias("__after"))
    edge = edges.select(*by, "__range", F.explode(F.array("__before", "__after")).alias("__v")).where("__v is not null")
    inside = dealt.unionByName(edge.withColumn("__x", F.col("__v.x")))

    has = F.col("__v").isNotNull()
    within = [*by, "__range"]
    up = Window.partitionBy(*within).orderBy("__x", has.desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*within).orderBy(F.col("__x").desc(), has.desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("__lo", F.last("__v", True).over(up)).withColumn("__hi", F.last("__v", True).over(down)).where(~has)
    nearer = F.col("__hi.x").isNull() | (F.col("__x") - F.col("__lo.x") <= F.col("__hi.x") - F.col("__x"))
    pick = {"nearest": F.when(F.col("__lo.x").isNotNull() & nearer, F.col("__lo")).otherwise(F.col("__hi")), "backward": F.col("__lo"), "forward": F.col("__hi")}[direction]
    found = found.select(*place, pick.alias("__p"))
    out = left.withColumn("__x", _ordered(left, on)).join(found, place, "left")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("__p.r")[k].alias(k) for k in keep], F.abs(F.col("__x") - F.col("__p.x")).alias("distance"))
