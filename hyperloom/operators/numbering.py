"""Row numbers over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their places (from 1) within each group of ``by`` in the order of ``order``, which should leave no ties.

    Rows are dealt to ranges of (``by``, ``order``) and numbered within a range; a range's first number comes from the counts of those before it, a row a group and range. So no group meets in one task.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written at once: ranges are drawn from a sample and would differ the next time
    dealt = stored(rows.repartitionByRange(ranges, *by, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    firsts = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    return dealt.withColumn(name, place).join(firsts, [*by, "__range"]).withColumn(name, F.col("__before") + F.col(name)).select(*rows.columns, name)
