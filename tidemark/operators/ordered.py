"""Totals along an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import checkpointed


def dealt_by_range(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` sorted into parts by range, with ``_part``.  Written once: bounds come from a sample, and every reader of
    the parts has to see the same ones."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def sum_before(rows: DataFrame, value: str, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all rows before.  Only a row a part meets in one task."""
    placed = dealt_by_range(rows, *order)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.withColumn("_inside", inside).join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def sum_before_numbered(rows: DataFrame, value: str, name: str, number: str, stretch: int = 4096) -> DataFrame:
    """The same along a unique whole number: totals of stretches of it, of stretches of those, and of these.  A window holds
    at most ``stretch`` rows, the last one a row for each ``stretch ** 2`` numbers."""
    one, two = F.floor(F.col(number) / stretch), F.floor(F.col("_one") / stretch)
    placed = rows.withColumn("_one", one)
    small = placed.groupBy("_one").agg(F.sum(value).alias("_sum")).withColumn("_two", two)
    large = small.groupBy("_two").agg(F.sum("_sum").alias("_sum"))

    def upto(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    large = large.select("_two", upto("_sum", Window.orderBy("_two")).alias("_before_two"))
    small = small.select("_one", "_two", upto("_sum", Window.partitionBy("_two").orderBy("_one")).alias("_before_one")).join(large, "_two")
    small = small.select("_one", (F.col("_before_one") + F.col("_before_two")).alias("_before"))
    inside = placed.withColumn("_inside", upto(value, Window.partitionBy("_one").orderBy(number)))
    return inside.join(small, "_one").withColumn(name, F.col("_before") + F.col("_inside")).drop("_one", "_inside", "_before")
