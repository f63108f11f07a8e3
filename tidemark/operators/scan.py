"""Ordered reads of a resolved log.  ``rows`` are live (key, value) rows; bounds reach the scan through resolution,
because key is what it partitions by."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import in_prefix
from .ordered import dealt_by_range


def between(rows: DataFrame, low=None, high=None) -> DataFrame:
    """Keys in [low, high); None leaves a side open."""
    if low is not None:
        rows = rows.where(F.col("key") >= F.lit(low))
    return rows if high is None else rows.where(F.col("key") < F.lit(high))


def prefixed(rows: DataFrame, prefix) -> DataFrame:
    return rows.where(in_prefix(F.col("key"), prefix))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("key")


def first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("key").limit(1)


def last(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("key")).limit(1)


def seek(rows: DataFrame, target) -> DataFrame:
    """The least key >= target."""
    return first(between(rows, target))


def after(rows: DataFrame, key) -> DataFrame:
    return first(rows.where(F.col("key") > F.lit(key)))


def before(rows: DataFrame, key) -> DataFrame:
    return last(rows.where(F.col("key") < F.lit(key)))


def bounded(rows: DataFrame, target, n: int) -> DataFrame:
    """At most n rows from target on."""
    return between(rows, target).orderBy("key").limit(n)


def totals(rows: DataFrame) -> DataFrame:
    """Number of entries, and bytes of keys and values."""
    return rows.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.octet_length("key").cast("long")), F.lit(0)).alias("key_bytes"),
        F.coalesce(F.sum(F.octet_length("value").cast("long")), F.lit(0)).alias("value_bytes"),
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """Every key with the keys before and after it.  Keys are dealt out by range, neighbours come from within a part,
    and only each part's first and last key meet in one place; no task sees all keys."""
    dealt = dealt_by_range(rows.select("key"), "key")
    own = Window.partitionBy("_part").orderBy("key")
    near = dealt.select("key", "_part", F.lag("key").over(own).alias("previous_key"), F.lead("key").over(own).alias("next_key"))
    edges = near.groupBy("_part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    whole = Window.orderBy("_part")  # one row a part
    edges = edges.select("_part", F.lag("high").over(whole).alias("_high"), F.lead("low").over(whole).alias("_low"))
    joined = near.join(F.broadcast(edges), "_part")
    return joined.select("key", F.coalesce("previous_key", "_high").alias("previous_key"), F.coalesce("next_key", "_low").alias("next_key"))
