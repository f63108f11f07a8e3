"""Flush generations: how a log falls into sorted runs by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sum_before_numbered

#: Bytes of an entry besides key and value (a documented assumption; only the cuts depend on it).
OVERHEAD = 97


def with_bytes(log: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    return log.withColumn("bytes", (F.octet_length("key") + F.octet_length("value") + F.lit(overhead)).cast("long"))


def generations(log: DataFrame, budget: int = 65_536, overhead: int = OVERHEAD, stretch: int = 4096) -> DataFrame:
    """``log`` with ``generation``: bytes before the row, in seq order, over the budget.  Cuts stand where a sum without
    resets puts them, up to a row away from those of a buffer that starts anew."""
    placed = sum_before_numbered(with_bytes(log, overhead), "bytes", "_before_it", "seq", stretch)
    return placed.withColumn("generation", F.floor(F.col("_before_it") / F.lit(float(budget))).cast("long")).drop("_before_it")


def file_meta(log: DataFrame, budget: int = 65_536) -> DataFrame:
    """The level-0 file that each generation would be."""
    return (
        generations(log, budget)
        .groupBy("generation")
        .agg(F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.count("*").alias("entries"), F.sum("bytes").alias("file_size"), F.max("seq").alias("last_seq"))
        .select((F.col("generation") * 0).alias("level"), (F.col("generation") + 1).alias("number"), "file_size", "smallest_key", "largest_key", "entries", "last_seq")
    )
