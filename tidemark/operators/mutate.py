"""Mutation logs from rows: puts, deletions, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELETION, VALUE
from ..sources.files import checkpointed


def puts(rows: DataFrame) -> DataFrame:
    """``(key, seq, value)`` as put mutations; a null value counts as empty, which is a live value."""
    return rows.select("key", "seq", F.lit(VALUE).cast("tinyint").alias("type"), F.coalesce("value", F.lit("").cast(rows.schema["value"].dataType)).alias("value"))


def deletions(rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``(key, seq)`` as deletions; they carry the empty value, and need no live key."""
    kind = like.schema["value"].dataType if like is not None else rows.schema["key"].dataType
    return rows.select("key", "seq", F.lit(DELETION).cast("tinyint").alias("type"), F.lit("").cast(kind).alias("value"))


def numbered(rows: DataFrame, base: int, *order: Column | str) -> DataFrame:
    """``rows`` with ``seq`` from ``base`` + 1 on, in ``order``; rows that tie come by their hash, so that a coarse order doesn't
    put them all into one part.  Rows are dealt out by range and sorted; only the number
    of rows in each part reaches the driver.  The sorted rows are checkpointed, so that both passes see the same."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (*order, F.xxhash64(*rows.columns))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    starts, total = [], base + 1
    for p, size in sizes:
        starts.append((p, total))
        total += size
    offset = F.lit(base + 1)
    if starts:
        offset = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(p).cast("bigint"), F.lit(s).cast("bigint")) for p, s in starts])), part)
    return placed.withColumn("seq", offset + place).drop("_id")
