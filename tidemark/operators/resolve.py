"""Version resolution: the newest visible version of each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETION, VALUE
from .ordered import dealt_by_range

#: Sorts a read after the versions of its own number.
_READ = 2


def visible(log: DataFrame, as_of: int | None) -> DataFrame:
    """Versions with seq <= ``as_of``.  Stands below any ranking."""
    return log if as_of is None else log.where(F.col("seq") <= as_of)


def newest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """One row a key: its newest visible version, deletions included.  Equal (key, seq) come from a replayed log and are
    equal, or else the put wins.  A task keeps one row a key before the shuffle, so a hot key costs no more."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("type")))
    return visible(log, as_of).withColumn("_place", place).where("_place = 1").drop("_place")


def latest(log: DataFrame, as_of: int | None = None, keep_tombstones: bool = False) -> DataFrame:
    """Live keys with seq, type and value.  The deletion filter stands above the ranking: below it, deleted keys would
    come back."""
    top = newest(log, as_of)
    return top if keep_tombstones else top.where(F.col("type") != DELETION)


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """What users see: key and value."""
    return latest(log, as_of).select("key", "value")


def tiers(*logs: DataFrame) -> DataFrame:
    """Union of tiers; their split and order never change what resolution gives."""
    return reduce(DataFrame.unionByName, logs)


def internal_order(log: DataFrame) -> DataFrame:
    """Key up, seq down, type down."""
    return log.orderBy(F.asc("key"), F.desc("seq"), F.desc("type"))


def as_of_each(log: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads(key, as_of)`` answered each at its own sequence number: ``(key, as_of, value)``, live ones only.

    Versions and reads are sorted together by key and number and dealt out by range, so a key with many of either spreads over
    parts; a read takes the last version before it in its part, else the last of its key in the parts before, of which
    only one row a part is kept."""
    asked = reads.select("key", F.col("as_of").cast("long").alias("seq")).distinct()
    version = F.struct("key", "type", "value")
    both = log.select("key", F.col("seq").cast("long").alias("seq"), F.col("type").cast("int").alias("kind"), version.alias("version"))
    both = both.unionByName(asked.withColumns({"kind": F.lit(_READ), "version": F.lit(None).cast(both.schema["version"].dataType)}))
    placed = dealt_by_range(both, "key", "seq", "kind")
    upto = Window.partitionBy("_part", "key").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.last("version", ignorenulls=True).over(upto)).where(F.col("kind") == _READ)
    ends = placed.groupBy("_part").agg(F.max_by("version", F.when(F.col("version").isNotNull(), F.struct("key", "seq", "kind"))).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    ends = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_end"))
    found = own.join(F.broadcast(ends), "_part")
    found = found.withColumn("_it", F.coalesce("_own", F.when(F.col("_end.key") == F.col("key"), F.col("_end"))))
    return found.where(F.col("_it.type") == VALUE).select("key", F.col("seq").alias("as_of"), F.col("_it.value").alias("value"))


def duplicate_versions(log: DataFrame) -> DataFrame:
    """(key, seq) pairs that occur with different contents, which a log mustn't have."""
    return log.groupBy("key", "seq").agg(F.countDistinct(F.struct("type", F.coalesce(F.col("value").cast("binary"), F.lit(b"")))).alias("versions")).where("versions > 1")
