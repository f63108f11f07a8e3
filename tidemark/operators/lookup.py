"""Point and bulk lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import latest

#: Keys up to this number are broadcast to the log's scan; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Keys up to this number are pushed down to a store's files one by one.
PUSHED_KEYS = 10


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """One row, or none for absent and deleted keys."""
    return latest(log.where(F.col("key") == F.lit(key)), as_of).select("key", "value")


def _asked(keys: DataFrame, n: int | None) -> tuple[DataFrame, bool]:
    asked = keys.select("key").distinct()
    return asked, (asked.count() if n is None else n) <= BROADCAST_KEYS


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None, n: int | None = None) -> DataFrame:
    """``(key, value)`` for every different key of ``keys``; value is null where it is absent or deleted.  The log is cut
    to the keys before it is resolved.  ``n``: number of keys, if known."""
    asked, few = _asked(keys, n)
    cut = log.join(F.broadcast(asked) if few else asked, "key", "left_semi")
    return asked.join(latest(cut, as_of).select("key", "value"), "key", "left")


def contains(log: DataFrame, keys: DataFrame, as_of: int | None = None, n: int | None = None) -> DataFrame:
    """The keys that are live."""
    asked, few = _asked(keys, n)
    return latest(log.join(F.broadcast(asked) if few else asked, "key", "left_semi"), as_of).select("key")


def absent(log: DataFrame, keys: DataFrame, as_of: int | None = None, n: int | None = None) -> DataFrame:
    """The keys that aren't."""
    return keys.select("key").distinct().join(contains(log, keys, as_of, n), "key", "left_anti")
