"""Leveled compaction: what to merge, and the merge."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sum_before
from ..operators.resolve import newest
from ..schema import DELETION, LEVELS
from .manifest import FileMeta, Version


#: Ranges up to this number are a condition; more are searched by bisection.
FEW_RANGES = 32
#: Files of a run up to this number have ``max_file_size``; a larger run has larger files, up to ``LARGE_FILE``, and only then more.
RUN_FILES = 256
LARGE_FILE = 128 << 20


def level_limit(level: int) -> int:
    """Bytes above which a level is merged down: 1, 4, 16, 64, 256 MB for levels 1 to 5."""
    return 1 << (20 + 2 * (level - 1))


@dataclass(frozen=True)
class Compaction:
    level: int
    inputs: tuple[FileMeta, ...]
    lower: tuple[FileMeta, ...]

    @property
    def files(self) -> tuple[FileMeta, ...]:
        return self.inputs + self.lower


def pick(version: Version, max_level0_files: int = 4) -> Compaction | None:
    """All of level 0 once it has enough runs, else the first file of the first level that is too large; with all files
    of the level below that overlap."""

    def made(level: int, inputs: list[FileMeta]) -> Compaction:
        low, high = min(f.smallest_key for f in inputs), max(f.largest_key for f in inputs)
        return Compaction(level, tuple(inputs), tuple(f for f in version.at(level + 1) if f.overlaps(low, high)))

    if version.runs(0) >= max_level0_files:
        return made(0, version.at(0))
    for level in range(1, LEVELS - 1):
        if version.level_bytes(level) > level_limit(level):
            return made(level, version.at(level)[:1])
    return None


def merged(rows: DataFrame, deeper: DataFrame | list[tuple[bytes, bytes]]) -> DataFrame:
    """The newest version of each key; a deletion goes only if no deeper file's range covers its key, since an older
    version could be in there.

    Ranges, a row a file, are what the store's manifest holds on the driver anyway; they are merged to disjoint ones, and each
    deletion's key finds its range by bisection.  Only keys of deletions leave the JVM for that.
    """
    top = newest(rows)
    if isinstance(deeper, DataFrame):
        deeper = [(r[0], r[1]) for r in deeper.select("smallest_key", "largest_key").distinct().collect()]
    joined: list[list] = []
    for low, high in sorted((_as_bytes(a), _as_bytes(b)) for a, b in deeper):
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    alive, key = F.col("type") != DELETION, F.col("key").cast("binary")
    if len(joined) <= FEW_RANGES:
        inside = F.lit(False)
        for low, high in joined:
            inside = inside | key.between(F.lit(low), F.lit(high))
        return top.where(alive | inside)
    lows, highs = [a for a, _ in joined], [b for _, b in joined]

    @F.pandas_udf("boolean")
    def covered(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: k is not None and (at := bisect_right(lows, bytes(k))) > 0 and bytes(k) <= highs[at - 1]).astype(bool)

    return top.withColumn("_covered", covered(F.when(~alive, key))).where(alive | F.col("_covered")).drop("_covered")


def _as_bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def run_files(total_bytes: int, max_file_size: int) -> int:
    """Files of a run.  Each costs a task, an open file and a line of the manifest whatever it holds, so their number doesn't
    follow the data while files are small."""
    size = max(max_file_size, min(-(-total_bytes // RUN_FILES), LARGE_FILE))
    return max(1, -(-total_bytes // size))


def split(rows: DataFrame, total_bytes: int, max_file_size: int) -> DataFrame:
    """Rows dealt out by key range into :func:`run_files` files, sorted: ranges of different files are disjoint."""
    n = run_files(total_bytes, max_file_size)
    dealt = rows.repartitionByRange(n, "key") if n > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions(F.asc("key"), F.desc("seq"), F.desc("type"))


def output_numbers(rows: DataFrame, budget: int, overhead: int = 97) -> DataFrame:
    """``rows`` with ``output``, the number of the file that each row of a sorted run goes to by size."""
    sized = rows.withColumn("bytes", (F.octet_length("key") + F.octet_length("value") + F.lit(overhead)).cast("long"))
    placed = sum_before(sized, "bytes", "_before_it", "key")
    return placed.withColumn("output", F.floor(F.col("_before_it") / F.lit(float(budget))).cast("long")).drop("_before_it")
