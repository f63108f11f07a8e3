"""Versions of a store: sets of files by level, and the edits between them.

The log of edits is text, one JSON object a line with a checksum.  A line that is cut off at the end of the log is
a torn write and is left out; damage before it is :class:`Corruption`.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field, replace
from functools import cached_property
from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Corruption
from ..schema import LEVELS

COMPARATOR = "byte_comparator"


@dataclass(frozen=True)
class FileMeta:
    """``level`` -1 holds log batches, which a flush has yet to sort."""

    level: int
    number: int
    file_size: int
    smallest_key: bytes
    largest_key: bytes
    path: str = ""
    rows: int = 0
    low_seq: int = 0

    def overlaps(self, low: bytes | None, high: bytes | None) -> bool:
        """Whether keys of [low, high] can be inside; None leaves a side open."""
        return not ((low is not None and self.largest_key < low) or (high is not None and self.smallest_key > high))


def apart(files: list[FileMeta]) -> tuple[list[FileMeta], list[FileMeta]]:
    """Files that have each of their keys once and alone: compaction outputs that overlap no other; and the rest."""
    alone, rest, group, high = [], [], [], None

    def close() -> None:
        (alone if len(group) == 1 and group[0].level >= 1 else rest).extend(group)

    for f in sorted(files, key=lambda f: f.smallest_key):
        if group and f.smallest_key > high:
            close()
            group = []
        high = f.largest_key if not group else max(high, f.largest_key)
        group.append(f)
    close()
    return alone, rest


@dataclass
class Edit:
    comparator: str | None = None
    log_number: int | None = None
    next_file: int | None = None
    last_sequence: int | None = None
    kept_from: int | None = None
    deleted: list[tuple[int, int]] = field(default_factory=list)
    added: list[FileMeta] = field(default_factory=list)
    #: The last batch of each stream that the version holds.
    marks: dict[str, int] | None = None

    def line(self) -> str:
        body = {k: v for k, v in self.__dict__.items() if k not in ("deleted", "added") and v is not None}
        body |= {"deleted": self.deleted, "added": [f.__dict__ | {"smallest_key": f.smallest_key.hex(), "largest_key": f.largest_key.hex()} for f in self.added]}
        text = json.dumps(body, sort_keys=True)
        return f"{crc32(text.encode()):08x} {text}\n"

    @staticmethod
    def parse(line: str) -> Edit:
        check, _, text = line.partition(" ")
        if f"{crc32(text.encode()):08x}" != check:
            raise Corruption("checksum of a manifest line")
        body = json.loads(text)
        added = [FileMeta(**f | {"smallest_key": bytes.fromhex(f["smallest_key"]), "largest_key": bytes.fromhex(f["largest_key"])}) for f in body.pop("added")]
        return Edit(deleted=[tuple(d) for d in body.pop("deleted")], added=added, **body)


@dataclass(frozen=True)
class Version:
    files: tuple[FileMeta, ...] = ()
    log_number: int = 0
    next_file: int = 2
    last_sequence: int = 0
    #: Reads as of an earlier sequence number may miss versions that compaction has dropped.
    kept_from: int = 0
    marks: tuple[tuple[str, int], ...] = ()

    def apply(self, edit: Edit) -> Version:
        """(files - deleted) + added; sequence and file numbers never go back."""
        if edit.comparator not in (None, COMPARATOR):
            raise Corruption(f"keys are ordered by {edit.comparator}")
        gone = set(edit.deleted)
        files = [f for f in self.files if (f.level, f.number) not in gone] + edit.added
        files.sort(key=lambda f: (f.level, -f.number if f.level <= 0 else 0, f.smallest_key, f.number))
        return replace(
            self,
            files=tuple(files),
            log_number=self.log_number if edit.log_number is None else edit.log_number,
            next_file=max([self.next_file, edit.next_file or 0, *(f.number + 1 for f in edit.added)]),
            last_sequence=max(self.last_sequence, edit.last_sequence or 0),
            kept_from=max(self.kept_from, edit.kept_from or 0),
            marks=tuple(sorted((dict(self.marks) | (edit.marks or {})).items())),
        )

    def at(self, level: int) -> list[FileMeta]:
        return [f for f in self.files if f.level == level]

    def level_bytes(self, level: int) -> int:
        return sum(f.file_size for f in self.at(level))

    def level_files(self, level: int) -> int:
        return len(self.at(level))

    def live_numbers(self) -> set[int]:
        return {f.number for f in self.files}

    def runs(self, level: int) -> int:
        """Sorted runs of a level: files of one folder were written together and don't overlap."""
        return len({f.path.rpartition("/")[0] or f.number for f in self.at(level)})

    @cached_property
    def _levels(self) -> tuple[list[FileMeta], list[tuple[list[FileMeta], list[bytes], list[bytes]]]]:
        """Files that may overlap others of their run; and the other runs, a level or a flush, in key order with their bounds."""
        runs: dict = {}
        for f in self.files:
            runs.setdefault(f.level if f.level >= 1 else (f.level, f.path.rpartition("/")[0] or f.number), []).append(f)
        mixed, sorted_runs = [], []
        for run in (sorted(x, key=lambda f: f.smallest_key) for x in runs.values()):
            if all(a.largest_key < b.smallest_key for a, b in zip(run, run[1:])):
                sorted_runs.append((run, [f.smallest_key for f in run], [f.largest_key for f in run]))
            else:
                mixed += run
        return mixed, sorted_runs

    def candidates(self, low: bytes | None, high: bytes | None) -> list[FileMeta]:
        """Files that can hold keys of [low, high]: by a look at each where files may overlap, as in log batches, by bisection in
        sorted runs."""
        mixed, sorted_runs = self._levels
        found = [f for f in mixed if f.overlaps(low, high)]
        for files, smallest, largest in sorted_runs:
            first = 0 if low is None else bisect_left(largest, low)
            found += files[first : len(files) if high is None else bisect_right(smallest, high)]
        return found

    def boundaries(self, low: bytes | None, high: bytes | None) -> list[bytes]:
        """First keys of files strictly between two keys, in order: where a read of a range can be cut."""
        return sorted({f.smallest_key for f in self.candidates(low, high) if (low is None or f.smallest_key > low) and (high is None or f.smallest_key < high)})

    def snapshot(self) -> Edit:
        """One edit that gives this version from nothing."""
        return Edit(COMPARATOR, self.log_number, self.next_file, self.last_sequence, self.kept_from, [], list(self.files), dict(self.marks))

    def levels(self) -> list[tuple[int, int, int]]:
        return [(k, self.level_files(k), self.level_bytes(k)) for k in range(LEVELS)]


def replay(text: str) -> Version:
    version, lines = Version(), text.split("\n")
    torn = lines.pop()  # "" after a whole last line
    for k, line in enumerate(lines):
        try:
            edit = Edit.parse(line)
        except (Corruption, ValueError, KeyError, TypeError) as e:
            if k == len(lines) - 1 and not torn:
                break
            raise Corruption(f"manifest line {k + 1}") from e
        version = version.apply(edit)
    return version


# --- the same as relations, for manifests that are tables ----------------------------------------------------------


def edit_apply(files: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    return files.join(deleted.select("level", "number"), ["level", "number"], "left_anti").unionByName(added)


def fold(actions: DataFrame) -> DataFrame:
    """Live files after ``actions(edit, action, level, number, ...)``, action "add" or "delete"; within an edit deletions
    come first."""
    place = F.row_number().over(Window.partitionBy("level", "number").orderBy(F.desc("edit"), F.asc("action")))
    return actions.withColumn("_place", place).where("_place = 1 and action = 'add'").drop("_place", "action", "edit")


def level_bytes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.sum("file_size").alias("bytes"))


def level_files(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"))


def live_files(files: DataFrame) -> DataFrame:
    return files.select("number").distinct()


def probe_order(files: DataFrame) -> DataFrame:
    """Newest first in level 0, by key below."""
    return files.orderBy("level", F.when(F.col("level") == 0, -F.col("number")), "smallest_key")


def prune_point(files: DataFrame, key) -> DataFrame:
    return files.where((F.col("smallest_key") <= F.lit(key)) & (F.col("largest_key") >= F.lit(key)))


def prune_range(files: DataFrame, low, high) -> DataFrame:
    """Files that overlap [low, high]."""
    return files.where(~((F.col("largest_key") < F.lit(low)) | (F.col("smallest_key") > F.lit(high))))


def overlaps(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of file numbers whose ranges overlap.  Metadata, a row a file."""
    a, b = upper.alias("a"), lower.alias("b")
    near = ~((F.col("b.largest_key") < F.col("a.smallest_key")) | (F.col("b.smallest_key") > F.col("a.largest_key")))
    return a.join(b, near).select(F.col("a.number").alias("number"), F.col("b.number").alias("other"))
