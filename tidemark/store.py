"""A store: one folder, one ordered map, kept as Parquet runs and a manifest.

``CURRENT`` names the manifest, a log of edits.  A commit writes the edits' log anew under a new name and swaps
``CURRENT`` by an atomic rename; readers keep the files of the version that they opened.  Runs:

* log batches (level -1): mutations in order of arrival, visible once committed;
* level 0: one sorted run a flush, all versions kept, ranges may overlap;
* levels 1 to 6: sorted, ranges of a level disjoint.

Bulk calls (``put_many``, ``delete_many``, ``multi_get``, scans) are the ones to use: single puts wait in the driver's
buffer and become a batch at ``write_buffer_size``, at once with ``sync``, or when something reads.

One session holds a store at a time, by its ``LOCK`` file; ``break_lock`` takes over after a crash.  Reads verify
Parquet's page checksums; what can't be read raises.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Corruption, HistoryLost, InvalidArgument, StoreError, StoreIOError
from .functions.cache import BlockCache
from .operators import lookup, mutate, scan
from .operators.resolve import latest
from .options import Options
from .plans.compact import Compaction, merged, pick, run_files, split
from .plans.manifest import COMPARATOR, Edit, FileMeta, Version, apart, replay
from .schema import DELETION, MAX_SEQUENCE, MUTATION, VALUE
from .sources.files import Files

_LOG = -1
#: Most rows that a cursor reads ahead.
READ_AHEAD = 1 << 16


def _bytes(x) -> bytes:
    if x is None:
        raise InvalidArgument("a key or value is missing")
    return x.encode() if isinstance(x, str) else bytes(x)


class Snapshot:
    """A version's files up to a sequence number.  Immutable: later writes and compactions don't show."""

    def __init__(self, store: Store, version: Version, as_of: int | None):
        self._store, self.version = store, version
        self.sequence = version.last_sequence if as_of is None else as_of

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions in files that can hold keys of [low, high]; whole files are skipped by the manifest, row groups by
        Parquet's statistics and Bloom filters."""
        return self._store._read(self.version.candidates(low, high))

    def live(self, low=None, high=None) -> DataFrame:
        """Live (key, value) rows of [low, high).  Where compaction has left one file for a range of keys, rows are read as they
        stand; only the other files' rows are shuffled and ranked."""
        low, high = (None if x is None else _bytes(x) for x in (low, high))
        alone, rest = apart(self.version.candidates(low, high))
        bounds = [None if x is None else bytearray(x) for x in (low, high)]
        rows = latest(scan.between(self._store._read(rest), *bounds), self.sequence).select("key", "value")
        if alone:  # nothing to rank there: no shuffle
            single = scan.between(self._store._read(alone), *bounds).where((F.col("type") == VALUE) & (F.col("seq") <= self.sequence)).select("key", "value")
            rows = single.unionByName(rows) if rest else single
        return rows

    def prefix(self, prefix) -> DataFrame:
        from .schema import successor

        return self.live(_bytes(prefix), successor(_bytes(prefix)))

    def get(self, key) -> bytes | None:
        k = _bytes(key)
        row = lookup.get(self.log(k, k), bytearray(k), self.sequence).first()
        return None if row is None else bytes(row["value"])

    def _asked(self, keys: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The different keys, the log of the files that can hold any of them, and the number of keys.  Each key finds its files
        by the manifest's bounds; a few keys are also pushed down, to row groups' statistics and Bloom filters."""
        version = self.version
        asked = keys.select(F.col("key").cast("binary").alias("key")).distinct()

        def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, held, some = 0, set(), []
            for b in batches:
                for k in b.column(0).to_pylist():
                    n += 1
                    if k is not None:
                        held.update((f.level, f.number) for f in version.candidates(k, k))
                        if len(some) <= lookup.PUSHED_KEYS:
                            some.append(k)
            held = sorted(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([[x for x, _ in held]], pa.list_(pa.int64())), pa.array([[x for _, x in held]], pa.list_(pa.int64())), pa.array([some], pa.list_(pa.binary()))],
                names=["n", "level", "number", "some"],
            )

        parts = asked.mapInArrow(files_of, "n long, level array<long>, number array<long>, some array<binary>").collect()  # a row a task
        held = {x for r in parts for x in zip(r["level"], r["number"])}
        n, log = sum(r["n"] for r in parts), self._store._read([f for f in version.files if (f.level, f.number) in held])
        if held and n <= lookup.PUSHED_KEYS:
            log = log.where(F.col("key").isin([x for r in parts for x in r["some"]]))
        return asked, log, n

    def multi_get(self, keys: DataFrame) -> DataFrame:
        asked, log, n = self._asked(keys)
        return lookup.multi_get(log, asked, self.sequence, n)

    def contains(self, keys: DataFrame) -> DataFrame:
        asked, log, n = self._asked(keys)
        return lookup.contains(log, asked, self.sequence, n)

    def cursor(self, page: int = 256) -> Cursor:
        return Cursor(self, page)

    def view(self, name: str) -> None:
        """The live rows as a temporary view, for SQL."""
        self.live().createOrReplaceTempView(name)


class Cursor:
    """Positions over a snapshot's live rows in key order.  It reads ``page`` rows, and as it goes on in one direction twice as
    many each time, up to ``READ_AHEAD`` and half the block cache: to read a page takes a pass over a file, so pages of one size
    would take a walk more passes the larger its files are.  For one page it reads only the files of as many key ranges, cut
    where files begin, as it takes to fill it.  Pages are kept in the store's block cache."""

    def __init__(self, snapshot: Snapshot, page: int):
        self._snapshot, self._size = snapshot, page
        self._rows: list = []
        self._at, self._ahead, self._down = 0, page, False

    def _further(self) -> int:
        """Rows of the page that goes on from the one that is read."""
        room, size = self._snapshot._store.options.block_cache_capacity_bytes // 2, _charge(self._rows)
        if size > room:
            return max(self._size, self._ahead // 2)
        return self._ahead if 2 * size > room else max(self._size, min(2 * self._ahead, READ_AHEAD))

    def _load(self, low: bytes | None = None, high: bytes | None = None, descending: bool = False, on: bool = False) -> None:
        self._ahead = self._further() if on and descending == self._down else self._size
        self._down = descending
        cache, version = self._snapshot._store.cache, self._snapshot.version
        name = (tuple(f.path for f in version.candidates(low, high)), self._snapshot.sequence, self._ahead), (low, high, descending)
        self._rows = cache.lookup(*name)
        if self._rows is None:
            self._rows, order = [], F.desc("key") if descending else F.asc("key")
            for a, b in _stretches(version.boundaries(low, high), low, high, descending):
                rows = self._snapshot.live(a, b).orderBy(order).limit(self._ahead - len(self._rows)).collect()
                self._rows += [(bytes(r["key"]), bytes(r["value"])) for r in rows]
                if len(self._rows) >= self._ahead:
                    break
            if descending:
                self._rows.reverse()
            cache.insert(*name, self._rows, _charge(self._rows))
        self._at = len(self._rows) - 1 if descending else 0

    def valid(self) -> bool:
        return 0 <= self._at < len(self._rows)

    def _row(self):
        if not self.valid():
            raise InvalidArgument("the cursor isn't at an entry")
        return self._rows[self._at]

    def key(self) -> bytes:
        return self._row()[0]

    def value(self) -> bytes:
        return self._row()[1]

    def status(self) -> None:
        """Errors raise where they happen; there are none to report later."""

    def seek_to_first(self) -> None:
        self._load()

    def seek_to_last(self) -> None:
        self._load(descending=True)

    def seek(self, target) -> None:
        self._load(low=_bytes(target))

    def next(self) -> None:
        key = self._row()[0]
        self._at += 1
        if self._at == len(self._rows):
            self._load(low=key + b"\0", on=True)

    def prev(self) -> None:
        key = self._row()[0]
        self._at -= 1
        if self._at < 0:
            self._load(high=key, descending=True, on=True)


def _charge(rows: list[tuple[bytes, bytes]]) -> int:
    return sum(len(k) + len(v) + 64 for k, v in rows)


def _stretches(cuts: list[bytes], low: bytes | None, high: bytes | None, descending: bool) -> Iterator[tuple[bytes | None, bytes | None]]:
    """[low, high) in ranges of one, two, four and so on neighbouring cuts, from its begin or from its end."""
    edges, at, size = [low, *cuts, high], 0, 1
    if descending:
        edges.reverse()
    while at < len(edges) - 1:
        end = min(at + size, len(edges) - 1)
        yield (edges[end], edges[at]) if descending else (edges[at], edges[end])
        at, size = end, 2 * size


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._files = Files(spark, self.path)
        self.cache = BlockCache(self.options.block_cache_capacity_bytes)
        self._buffer: list[tuple[bytes, int, bytes]] = []
        self._buffered = 0
        self._owner = uuid.uuid4().hex
        self._open = False

    # --- life ---------------------------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Create or recover.  Log batches that no flush has sorted become level-0 runs."""
        store = cls(spark, path, options or Options())
        files, there = store._files, store._files.exists("CURRENT")
        if there and store.options.error_if_exists:
            raise InvalidArgument(f"{path} exists")
        if not there and not store.options.create_if_missing:
            raise InvalidArgument(f"{path} doesn't exist")
        files.mkdirs()
        if store.options.break_lock:
            files.delete("LOCK")
        if not files.create_new("LOCK", store._owner):
            raise StoreIOError(f"{path} is held by another session")
        store._open = True
        try:
            if there:
                store._manifest = files.read("CURRENT").strip()
                store._text = files.read(store._manifest)
                store.version = replay(store._text)
            else:
                store.version, store._text = Version(), ""
                store._commit(Edit(COMPARATOR, next_file=2, last_sequence=0))
            store._sort_log()
        except BaseException:
            store._unlock()
            raise
        return store

    def close(self) -> None:
        """Commits what is buffered, as a log batch, and gives the lock back."""
        if self._open:
            try:
                self._commit_buffer()
            finally:
                self._unlock()

    def _unlock(self) -> None:
        self._open = False
        if self._files.exists("LOCK") and self._files.read("LOCK") == self._owner:
            self._files.delete("LOCK")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _check(self) -> None:
        if not self._open:
            raise StoreError("the store is closed")
        if self._files.read("LOCK") != self._owner:
            raise StoreIOError("another session has taken the store over")

    # --- writes -------------------------------------------------------------------------------------------------

    def put(self, key, value) -> None:
        self._write(_bytes(key), VALUE, _bytes(value))

    def delete(self, key) -> None:
        """A deletion; the key needn't be there."""
        self._write(_bytes(key), DELETION, b"")

    def _write(self, key: bytes, kind: int, value: bytes) -> None:
        self._check()
        if self._buffered >= self.options.write_buffer_size:
            self._commit_buffer()
        self._buffer.append((key, kind, value))
        self._buffered += len(key) + len(value) + 64
        if self.options.sync:
            self._commit_buffer()

    def _commit_buffer(self) -> None:
        if self._buffer:
            self._check()
            base = self.version.last_sequence
            rows = [(bytearray(k), base + i + 1, t, bytearray(v)) for i, (k, t, v) in enumerate(self._buffer)]
            self._add_batch(self.spark.createDataFrame(rows, MUTATION), base + len(rows), len(rows))
            self._buffer, self._buffered = [], 0

    def put_many(self, rows: DataFrame, *order) -> int:
        """Puts every ``(key, value)`` row, numbered in ``order`` (by default: key, value).  Returns the last sequence number."""
        return self._many(rows.select("*", F.lit(VALUE).cast("tinyint").alias("type")), order or ("key", "value"))

    def delete_many(self, keys: DataFrame, *order) -> int:
        return self._many(keys.select("*", F.lit(DELETION).cast("tinyint").alias("type"), F.lit(b"").alias("value")), order or ("key",))

    def apply_many(self, rows: DataFrame, *order, mark: tuple[str, int] | None = None) -> int:
        """Puts and deletions ``(key, type, value)`` together, in ``order``.  ``mark``: a stream and the number of its batch,
        which the same edit commits."""
        return self._many(rows, order, mark)

    def _many(self, rows: DataFrame, order, mark: tuple[str, int] | None = None) -> int:
        self._check()
        self._commit_buffer()
        base = self.version.last_sequence
        numbered = mutate.numbered(rows, base, *order)
        batch = numbered.select(
            F.col("key").cast("binary").alias("key"), "seq", F.col("type").cast("tinyint").alias("type"),
            F.when(F.col("type") == DELETION, F.lit(b"")).otherwise(F.coalesce(F.col("value").cast("binary"), F.lit(b""))).alias("value"),
        )
        n, without = batch.agg(F.count("*"), F.count_if(F.col("key").isNull())).first()
        if without:
            raise InvalidArgument("a key is null")
        if base + n > MAX_SEQUENCE:
            raise InvalidArgument("sequence numbers are used up")
        if n:
            self._add_batch(batch, base + n, n, int(self.spark.conf.get("spark.sql.shuffle.partitions")), mark)
        return base + n

    def _add_batch(self, batch: DataFrame, last: int, n: int, files: int = 1, mark: tuple[str, int] | None = None) -> None:
        self._commit(Edit(last_sequence=last, marks=None if mark is None else dict([mark]), added=self._write_run(batch, _LOG, n, files)))

    # --- runs ---------------------------------------------------------------------------------------------------

    def _write_run(self, rows: DataFrame, level: int, n: int, files: int) -> list[FileMeta]:
        """Writes one folder; each part file in it is a file of the version.  ``n``: rows at most, in about ``files`` files: a Bloom
        filter has the size for twice a file's share, whatever the run holds."""
        folder = f"runs/{self.version.next_file:06d}-{uuid.uuid4().hex[:8]}"
        writer = rows.write.option("parquet.page.write-checksum.enabled", "true")
        if self.options.bloom_bits_per_key > 0:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(min(max(-(-2 * n // files), 64), 1_000_000))).option(
                "parquet.bloom.filter.fpp#key", "0.01"
            )
        writer.parquet(f"{self.path}/{folder}")
        found = (
            self._parquet(f"{self.path}/{folder}")
            .groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
            .agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"), F.min("seq").alias("seq"))
            .collect()  # a row a file: what the manifest is going to hold
        )
        sizes = self._files.sizes(folder)
        made = sorted(found, key=lambda r: (bytes(r["low"]), r["name"]))
        return [
            FileMeta(level, self.version.next_file + i, sizes[r["name"]], bytes(r["low"]), bytes(r["high"]), f"{folder}/{r['name']}", r["rows"], r["seq"])
            for i, r in enumerate(made)
        ]

    def _parquet(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(MUTATION).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)

    def _read(self, files: list[FileMeta]) -> DataFrame:
        return self._parquet(*[f"{self.path}/{f.path}" for f in files]) if files else self.spark.createDataFrame([], MUTATION)

    # --- versions -----------------------------------------------------------------------------------------------

    def _commit(self, edit: Edit) -> None:
        """The new version counts once ``CURRENT`` names its manifest."""
        version = self.version.apply(edit)
        name = f"MANIFEST-{version.next_file:06d}-{uuid.uuid4().hex[:8]}"
        text = self._text + edit.line()
        if text.count("\n") > 64:
            text = version.snapshot().line()
        self._files.write(name, text)
        self._files.write(f"{name}.current", name + "\n")
        self._files.swap(f"{name}.current", "CURRENT")
        old, self._manifest, self._text, self.version = getattr(self, "_manifest", None), name, text, version
        if old:
            self._files.delete(old)

    def snapshot(self, as_of: int | None = None) -> Snapshot:
        """What is committed and buffered now, or as of an earlier sequence number."""
        self._check()
        self._commit_buffer()
        if as_of is not None and as_of < self.version.kept_from:
            raise HistoryLost(f"versions are kept from {self.version.kept_from} on")
        return Snapshot(self, self.version, as_of)

    # --- reads --------------------------------------------------------------------------------------------------

    def get(self, key) -> bytes | None:
        return self.snapshot().get(key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return self.snapshot().multi_get(keys)

    def cursor(self) -> Cursor:
        return self.snapshot().cursor()

    def live(self, low=None, high=None) -> DataFrame:
        return self.snapshot().live(low, high)

    # --- maintenance --------------------------------------------------------------------------------------------

    def flush(self) -> None:
        """Log batches and buffer become one sorted level-0 run, with all versions and deletions, in files of
        ``max_file_size``."""
        self._check()
        self._commit_buffer()
        self._sort_log()

    def _sort_log(self) -> None:
        batches = self.version.at(_LOG)
        if batches:
            total, most = sum(f.file_size for f in batches), self.options.max_file_size
            added = self._write_run(split(self._read(batches), total, most), 0, sum(f.rows for f in batches), run_files(total, most))
            self._commit(Edit(log_number=max(f.number for f in batches) + 1, deleted=[(f.level, f.number) for f in batches], added=added))

    def compact_once(self) -> Compaction | None:
        """One compaction, if one is due."""
        self._check()
        plan = pick(self.version, self.options.max_level0_files)
        if plan is not None:
            self._compact(plan)
        return plan

    def _compact(self, plan: Compaction) -> None:
        ranges = [(f.smallest_key, f.largest_key) for k in range(plan.level + 2, 7) for f in self.version.at(k)]
        # Files of this level that stay and overlap the inputs hold versions that a deletion must go on hiding.
        chosen = {f.number for f in plan.files}
        ranges += [(f.smallest_key, f.largest_key) for f in self.version.files if f.level in (plan.level, plan.level + 1) and f.number not in chosen and plan.level]
        rows = merged(self._read(list(plan.files)), ranges)
        total, most = sum(f.file_size for f in plan.files), self.options.max_file_size
        added = self._write_run(split(rows, total, most), plan.level + 1, sum(f.rows for f in plan.files), run_files(total, most))
        self._commit(Edit(deleted=[(f.level, f.number) for f in plan.files], added=added, kept_from=self.version.last_sequence))

    def maintain(self) -> int:
        """Flush, then compact while something is due.  Returns the number of compactions."""
        self.flush()
        n = 0
        while self.compact_once() is not None:
            n += 1
        return n

    def collect_garbage(self, retention_s: float = 24 * 3600) -> list[str]:
        """Deletes run folders that no file of the version is in and that are older than ``retention_s``, which is how long
        open snapshots stay readable."""
        self._check()
        live = {f.path.split("/")[1] for f in self.version.files}
        now, gone = time.time() * 1000, []
        for name in self._files.names("runs"):
            status = self._files._fs.getFileStatus(self._files._path(f"runs/{name}"))
            if name not in live and now - status.getModificationTime() >= retention_s * 1000:
                self._files.delete(f"runs/{name}")
                gone.append(name)
        return gone

    def verify(self) -> int:
        """Reads every file of the version; returns the number of rows or raises."""
        want = sum(f.rows for f in self.version.files)
        try:
            got = self._read(list(self.version.files)).agg(F.count("*"), F.max(F.xxhash64("key", "seq", "type", "value"))).first()[0]
        except Exception as e:
            raise Corruption("a run can't be read") from e
        if got != want:
            raise Corruption(f"{got} rows where the manifest has {want}")
        return got
