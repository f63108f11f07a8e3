"""A store on disk."""

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Corruption, HistoryLost, InvalidArgument, StoreError, StoreIOError
from tidemark.options import Options
from tidemark.store import Store
from tidemark.streaming.ingest import ingest


def rows(df):
    return sorted((bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in df.collect())


def many(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string")


def test_put_get_delete(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        assert s.get("user:123") is None
        s.put("user:123", "George")
        assert s.get("user:123") == b"George"
        s.delete("user:123")
        s.delete("never there")
        assert s.get("user:123") is None
        s.put("", "")
        assert s.get("") == b""
        with pytest.raises(InvalidArgument):
            s.put(None, "x")
    with pytest.raises(StoreError):
        s.put("a", "b")


def test_bounds_reach_the_scan(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put_many(many(spark, [(f"k{i}", "v") for i in range(50)]))
        s.flush()
        s.put_many(many(spark, [(f"z{i}", "v") for i in range(50)]))
        snap = s.snapshot()
        assert len(snap.version.candidates(b"k1", b"k3")) == 1  # whole files are skipped by their key ranges
        plan = snap.live("k1", "k3")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
        assert len(rows(snap.live("k1", "k3"))) == 22


def test_overwrite_across_flush(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put("key1", "A")
        s.put_many(many(spark, [(f"pad:{i}", "x" * 100) for i in range(50)]))
        s.flush()
        s.put("key1", "B")
        assert s.get("key1") == b"B" and s.version.level_files(0) == 1


def test_prefix_after_changes_and_cursor(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put_many(many(spark, [("user:100", "Alice"), ("user:101", "Bob"), ("user:102", "Charlie"), ("other:001", "x")]))
        assert [k for k, _ in rows(s.snapshot().prefix("user:"))] == ["user:100", "user:101", "user:102"]
        s.flush()
        before = s.snapshot()
        s.put("user:101", "BobUpdated")
        s.delete("user:100")
        assert rows(s.snapshot().prefix("user:")) == [("user:101", "BobUpdated"), ("user:102", "Charlie")]
        assert len(rows(before.prefix("user:"))) == 3
        c = s.snapshot().cursor(page=1)
        c.seek_to_first()
        seen = []
        while c.valid():
            seen.append(c.key())
            c.next()
        assert seen == [b"other:001", b"user:101", b"user:102"]
        c.seek_to_last()
        assert c.key() == b"user:102"
        c.prev()
        assert (c.key(), c.value()) == (b"user:101", b"BobUpdated")
        c.prev()
        c.prev()
        assert not c.valid()
        c.seek("user:1011")
        assert c.key() == b"user:102"
        with pytest.raises(InvalidArgument):
            c.seek("z")
            c.key()


def test_restart_and_torn_manifest(spark, tmp_path):
    path = f"{tmp_path}/s"
    with Store.open(spark, path) as s:
        s.put_many(many(spark, [(f"key:{i}", f"value:{i}") for i in range(500)]))
        manifest = s._manifest
    with (tmp_path / "s" / manifest).open("a") as f:
        f.write("0000 torn")
    for p in (tmp_path / "s").glob(".*.crc"):
        p.unlink()
    with Store.open(spark, path) as s:
        assert len(rows(s.live())) == 500 and s.version.last_sequence == 500 and s.version.level_files(0) == 1
        found = s.multi_get(many(spark, [("key:7", ""), ("absent", "")]))
        assert sorted((bytes(r["key"]).decode(), r["value"] and bytes(r["value"]).decode()) for r in found.collect()) == [("absent", None), ("key:7", "value:7")]


def test_options_and_lock(spark, tmp_path):
    path = f"{tmp_path}/s"
    with pytest.raises(InvalidArgument):
        Store.open(spark, path, Options(create_if_missing=False))
    assert not (tmp_path / "s").exists()
    with Store.open(spark, path) as held:
        with pytest.raises(StoreIOError):
            Store.open(spark, path)
        other = Store.open(spark, path, Options(break_lock=True))
        with pytest.raises(StoreIOError):
            held.put("a", "b")
        other.close()
    with pytest.raises(InvalidArgument):
        Store.open(spark, path, Options(error_if_exists=True))


def test_sync_writes_survive_a_lost_session(spark, tmp_path):
    path = f"{tmp_path}/s"
    s = Store.open(spark, path, Options(sync=True))
    s.put("a", "1")
    del s  # no close
    with Store.open(spark, path, Options(break_lock=True)) as again:
        assert again.get("a") == b"1"


def test_compaction_keeps_what_reads_give(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s", Options(max_level0_files=2, max_file_size=2000)) as s:
        for turn in range(4):
            s.put_many(many(spark, [(f"k{i:03d}", f"{turn}-{i}") for i in range(turn, 200, turn + 1)]))
            s.delete_many(spark.createDataFrame([(f"k{i:03d}",) for i in range(turn, 200, 17)], "key string"))
            s.flush()
            want = rows(s.live())
            old = s.snapshot()
            s.maintain()
            assert rows(s.live()) == want and rows(old.live()) == want
        whole = s.live()._jdf.queryExecution().toString()
        assert "Window" not in whole and "Exchange" not in whole  # all in one level: nothing to rank
        for level in range(1, 7):
            files = s.version.at(level)
            assert all(a.largest_key < b.smallest_key for a, b in zip(files, files[1:]))
        assert s.version.level_files(1) > 1
        assert s.verify() == sum(f.rows for f in s.version.files)
        with pytest.raises(HistoryLost):
            s.snapshot(as_of=1)
        live = {f.path.split("/")[1] for f in s.version.files}
        assert s.collect_garbage(retention_s=0)
        assert set(s._files.names("runs")) == live and rows(s.live()) == want


def test_as_of_before_compaction(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put("a", "1")
        first = s.snapshot().sequence
        s.put("a", "2")
        assert rows(s.snapshot(as_of=first).live()) == [("a", "1")] and s.get("a") == b"2"


def test_damage_raises(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put_many(many(spark, [(f"k{i}", "v" * 50) for i in range(2000)]))
        path = tmp_path / "s" / s.version.files[0].path
        data = bytearray(path.read_bytes())
        data[len(data) // 3] ^= 1
        path.write_bytes(bytes(data))
        path.with_name(f".{path.name}.crc").unlink()
        with pytest.raises(Corruption):
            s.verify()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "y", 2), ("a", 0, None, 3)], "key string, type byte, value string, at long").coalesce(1).write.parquet(str(source))
    with Store.open(spark, f"{tmp_path}/s") as s:
        for _ in range(2):  # the second time there is nothing new
            stream = spark.readStream.schema("key string, type byte, value string, at long").parquet(str(source))
            ingest(s, stream, f"{tmp_path}/checkpoint", "at").awaitTermination()
            assert rows(s.live()) == [("b", "y")] and s.version.last_sequence == 3


def test_bulk_order_decides(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.apply_many(spark.range(100).select(F.lit("k").alias("key"), F.lit(1).cast("byte").alias("type"), F.col("id").cast("string").alias("value"), "id"), "id")
        assert s.get("k") == b"99"


def test_flush_writes_files_of_bounded_size_in_parallel(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s", Options(max_file_size=30_000)) as s:
        s.put_many(spark.range(6_000).select(F.format_string("k%06d", "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")))
        s.flush()
        files = sorted(s.version.at(0), key=lambda f: f.smallest_key)
        assert len(files) > 3 and s.version.runs(0) == 1 and all(a.largest_key < b.smallest_key for a, b in zip(files, files[1:]))
        s.put("k000007", "new")
        s.flush()
        assert s.version.runs(0) == 2 and s.get("k000007") == b"new" and s.get("k005999") is not None


def test_recovery_sorts_in_parallel(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put_many(spark.range(6_000).select(F.format_string("k%06d", "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")))
    with Store.open(spark, f"{tmp_path}/s", Options(max_file_size=30_000)) as s:
        assert len(s.version.at(0)) > 3 and s.live().count() == 6_000


def test_lookups_read_only_files_that_can_hold_a_key(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s", Options(max_file_size=20_000, max_level0_files=1)) as s:
        s.put_many(spark.range(4_000).select(F.format_string("k%06d", "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")))
        s.maintain()
        assert len(s.version.at(1)) > 4
        snap = s.snapshot()

        def files(*keys):
            return len(snap._asked(spark.createDataFrame([(k,) for k in keys], "key string"))[1].inputFiles())

        assert files("k000005") == 1 and files("k000005", "k000006", "k003999") == 2
        assert files("a", "missing", "z") == 0 and files(*(f"k{i:06d}" for i in range(0, 4_000, 50))) == len(s.version.at(1))
        plan = snap._asked(many(spark, [("k000005", "")]))[1]._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(key" in plan or "EqualTo(key" in plan
        asked = spark.createDataFrame([("k000005",), ("missing",), ("k003999x",), (None,)], "key string")
        assert {k and bytes(k): v is not None for k, v in snap.multi_get(asked).collect()} == {b"k000005": True, b"missing": False, b"k003999x": False, None: False}
        assert [bytes(r[0]) for r in snap.contains(asked).collect()] == [b"k000005"]


def test_cursor_pages_read_few_files(spark, tmp_path, monkeypatch):
    from tidemark.store import Snapshot

    read, live = [], Snapshot.live
    monkeypatch.setattr(Snapshot, "live", lambda self, low=None, high=None: read.append(len(self.version.candidates(low, high))) or live(self, low, high))
    with Store.open(spark, f"{tmp_path}/s", Options(max_file_size=20_000)) as s:
        s.put_many(spark.range(4_000).select(F.format_string("k%06d", "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")))
        s.flush()
        s.delete_many(spark.range(100, 3_000).select(F.format_string("k%06d", "id").alias("key")))
        s.flush()
        n = len(s.version.files)
        assert n > 8
        c = s.snapshot().cursor(page=20)
        c.seek("k000050")
        assert c.key() == b"k000050" and max(read) <= 4 < n
        c.seek("k000099")
        c.next()
        assert c.key() == b"k003000"  # over all the deleted ones
        c.prev()
        assert c.key() == b"k000099"
        read.clear()
        c.seek_to_last()
        assert c.key() == b"k003999" and max(read) <= 4
        read.clear()
        c.seek_to_last()  # from the block cache
        assert not read and s.cache.total_charge() > 0


def test_stream_marks_are_part_of_the_commit(spark, tmp_path):
    """A batch that is delivered again after a crash right behind its commit is left out."""
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x", 1)], "key string, type byte, value string, at long").coalesce(1).write.parquet(str(source))
    with Store.open(spark, f"{tmp_path}/s") as s:
        stream = lambda: spark.readStream.schema("key string, type byte, value string, at long").parquet(str(source))
        ingest(s, stream(), f"{tmp_path}/one", "at").awaitTermination()
        s.put("a", "later")
        s.flush()
    with Store.open(spark, f"{tmp_path}/s") as s:
        ingest(s, stream(), f"{tmp_path}/two", "at").awaitTermination()  # its own checkpoint is lost
        assert s.get("a") == b"later" and dict(s.version.marks) == {"ingest": 0}


def test_files_of_a_run_stop_following_small_sizes(spark, tmp_path, monkeypatch):
    from tidemark.plans import compact

    monkeypatch.setattr(compact, "RUN_FILES", 16, raising=False)
    for n in (2_000, 8_000):
        with Store.open(spark, f"{tmp_path}/s{n}", Options(max_file_size=2_000)) as s:
            s.put_many(spark.range(n).select(F.format_string("k%06d", "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")))
            s.flush()
            files = s.version.at(0)
            assert 8 < len(files) <= 17 and sum(f.rows for f in files) == n
            assert rows(s.multi_get(many(spark, [("k000000", ""), (f"k{n - 1:06d}", "")]))) and s.live().count() == n


def test_large_runs_have_more_files_again():
    from tidemark.plans.compact import LARGE_FILE, RUN_FILES, run_files

    assert [run_files(x, 2048) for x in (0, 1, 2048, 2049, 2048 * RUN_FILES)] == [1, 1, 1, 2, RUN_FILES]
    assert run_files(LARGE_FILE * RUN_FILES, 2048) == RUN_FILES and run_files(10 * LARGE_FILE * RUN_FILES, 2048) == 10 * RUN_FILES
    assert run_files(10 * LARGE_FILE * RUN_FILES, 2 * LARGE_FILE) == 5 * RUN_FILES


def test_bloom_filters_have_the_size_of_a_file(spark, tmp_path):
    """Not that of the run: files times rows."""

    def bytes_of(bits):
        with Store.open(spark, f"{tmp_path}/s{bits}", Options(max_file_size=8_000, bloom_bits_per_key=bits)) as s:
            s.put_many(spark.range(8_000).select(F.format_string("k%06d", "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")))
            batch = sum(f.file_size for f in s.version.files)
            s.flush()
            assert len(s.version.at(0)) > 8
            return batch, sum(f.file_size for f in s.version.at(0))

    for filtered, plain in zip(bytes_of(10), bytes_of(0)):
        assert plain < filtered < plain + 8 * 8_000


def test_lookups_bisect_flushed_runs(monkeypatch):
    from random import Random

    from tidemark.plans.manifest import Edit, FileMeta, Version

    made, r = [], Random(7)
    for level, folder in ((-1, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e")):
        for i in range(40):
            low, span = (r.randrange(4_000), 900) if level < 0 else (100 * i + 50 * (folder in "ce") + 2_000 * 2 * (folder == "e"), 45)
            made.append(FileMeta(level, len(made) + 1, 1, b"%06d" % low, b"%06d" % (low + span), f"runs/{folder}/{i}"))
    version = Version().apply(Edit(added=made))
    looked, overlaps = [], FileMeta.overlaps
    monkeypatch.setattr(FileMeta, "overlaps", lambda f, *x: looked.append(f.level) or overlaps(f, *x))
    for _ in range(300):
        low, high = sorted(b"%06d" % r.randrange(9_000) for _ in range(2))
        for a, b in ((low, low), (low, high), (None, high), (low, None), (None, None)):
            assert {f.number for f in version.candidates(a, b)} == {f.number for f in made if overlaps(f, a, b)}
    assert set(looked) == {-1}  # only log batches, whose files overlap, are looked at one by one


def test_cursor_reads_ahead(spark, tmp_path, monkeypatch):
    """A walk over a file takes few passes over it, however small its first page is."""
    from tidemark.store import Snapshot

    read, live = [], Snapshot.live
    monkeypatch.setattr(Snapshot, "live", lambda self, low=None, high=None: read.append(0) or live(self, low, high))
    keys = [b"k%04d" % i for i in range(600)]
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put_many(many(spark, [(k.decode(), "v") for k in keys]))
        s.flush()
        c = s.snapshot().cursor(page=4)
        for start, step, want in ((c.seek_to_first, c.next, keys), (c.seek_to_last, c.prev, keys[::-1])):
            read.clear()
            start()
            assert len(c._rows) == 4  # a seek reads no more than asked
            seen = []
            while c.valid():
                seen.append(c.key())
                step()
            assert seen == want and len(read) <= 10
        c.seek("k0300")
        for _ in range(10):
            c.next()
        for _ in range(10):
            c.prev()
        assert c.key() == b"k0300"


def test_cursor_reads_ahead_within_the_block_cache(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s", Options(block_cache_capacity_bytes=8_000)) as s:
        s.put_many(many(spark, [(f"k{i:03d}", "v" * (10 if i < 40 else 500)) for i in range(80)]))
        s.flush()
        c = s.snapshot().cursor(page=4)
        c.seek_to_first()
        seen, pages = 0, []
        while c.valid():
            if not pages or pages[-1] is not c._rows:
                pages.append(c._rows)
            seen += 1
            c.next()
        assert seen == 80
        assert [len(p) for p in pages] == [4, 8, 16, 32, 16, 4]  # 40 entries of 78 bytes, then 568 each: back to what fits
