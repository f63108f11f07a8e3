"""Byte-level logs, Bloom filters, the block cache."""

import pyarrow as pa
import pytest
from pyspark.errors import PythonException

from tidemark.errors import Corruption, InvalidArgument
from tidemark.functions import bloom
from tidemark.functions.cache import BlockCache
from tidemark.sources import wal

THREE = wal.frame(1, 1, b"alpha", b"1") + wal.frame(2, 1, b"bravo", b"2") + wal.frame(3, 1, b"charlie", b"3")


def test_round_trip():
    rows = [(1, 1, b"k1", b"v1"), (2, 1, b"k2", b"v2"), (3, 0, b"k1", b""), (4, 1, b"", b"\0\xff")]
    assert list(wal.records(b"".join(wal.frame(*r) for r in rows))) == rows
    assert list(wal.records(b"")) == []


def test_junk_tail():
    assert len(list(wal.records(THREE + b"partial junk header fragment"))) == 3


@pytest.mark.parametrize("cut", range(1, 30))
def test_torn_tail(cut):
    assert len(list(wal.records(THREE[:-cut]))) == 2


def test_damage_before_the_end_raises():
    bad = bytearray(THREE)
    bad[45] = 0x7F
    found = wal.records(bytes(bad))
    assert next(found)[2] == b"alpha"
    with pytest.raises(Corruption):
        list(found)


def test_damage_of_the_last_record_is_torn():
    bad = bytearray(THREE)
    bad[-5] = 0x5A
    assert len(list(wal.records(bytes(bad)))) == 2


def test_long_records_are_refused(monkeypatch):
    monkeypatch.setattr(wal, "MAX_RECORD", 100)
    with pytest.raises(InvalidArgument):
        wal.frame(1, 1, b"k", b"v" * 100)


def test_frames_by_built_in_functions(spark):
    rows = [("k1", 1, 1, "v1"), ("", 2, 1, ""), ("é", (1 << 56) - 1, 0, ""), ("n", 3, 1, None)]
    log = spark.createDataFrame(rows, "key string, seq long, type byte, value string")
    got = {r["seq"]: bytes(r["frame"]) for r in wal.frames(log).collect()}
    assert got == {s: wal.frame(s, t, k.encode(), (v or "").encode()) for k, s, t, v in rows}


def test_read_logs(spark, tmp_path):
    (tmp_path / "000001.log").write_bytes(THREE)
    (tmp_path / "000002.log").write_bytes(THREE[:-3])
    rows = wal.read_logs(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-5], r["place"], bytes(r["key"])) for r in rows) == [
        ("1", 0, b"alpha"), ("1", 1, b"bravo"), ("1", 2, b"charlie"), ("2", 0, b"alpha"), ("2", 1, b"bravo")]
    bad = bytearray(THREE)
    bad[45] = 0x7F
    (tmp_path / "000003.log").write_bytes(bytes(bad))
    with pytest.raises(PythonException):
        wal.read_logs(spark, str(tmp_path)).collect()


def test_rows_of_small_files_leave_together(monkeypatch):
    class Contents:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    def batch(contents):
        return pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(len(contents))]), pa.array(contents, pa.binary())], names=["path", "content"])

    run = wal.decode(Contents())
    made = list(run(iter([batch([wal.frame(7, 1, b"k", b"v")] * 3_000), batch([]), batch([None, b"", THREE])])))
    assert [b.num_rows for b in made] == [3_003]
    assert made[0].slice(2_999).to_pydict() == {
        "path": ["p2999", "p2", "p2", "p2"], "place": [0, 0, 1, 2], "key": [b"k", b"alpha", b"bravo", b"charlie"],
        "seq": [7, 1, 2, 3], "type": [1, 1, 1, 1], "value": [b"v", b"1", b"2", b"3"]}
    assert [b.num_rows for b in run(iter([batch([wal.frame(7, 1, b"k", b"v")] * 5_000)]))] == [4_096, 904]
    monkeypatch.setattr(wal, "BATCH_BYTES", 1_000)
    assert [b.num_rows for b in run(iter([batch([wal.frame(7, 1, b"k", b"v" * 499)] * 5)]))] == [2, 2, 1]
    assert list(run(iter([]))) == []
    with pytest.raises(Corruption):
        list(run(iter([batch([THREE, THREE[:20] + b"x" + THREE[21:]])])))


def test_murmur3_published_values():
    assert bloom.murmur3(b"", 0) == 0 and bloom.murmur3(b"", 1) == 0x514E28B7
    assert bloom.murmur3(b"abc", 0) == 0xB3DD93FA and bloom.murmur3(b"Hello, world!", 1234) == 0xFAF6CDB3


def test_bloom():
    keys = [f"user:key:{i}".encode() for i in range(2000)]
    made = bloom.build(keys)
    assert len(made) == 2501 and made[-1] == 6
    assert all(bloom.may_hold(k, made) for k in keys)
    assert sum(bloom.may_hold(f"nonexistent:key:{i}".encode(), made) for i in range(2000, 12000)) < 250
    assert bloom.may_hold(b"x", b"") and bloom.may_hold(b"x", b"\0" * 8 + bytes([31]))
    assert len(bloom.build([])) == 9 and not bloom.may_hold(b"x", bloom.build([]))


def test_bloom_column(spark):
    made = bloom.build([b"a", b"b"])
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    assert [r[0] for r in rows.select(bloom.may_hold_column(rows["key"], made)).collect()] == [True, True, False]


def test_cache():
    cache = BlockCache(200)
    for at in (0, 100, 200):
        cache.insert(1, at, f"b{at}", 100)
    assert cache.lookup(1, 0) is None and cache.lookup(1, 100) == "b100" and cache.total_charge() == 200
    cache.insert(1, 300, "c", 100)
    assert cache.lookup(1, 200) is None and cache.lookup(1, 100) == "b100"
    cache.insert(2, 0, "big", 500)
    assert cache.lookup(2, 0) == "big" and cache.total_charge() == 500
    cache.erase(2, 0)
    cache.clear()
    assert cache.total_charge() == 0
