"""Byte-level mutation logs: framed records with a checksum.

Fixed values of the format, all little-endian: ``crc32 u32, length u32, payload``, with the payload
``type u8, seq u64, key length u32, key, value length u32, value``; the checksum covers the payload.

Damage at the end of a log is a torn write: what stands before it is the log.  Damage before the end is
:class:`Corruption`, and so are records over ``MAX_RECORD``, which are refused when written, too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corruption, InvalidArgument

MAX_RECORD = 64 << 20
#: Decoded rows, and bytes of keys and values, at which a batch is passed on.
BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20
_HEAD = struct.Struct("<II")
_FIXED = struct.Struct("<BQI")


def frame(seq: int, kind: int, key: bytes, value: bytes) -> bytes:
    payload = _FIXED.pack(kind, seq, len(key)) + key + len(value).to_bytes(4, "little") + value
    if len(payload) > MAX_RECORD:
        raise InvalidArgument(f"a record of {len(payload)} bytes; the most is {MAX_RECORD}")
    return _HEAD.pack(crc32(payload), len(payload)) + payload


def records(log: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(seq, type, key, value) of each whole record."""
    at, end = 0, len(log)
    while at + _HEAD.size <= end:
        check, size = _HEAD.unpack_from(log, at)
        body = at + _HEAD.size
        if body + size > end:
            return  # torn: the record was to be longer than what is there
        tail = body + size == end
        if size > MAX_RECORD:
            raise Corruption(f"record of {size} bytes at {at}")
        payload = log[body : body + size]
        if crc32(payload) != check:
            if tail:
                return
            raise Corruption(f"checksum of the record at {at}")
        kind, seq, n = _FIXED.unpack_from(payload) if size >= _FIXED.size else (255, 0, 0)
        value_at = _FIXED.size + n + 4
        if kind > 1 or value_at > size or value_at + int.from_bytes(payload[value_at - 4 : value_at], "little") != size:
            raise Corruption(f"fields of the record at {at}")
        yield seq, kind, payload[_FIXED.size : value_at - 4], payload[value_at:]
        at = body + size


def _little(number: Column, size: int) -> Column:
    text = F.lpad(F.hex(number.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * k - 1, 2) for k in range(size, 0, -1)]))


def frames(log: DataFrame) -> DataFrame:
    """``(seq, frame)``: each mutation as a record, by built-in functions only."""
    key, value = F.col("key").cast("binary"), F.coalesce(F.col("value").cast("binary"), F.lit(b""))
    payload = F.concat(_little(F.col("type"), 1), _little(F.col("seq"), 8), _little(F.octet_length(key), 4), key, _little(F.octet_length(value), 4), value)
    small = log.select("seq", payload.alias("_payload"))
    size = F.octet_length("_payload")
    checked = F.when(size <= MAX_RECORD, F.col("_payload")).otherwise(F.raise_error(F.lit("a record is too long")))
    return small.select("seq", F.concat(_little(F.crc32("_payload"), 4), _little(size, 4), checked).alias("frame"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Mutations of byte-level log files, each read in order by one task."""
    return decode(spark.read.format("binaryFile").load(path).select("path", "content"))


def decode(contents: DataFrame) -> DataFrame:
    """``(path, content)`` to ``(path, place, key, seq, type, value)``; place counts a file's records.  Rows of many small files
    leave together: a batch of its own for each costs far more than its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "place", "key", "seq", "type", "value"]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int8(), pa.binary()]
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path = path.as_py()
                for k, (seq, kind, key, value) in enumerate(records(content.as_py() or b"")):
                    rows.append((path, k, key, seq, kind, value))
                    size += len(key) + len(value)
                    if len(rows) == BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return contents.select("path", "content").mapInArrow(run, "path string, place long, key binary, seq long, type byte, value binary")
