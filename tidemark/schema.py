"""Row types and key helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETION, VALUE = 0, 1
MAX_SEQUENCE = (1 << 56) - 1
LEVELS = 7

MUTATION = T.StructType(
    [T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("type", T.ByteType(), False), T.StructField("value", T.BinaryType())]
)
FILE_META = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("number", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("smallest_key", T.BinaryType()),
        T.StructField("largest_key", T.BinaryType()),
    ]
)


def successor(prefix):
    """The least key above all that begin with ``prefix``; None if there is none.  For strings, the last code point
    that can grow does."""
    if isinstance(prefix, str):
        for k in range(len(prefix) - 1, -1, -1):
            if ord(prefix[k]) < 0x10FFFF:
                up = ord(prefix[k]) + 1
                return prefix[:k] + chr(0xE000 if 0xD800 <= up < 0xE000 else up)
        return None
    body = bytes(prefix).rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def in_prefix(key: Column, prefix) -> Column:
    """Prefix test as a half-open range, which scans can push down on binary keys too."""
    low, high = key >= F.lit(prefix), successor(prefix)
    return low if high is None else low & (key < F.lit(high))
