"""Bloom filters over byte keys, with one 32-bit Murmur3 hash and its rotation as the step.

Parquet's own filters serve real scans; these are for callers who want a filter as a value.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seed, and the constants of 32-bit Murmur3.
SEED = 0xBC9F1D34
C1, C2, C3, M1, M2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_32 = 0xFFFFFFFF


def _turn(x: int, by: int) -> int:
    return ((x << by) | (x >> (32 - by))) & _32


def murmur3(data: bytes, seed: int = SEED) -> int:
    h, whole = seed, len(data) // 4 * 4
    for k in range(0, whole, 4):
        h = (_turn(h ^ (_turn(int.from_bytes(data[k : k + 4], "little") * C1 & _32, 15) * C2 & _32), 13) * 5 + C3) & _32
    if rest := data[whole:]:
        h ^= _turn(int.from_bytes(rest, "little") * C1 & _32, 15) * C2 & _32
    h ^= len(data)
    h = (h ^ h >> 16) * M1 & _32
    h = (h ^ h >> 13) * M2 & _32
    return h ^ h >> 16


def murmur3_many(keys: list[bytes], seed: int = SEED) -> np.ndarray:
    """:func:`murmur3` of each key, keys of one length at a time."""
    out, sizes = np.zeros(len(keys), np.uint32), np.fromiter(map(len, keys), np.int64, len(keys))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        data = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), size)
        h, whole = np.full(len(at), seed, np.uint32), size // 4 * 4
        for block in np.ascontiguousarray(data[:, :whole]).view("<u4").T if whole else ():
            h = _turns(h ^ (_turns(block * np.uint32(C1), 15) * np.uint32(C2)), 13) * np.uint32(5) + np.uint32(C3)
        if size > whole:
            rest = sum(data[:, whole + k].astype(np.uint32) << np.uint32(8 * k) for k in range(size - whole))
            h = h ^ (_turns(rest * np.uint32(C1), 15) * np.uint32(C2))
        h = h ^ np.uint32(size)
        for shift, times in ((16, M1), (13, M2)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(times)
        out[at] = h ^ (h >> np.uint32(16))
    return out


def _turns(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _probes(keys: list[bytes], bits: int, k: int) -> np.ndarray:
    """Places of each key, a row a probe."""
    h = murmur3_many(keys)
    step = _turns(h, 15)  # 17 to the right
    return (h + np.arange(k, dtype=np.uint32)[:, None] * step) % np.uint32(bits)


def build(keys: Iterable[bytes], bits_per_key: int = 10) -> bytes:
    """At least 64 bits; the last byte is the number of probes."""
    keys = list(keys)
    k = max(1, min(30, int(bits_per_key * 0.69)))
    size = (max(64, len(keys) * bits_per_key) + 7) // 8
    bits = np.zeros(size * 8, np.uint8)
    bits[_probes(keys, size * 8, k)] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([k])


def may_hold_many(keys: list[bytes], made: bytes) -> np.ndarray:
    """Never false for a key of the filter.  A filter that can't be read may hold anything."""
    if len(made) < 2 or made[-1] > 30:
        return np.ones(len(keys), bool)
    at, held = _probes(keys, (len(made) - 1) * 8, made[-1]), np.frombuffer(made, np.uint8)
    return (held[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).all(axis=0)


def may_hold(key: bytes, made: bytes) -> bool:
    return bool(may_hold_many([key], made)[0])


def may_hold_column(key: Column, made: bytes) -> Column:
    """:func:`may_hold` over a column of binary keys, for a filter of bounded size; false for null."""

    @F.pandas_udf("boolean")
    def probe(keys: pd.Series) -> pd.Series:
        there = keys.notna()
        out = pd.Series(False, keys.index)
        out[there] = may_hold_many([bytes(x) for x in keys[there]], made)
        return out

    return probe(key.cast("binary"))
