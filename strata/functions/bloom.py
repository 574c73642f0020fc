"""Bloom filters that match the foreign table files bit by bit: double hashing with 128-bit Murmur3 (x64, seed 0).

For data of its own the engine uses Parquet's bloom filters; these are for foreign files, and as aggregate and predicate on columns.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 256 << 20
MASK = (1 << 64) - 1
M1, M2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _turn(x: int, r: int) -> int:
    return (x << r | x >> (64 - r)) & MASK


def _final(x: int) -> int:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * m & MASK
    return x ^ x >> 33


def murmur3(data: bytes) -> tuple[int, int]:
    """Both halves of MurmurHash3_x64_128 with seed 0."""
    a = b = 0
    whole = len(data) // 16
    for lo, hi in struct.iter_unpack("<QQ", data[: 16 * whole]):
        a = (_turn(a ^ _turn(lo * M1 & MASK, 31) * M2 & MASK, 27) + b) * 5 + 0x52DCE729 & MASK
        b = (_turn(b ^ _turn(hi * M2 & MASK, 33) * M1 & MASK, 31) + a) * 5 + 0x38495AB5 & MASK
    tail = data[16 * whole :]
    if len(tail) > 8:
        b ^= _turn(int.from_bytes(tail[8:], "little") * M2 & MASK, 33) * M1 & MASK
    if tail:
        a ^= _turn(int.from_bytes(tail[:8], "little") * M1 & MASK, 31) * M2 & MASK
    a, b = a ^ len(data), b ^ len(data)
    a = a + b & MASK
    b = a + b & MASK
    a, b = _final(a), _final(b)
    a = a + b & MASK
    return a, a + b & MASK


def murmur3_many(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves for many keys, those of a length at a time."""
    out = np.zeros((2, len(keys)), np.uint64)
    lengths = np.array([len(k) for k in keys], np.int64)
    word = lambda x: np.uint64(x)
    turn = lambda x, r: x << word(r) | x >> word(64 - r)

    def final(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> word(33)) * word(m)
        return x ^ x >> word(33)

    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        blocks, tail = divmod(size, 16)
        raw = b"".join(keys[i] + bytes(-size % 16) for i in at.tolist())
        halves = np.frombuffer(raw, "<u8").reshape(len(at), -1, 2) if size else np.zeros((len(at), 0, 2), np.uint64)
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for i in range(blocks):
            a = (turn(a ^ turn(halves[:, i, 0] * word(M1), 31) * word(M2), 27) + b) * word(5) + word(0x52DCE729)
            b = (turn(b ^ turn(halves[:, i, 1] * word(M2), 33) * word(M1), 31) + a) * word(5) + word(0x38495AB5)
        if tail:  # zeros behind a short half change nothing
            b = b ^ turn(halves[:, blocks, 1] * word(M2), 33) * word(M1)
            a = a ^ turn(halves[:, blocks, 0] * word(M1), 31) * word(M2)
        a, b = a ^ word(size), b ^ word(size)
        a = a + b
        b = a + b
        a, b = final(a), final(b)
        a = a + b
        out[0, at], out[1, at] = a, a + b
    return out[0], out[1]


def shape(items: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions) for a number of items and a rate of false positives."""
    bits = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
    return bits, round(bits / items * math.log(2)) if items else 0


class Bloom:
    def __init__(self, bits: int, hashes: int, data: np.ndarray | None = None):
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros(-(-bits // 8), np.uint8) if data is None else data

    @classmethod
    def sized(cls, items: int, rate: float = 0.01) -> "Bloom":
        return cls(*shape(items, rate))

    def _places(self, key: bytes) -> list[int]:
        a, b = murmur3(key)
        return [(a + i * b & MASK) % self.bits for i in range(self.hashes)]

    def add(self, key: bytes) -> None:
        for p in self._places(key):
            self.data[p >> 3] |= 1 << (p & 7)

    def contains(self, key: bytes) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self._places(key))

    def _places_many(self, keys: list[bytes]) -> np.ndarray:
        a, b = murmur3_many(keys)
        return (a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]) % np.uint64(max(1, self.bits))

    def add_many(self, keys: list[bytes]) -> None:
        places = self._places_many(keys).ravel()
        np.bitwise_or.at(self.data, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))

    def contains_many(self, keys: list[bytes]) -> np.ndarray:
        places = self._places_many(keys)
        return (self.data[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool).all(1)

    def merge(self, other: "Bloom") -> "Bloom":
        return Bloom(self.bits, self.hashes, self.data | other.data)

    def size_in_bytes(self) -> int:
        return len(self.data)

    def to_bytes(self) -> bytes:
        return struct.pack("<IQ", self.hashes, self.bits) + self.data.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Bloom | None":
        """None if bytes are missing."""
        if len(raw) < 12:
            return None
        hashes, bits = struct.unpack_from("<IQ", raw)
        size = -(-bits // 8)
        return cls(bits, hashes, np.frombuffer(raw, np.uint8, size, 12).copy()) if len(raw) >= 12 + size else None


def bloom_agg(keys: DataFrame, items: int, rate: float = 0.01) -> DataFrame:
    """One row (bloom): a filter of all keys (k). Each task fills its own; tasks' filters are merged with or."""
    bits, hashes = shape(max(1, items), rate)

    def fill(batches):
        bloom = Bloom(bits, hashes)
        for batch in batches:
            bloom.add_many([bytes(k) for k in batch["k"]])
        yield pd.DataFrame({"bloom": [bloom.to_bytes()]})

    def merge(_, pdf: pd.DataFrame) -> pd.DataFrame:
        out = Bloom(bits, hashes)
        for raw in pdf["bloom"]:
            out = out.merge(Bloom.from_bytes(raw))
        return pd.DataFrame({"bloom": [out.to_bytes()]})

    parts = keys.select(F.col("k").cast("binary").alias("k")).mapInPandas(fill, "bloom binary")
    # in two steps, so that no task merges more than the square root of the tasks' filters
    some = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("g").applyInPandas(merge, "bloom binary")
    return some.groupBy(F.lit(0).alias("g")).applyInPandas(merge, "bloom binary")


def might_contain(keys: DataFrame, column: str, made: DataFrame, name: str = "found") -> DataFrame:
    """keys with a column that says whether the filter of ``made`` (of bloom_agg) may hold ``column``. Each worker process reads the filter once; it is broadcast up to BROADCAST_BYTES, and an error beyond."""
    raw = bytes(made.first().bloom)
    if len(raw) > BROADCAST_BYTES:
        raise ValueError(f"a filter of {len(raw)} bytes is too large to be on every node")
    shared = keys.sparkSession.sparkContext.broadcast(raw)

    @F.arrow_udf(T.BooleanType())
    def held(column: pa.Array) -> pa.Array:
        bloom = Bloom.from_bytes(shared.value)
        return pa.array(bloom.contains_many(column.cast(pa.binary()).to_pylist()))

    return keys.withColumn(name, held(F.col(column).cast("binary")))
