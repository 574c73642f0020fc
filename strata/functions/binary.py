"""Little-endian binary codec: columns on the JVM, and a bounds-checked reader and writer for driver and worker code."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_uint(value: Column, size: int) -> Column:
    """An unsigned number as ``size`` little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def pack_bytes(value: Column) -> Column:
    """Length (4 bytes) and bytes."""
    value = value.cast("binary")
    return F.concat(pack_uint(F.octet_length(value), 4), value)


def unpack_uint(data: Column, at: int | Column, size: int) -> Column:
    """The number in ``size`` little-endian bytes from ``at`` (0 is first); up to 8 bytes, as a signed long."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.concat(*[F.hex(F.substring(data, at + i + 1, F.lit(1))) for i in reversed(range(size))])
    return F.conv(digits, 16, -10).cast("long")


def crc32(data: bytes) -> int:
    """IEEE CRC-32; the SQL function crc32 gives the same."""
    return zlib.crc32(data)


class Writer:
    """A growing buffer, or one of fixed ``capacity``, whose writes then give False where they don't fit."""

    def __init__(self, capacity: int | None = None):
        self.capacity, self.parts, self.offset = capacity, [], 0

    def raw(self, data: bytes) -> bool:
        if self.capacity is not None and self.offset + len(data) > self.capacity:
            return False
        self.parts.append(data)
        self.offset += len(data)
        return True

    def uint(self, value: int, size: int) -> bool:
        return self.raw(value.to_bytes(size, "little"))

    def string(self, data: bytes) -> bool:
        return self.raw(struct.pack("<I", len(data)) + data)

    def getvalue(self) -> bytes:
        return b"".join(self.parts)


class Reader:
    """Reads from bytes; ValueError past the end."""

    def __init__(self, data: bytes):
        self.data, self.offset = data, 0

    def raw(self, size: int) -> bytes:
        if size < 0 or self.offset + size > len(self.data):
            raise ValueError(f"{size} bytes at {self.offset} go past the end of {len(self.data)}")
        self.offset += size
        return self.data[self.offset - size : self.offset]

    def uint(self, size: int) -> int:
        return int.from_bytes(self.raw(size), "little")

    def string(self) -> bytes:
        return self.raw(self.uint(4))
