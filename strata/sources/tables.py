"""Foreign sorted table files: blocks of entries, block index, Bloom filter, footer."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

from strata.functions.binary import Reader, Writer
from strata.functions.bloom import Bloom
from strata.operators.blocks import ENTRY_OVERHEAD, cut_blocks

MAGIC, FOOTER = 0x4B56444253535441, struct.Struct("<5Q")


def write_table(entries: list[tuple[bytes, bytes]], block_size: int = 4096, before: int = 0) -> bytes:
    """The file of sorted, unique entries. No entries, no file: ValueError.

    If ``before`` blocks of the same run are in other files, their number is written ahead of the footer, where nothing else points to.
    """
    if not entries:
        raise ValueError("a table needs an entry")
    out, index = Writer(), Writer()
    for a, b in cut_blocks([len(k) + len(v) + ENTRY_OVERHEAD for k, v in entries], block_size):
        start = out.offset
        for k, v in entries[a:b]:
            out.string(k)
            out.string(v)
        index.string(entries[b - 1][0])
        index.uint(start, 8)
        index.uint(out.offset - start, 8)
    bloom = Bloom.sized(len(entries))
    for k, _ in entries:
        bloom.add(k)
    index_at, bloom_raw = out.offset, bloom.to_bytes()
    out.raw(index.getvalue())
    bloom_at = out.offset
    out.raw(bloom_raw)
    if before:
        out.uint(before, 8)
    out.raw(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(bloom_raw), MAGIC))
    return out.getvalue()


class Table:
    """A table file held in memory. Damage is an error; nothing is skipped. Entries have the numbers of blocks in their run."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER.size:
            raise ValueError("too short for a table")
        index_at, index_size, bloom_at, bloom_size, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a table")
        self.data = data
        self.index: list[tuple[bytes, int, int]] = []
        r = Reader(data[index_at : index_at + index_size])
        while r.offset < index_size:
            self.index.append((r.string(), r.uint(8), r.uint(8)))
        self.bloom = Bloom.from_bytes(data[bloom_at : bloom_at + bloom_size]) if bloom_size else None
        if bloom_size and self.bloom is None:
            raise ValueError("the Bloom filter is cut off")
        more = data[max(index_at + index_size, bloom_at + bloom_size) : -FOOTER.size]
        self.before = int.from_bytes(more, "little") if len(more) == 8 else 0

    def block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size = self.index[number]
        r = Reader(self.data[at : at + size])
        while r.offset < size:
            yield r.string(), r.string()

    def find(self, key: bytes) -> bytes | None:
        if self.bloom and not self.bloom.contains(key):
            return None
        number = bisect.bisect_left(self.index, key, key=lambda record: record[0])
        return dict(self.block(number)).get(key) if number < len(self.index) else None

    def entries(self) -> Iterator[tuple[int, bytes, bytes]]:
        for number in range(len(self.index)):
            for k, v in self.block(number):
                yield self.before + number, k, v
