"""Binary log records: size, checksum, payload, key and value with lengths, sequence number.

Encoding is a column expression. Decoding goes through a file record by record, as lengths lead from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.binary import Reader, Writer, crc32, pack_bytes, pack_uint
from strata.schema import OPS

FIXED = 25  # bytes of a record besides key and value


class Corrupt(ValueError):
    """A record that can't be read."""


def op_number(op: Column) -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in OPS]), op) - 1


def payload(op: Column, k: Column, v: Column, seq: Column) -> Column:
    return F.concat(pack_uint(op_number(op), 1), pack_bytes(k), pack_bytes(v), pack_uint(seq, 8))


def checksum(op: Column, k: Column, v: Column, seq: Column) -> Column:
    return F.crc32(payload(op, k, v, seq))


def size(k: Column, v: Column) -> Column:
    return F.octet_length(k) + F.octet_length(v) + FIXED


def encode(op: Column, k: Column, v: Column, seq: Column) -> Column:
    """The record as bytes."""
    body = payload(op, k, v, seq)
    return F.concat(pack_uint(size(k, v), 4), pack_uint(F.crc32(body), 4), body)


def describe(op: Column, k: Column, v: Column, seq: Column, crc: Column | None = None) -> Column:
    """The record as a line of text."""
    crc = checksum(op, k, v, seq) if crc is None else crc
    fields = zip(("序列号", "操作类型", "键", "值", "CRC"), ("", "", "'", "'", ""), (seq.cast("string"), op, k.cast("string"), v.cast("string"), F.lower(F.hex(crc))))
    shown = [F.concat(F.lit(f"{name}={quote}"), value, F.lit(quote)) for name, quote, value in fields]
    return F.concat(F.lit("WalRecord("), F.concat_ws(", ", *shown), F.lit(")"))


def to_bytes(op: str, k: bytes, v: bytes, seq: int) -> bytes:
    body = Writer()
    body.uint(OPS.index(op), 1)
    body.string(k)
    body.string(v)
    body.uint(seq, 8)
    raw = body.getvalue()
    return (len(raw) + 8).to_bytes(4, "little") + crc32(raw).to_bytes(4, "little") + raw


def from_bytes(data: bytes) -> tuple[str, bytes, bytes, int, int]:
    """(op, key, value, seq, checksum) of exactly one record."""
    if not data:
        raise Corrupt("no data")
    r = Reader(data)
    try:
        if r.uint(4) != len(data):
            raise Corrupt("the record has another size")
        crc = r.uint(4)
        if crc32(data[8:]) != crc:
            raise Corrupt("the checksum doesn't hold")
        number, k, v, seq = r.uint(1), r.string(), r.string(), r.uint(8)
    except ValueError as e:
        raise Corrupt(str(e)) from e
    if number >= len(OPS):
        raise Corrupt(f"operation {number} is unknown")
    return OPS[number], k, v, seq, crc


def scan(data: bytes, torn: str = "drop") -> Iterator[tuple[str, bytes, bytes, int, int]]:
    """The records of a log. A last record that is cut off is dropped, or is an error (``torn="raise"``); damage before it always is."""
    at = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        if at + size > len(data):
            if torn == "raise":
                raise Corrupt(f"the record at {at} is cut off")
            return
        if size < FIXED:
            raise Corrupt(f"the record at {at} has size {size}")
        yield from_bytes(data[at : at + size])
        at += size
