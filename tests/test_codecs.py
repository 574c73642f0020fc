import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions import binary, names, record
from strata.functions.bloom import Bloom, bloom_agg, might_contain, murmur3, murmur3_many, shape
from strata.sources import manifest
from strata.sources.tables import Table, write_table


def test_reader_and_writer_agree():
    w = binary.Writer()
    assert w.uint(0x12345678, 4) and w.uint(0x1122334455667788, 8) and w.string(b"hello")
    assert w.getvalue()[:4] == bytes([0x78, 0x56, 0x34, 0x12])
    r = binary.Reader(w.getvalue())
    assert (r.uint(4), r.uint(8), r.string()) == (0x12345678, 0x1122334455667788, b"hello")


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        binary.Reader(b"\1").uint(4)
    with pytest.raises(ValueError):
        binary.Reader(struct.pack("<I", 8) + b"ab").string()
    assert not binary.Writer(2).uint(1, 4)


def test_crc_value():
    assert binary.crc32(b"123456789") == 0xCBF43926


@settings(max_examples=50, deadline=None)
@given(st.sampled_from(["PUT", "REMOVE", "CLEAR"]), st.binary(max_size=40), st.binary(max_size=60), st.integers(0, 2**63 - 1))
def test_records_come_back(op, k, v, seq):
    raw = record.to_bytes(op, k, v, seq)
    assert len(raw) == record.FIXED + len(k) + len(v)
    assert record.from_bytes(raw)[:4] == (op, k, v, seq)


def test_record_layout():
    raw = record.to_bytes("REMOVE", b"k", b"vv", 7)
    body = b"\1" + struct.pack("<I", 1) + b"k" + struct.pack("<I", 2) + b"vv" + struct.pack("<Q", 7)
    assert raw == struct.pack("<II", len(body) + 8, zlib.crc32(body)) + body


def test_damaged_records_are_refused():
    raw = bytearray(record.to_bytes("PUT", b"k", b"v", 1))
    with pytest.raises(record.Corrupt):
        record.from_bytes(bytes(raw[:2]))
    with pytest.raises(record.Corrupt):
        record.from_bytes(b"")
    raw[8] ^= 1
    with pytest.raises(record.Corrupt):
        record.from_bytes(bytes(raw))


def test_torn_tail_is_dropped_and_damage_before_it_is_not():
    a, b = record.to_bytes("PUT", b"a", b"1", 1), record.to_bytes("PUT", b"b", b"2", 2)
    assert [r[1] for r in record.scan(a + b[:-3])] == [b"a"]
    with pytest.raises(record.Corrupt):
        list(record.scan(a + b[:-3], torn="raise"))
    broken = bytearray(a)
    broken[12] ^= 1
    with pytest.raises(record.Corrupt):
        list(record.scan(bytes(broken) + b))


def test_columns_encode_like_the_driver(spark):
    rows = [("PUT", "ké", "v" * 300, 1), ("REMOVE", "", "", 1 << 40), ("CLEAR", "", "", 2)]
    op, k, v, seq = (F.col(c) for c in ("op", "k", "v", "seq"))
    df = spark.createDataFrame(rows, "op string, k string, v string, seq long")
    found = df.select("*", record.encode(op, k, v, seq).alias("raw"), record.checksum(op, k, v, seq).alias("crc"), record.describe(op, k, v, seq).alias("text")).collect()
    for r in found:
        assert bytes(r.raw) == record.to_bytes(r.op, r.k.encode(), r.v.encode(), r.seq)
        assert r.crc == record.from_bytes(bytes(r.raw))[4]
        assert f"键='{r.k}'" in r.text and f"CRC={r.crc:x})" in r.text


def test_murmur_known_values():
    assert murmur3(b"") == (0, 0)
    assert murmur3(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert murmur3(b"The quick brown fox jumps over the lazy dog") == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)


def test_bloom_shape_and_no_false_negative():
    assert shape(1000) == (9586, 7)
    bloom = Bloom.sized(1000)
    keys = [f"k{i}".encode() for i in range(1000)]
    for k in keys:
        bloom.add(k)
    assert all(map(bloom.contains, keys))
    assert sum(bloom.contains(f"x{i}".encode()) for i in range(5000)) < 150
    again = Bloom.from_bytes(bloom.to_bytes())
    assert all(map(again.contains, keys)) and (again.bits, again.hashes) == (9586, 7)
    assert Bloom.from_bytes(bloom.to_bytes()[:-1]) is None and bloom.size_in_bytes() == 1199


def test_bloom_as_aggregate(spark):
    keys = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"))
    made = bloom_agg(keys, 300)
    assert might_contain(keys, "k", made).where("found").count() == 300
    assert might_contain(keys.select(F.concat(F.lit("x"), "k").alias("k")), "k", made, "f").where("f").count() < 30


def test_murmur_of_many_keys():
    rnd = random.Random(1)
    keys = [rnd.randbytes(n % 50) for n in range(500)]
    assert list(zip(*(x.tolist() for x in murmur3_many(keys)))) == [murmur3(k) for k in keys]
    one, many = Bloom.sized(500), Bloom.sized(500)
    for k in keys:
        one.add(k)
    many.add_many(keys)
    assert one.to_bytes() == many.to_bytes()
    probes = [rnd.randbytes(9) for _ in range(2000)]
    assert many.contains_many(probes).tolist() == [one.contains(p) for p in probes]


def test_table_file_round_trip():
    entries = sorted((f"k{i:05d}".encode(), b"v" * (i % 90)) for i in range(2000))
    data = write_table(entries)
    table = Table(data)
    assert [(k, v) for _, k, v in table.entries()] == entries and len(table.index) > 5
    assert table.find(b"k00042") == b"v" * 42 and table.find(b"z") is None and table.find(b"k00042x") is None
    assert all(size >= 4096 for _, _, size in table.index[:-1])
    with pytest.raises(ValueError):
        Table(data[:-1] + b"\0")
    with pytest.raises(ValueError):
        write_table([])


def test_foreign_manifest_round_trip():
    raw = manifest.to_foreign(42, {0: ["a", "b"], 1: ["c"]})
    assert manifest.from_foreign(raw) == (42, {0: ["a", "b"], 1: ["c"]})
    with pytest.raises(ValueError):
        manifest.from_foreign(bytes([raw[0] ^ 1]) + raw[1:])


def test_own_manifest_round_trip():
    m = manifest.Manifest(3, 42, runs=(manifest.Run(0, 1, "p", 5, 9), manifest.Run(1, 2, "q", 5, 3), manifest.Run(0, 4, "r", 1, 12)), streams={"s": 4})
    assert manifest.Manifest.from_bytes(m.to_bytes()) == m
    assert [r.path for r in m.ordered_runs()] == ["r", "p", "q"]
    with pytest.raises(ValueError):
        manifest.Manifest.from_bytes(b"0" * 8 + m.to_bytes()[8:])


def test_names(spark):
    rows = [("sstable-L3-000012.sst", 3, 12), ("sstable-9.sst", 0, 9), ("sstable-L-1.sst", 0, 1), ("x", 0, 0), ("sstable-L1-99999999999999999999.sst", 1, 0)]
    df = spark.createDataFrame([(r[0],) for r in rows], "n string").select("n", names.table_level(F.col("n")), names.table_number(F.col("n")))
    assert [tuple(r) for r in df.collect()] == rows
    assert names.table_name(1, 7) == "sstable-L1-000007.sst"
