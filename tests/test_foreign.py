import pytest
from pyspark.errors import PythonException

from strata.functions import record
from strata.operators.blocks import ENTRY_OVERHEAD, cut_blocks
from strata.sources import foreign
from strata.sources.tables import Table, write_table


def test_logs_are_read_in_order(spark, tmp_path):
    ops = [("PUT", b"k1", b"v1", 1), ("PUT", b"k2", b"v2", 2), ("REMOVE", b"k1", b"", 3), ("CLEAR", b"", b"", 4)]
    raw = b"".join(record.to_bytes(*o) for o in ops)
    (tmp_path / "a.wal").write_bytes(raw + record.to_bytes("PUT", b"x", b"y", 5)[:-1])
    found = foreign.read_wal(spark, str(tmp_path / "a.wal")).collect()
    assert [(r.op, bytes(r.k), bytes(r.v), r.seq) for r in found] == ops
    with pytest.raises(PythonException):
        foreign.read_wal(spark, str(tmp_path / "a.wal"), torn="raise").collect()


def test_encoded_log_is_read_back(spark, tmp_path):
    log = spark.createDataFrame([(1, "PUT", "a", "1"), (2, "REMOVE", "a", "")], "seq long, op string, k string, v string")
    raw = b"".join(bytes(r.record) for r in foreign.wal_bytes(log).orderBy("seq").collect())
    (tmp_path / "b.wal").write_bytes(raw)
    assert [(r.seq, r.op, bytes(r.k)) for r in foreign.read_wal(spark, str(tmp_path / "b.wal")).collect()] == [(1, "PUT", b"a"), (2, "REMOVE", b"a")]


def test_tables_and_pushed_keys(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"sstable-L0-{n:06d}.sst").write_bytes(write_table([(f"k{i:04d}".encode(), f"v{n}".encode()) for i in range(n * 500, n * 500 + 500)]))
    assert foreign.read_tables(spark, str(tmp_path)).count() == 1500
    foreign.register(spark)
    df = spark.read.format("strata-table").option("path", str(tmp_path)).load()
    assert df.count() == 1500
    found = df.where(df.k == bytearray(b"k0700")).collect()
    assert [bytes(r.v) for r in found] == [b"v1"]
    assert df.where(df.k == bytearray(b"nothing")).count() == 0


def test_damaged_table_is_an_error(spark, tmp_path):
    (tmp_path / "bad.sst").write_bytes(b"x" * 100)
    with pytest.raises(PythonException):
        foreign.read_tables(spark, str(tmp_path)).count()


def wide_runs(spark):
    """Three runs, and (block, key) of every entry, by a pass over each run."""
    rows = [(run, f"k{i:04d}", "v" * (i * 7 % 50)) for run in range(3) for i in range(400)]
    expected = []
    for run in range(3):
        found = sorted(r for r in rows if r[0] == run)
        for no, (a, b) in enumerate(cut_blocks([len(k) + len(v) + ENTRY_OVERHEAD for _, k, v in found], 512)):
            expected += [(no, k, v) for _, k, v in found[a:b]]
    return spark.createDataFrame(rows, "run long, k string, v string").repartition(7), sorted(expected)


def test_blocks_of_a_run_are_numbered_through_over_partitions(spark, tmp_path):
    runs, expected = wide_runs(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = foreign.read_tables(spark, foreign.write_tables(runs, str(tmp_path / "t"), 512)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.block_no, r.k.decode(), r.v.decode()) for r in found) == expected
    assert len({r.path for r in found}) == 3


def test_blocks_of_a_run_are_numbered_through_over_files(spark, tmp_path, monkeypatch):
    runs, expected = wide_runs(spark)
    monkeypatch.setattr(foreign, "FILE_BYTES", 3000)
    path = foreign.write_tables(runs, str(tmp_path / "t"), 512)
    found = foreign.read_tables(spark, path).collect()
    assert len({r.path for r in found}) > 9
    assert sorted((r.block_no, r.k.decode(), r.v.decode()) for r in found) == expected
    assert len(foreign.find_in_tables(spark, path, b"k0399").collect()) == 3


def test_no_runs_no_entries(spark, tmp_path):
    runs = wide_runs(spark)[0].where("run > 2")
    assert foreign.read_tables(spark, foreign.write_tables(runs, str(tmp_path / "t"), 512)).collect() == []


def test_a_later_file_of_a_run_keeps_its_layout():
    entries = [(f"k{i:03d}".encode(), b"v" * 20) for i in range(100)]
    first, later = write_table(entries, 512), write_table(entries, 512, 7)
    assert len(later) == len(first) + 8 and later[:-48] == first[:-40] and later[-40:] == first[-40:]
    assert [(n + 7, k, v) for n, k, v in Table(first).entries()] == list(Table(later).entries())
    assert Table(later).find(b"k099") == b"v" * 20 and Table(later).find(b"k100") is None
