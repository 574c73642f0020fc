"""Spark readers and writers of foreign log and table files.

``read_wal`` and ``read_tables`` decode whole files on the executors, a file in a task. The data source ``strata-table`` reads tables,
too, and leaves out files and blocks that can't hold the key of a pushed-down equality filter.
"""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from strata.functions import record
from strata.operators.blocks import ENTRY_OVERHEAD
from strata.schema import TABLE_ENTRY, WAL
from strata.sources.files import write_blobs
from strata.sources.tables import MAGIC, Table, write_table

ROWS = 10_000  # of a file that are in memory at a time
FILE_BYTES = 64 << 20
TABLE_END = MAGIC.to_bytes(8, "little").decode("latin-1")


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_wal(spark: SparkSession, path: str, torn: str = "drop") -> DataFrame:
    """Log files -> op, k, v, seq, crc. A log has no marks to split it at: a file is a task."""

    def decode(batches):
        for batch in batches:
            for data in batch.column("content"):
                found = record.scan(data.as_py(), torn)
                while rows := list(islice(found, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], WAL.names)

    return _binary_files(spark, path).select("content").mapInArrow(decode, WAL)


def wal_bytes(log: DataFrame) -> DataFrame:
    """A log (seq, op, k, v) -> seq, record: the bytes of each record, without leaving the JVM."""
    return log.select("seq", record.encode(F.col("op"), F.col("k"), F.col("v"), F.col("seq")).alias("record"))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Table files -> path, block_no, k, v. Blocks are numbered through over the files of a run that ``write_tables`` wrote."""

    def decode(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = Table(data.as_py()).entries()
                while rows := list(islice(found, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary())))], ["path", *TABLE_ENTRY.names])

    return _binary_files(spark, path).mapInArrow(decode, "path string, block_no int, k binary, v binary")


def write_wal(log: DataFrame, path: str) -> str:
    """A log (seq, op, k, v) as log files, sorted by sequence number over all of them (names say the order of parts); gives the folder.

    A file ends with one byte more, which is too short for a record and ends reading.
    """

    def join(batches):
        held, size = [], 0
        for batch in batches:
            for raw in batch.column("record").to_pylist():
                held.append(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["data"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["data"])

    return write_blobs(wal_bytes(log.sort("seq")).select("record").mapInArrow(join, "data binary"), F.col("data"), "\n", path)


def write_tables(runs: DataFrame, path: str, block_size: int = 4096) -> str:
    """Sorted runs (run, k, v; keys unique in a run) as table files, a few to each run where it is large; gives the folder.

    A run goes through one task, in the order of its keys, as its blocks are cut by one pass from its first entry on. A file ends where
    its run does, or with the first block that ends past FILE_BYTES, and says how many blocks of the run are in files before it. The
    magic number at a file's end is what the writer ends a line with.
    """

    def cut(batches):
        held, size, at = [], 0, None
        before = blocks = filled = 0  # blocks before this file, blocks that are full, bytes in the one that isn't

        def done():
            return pa.RecordBatch.from_arrays([pa.array([write_table(held, block_size, before)[: -len(TABLE_END)]], pa.binary())], ["data"])

        for batch in batches:
            for run, k, v in zip(*(batch.column(c).to_pylist() for c in ("run", "k", "v"))):
                if held and (run != at or (size >= FILE_BYTES and not filled)):
                    yield done()
                    held, size, before = [], 0, blocks
                if run != at:
                    at, before, blocks, filled = run, 0, 0, 0
                held.append((k, v))
                size += len(k) + len(v)
                filled += len(k) + len(v) + ENTRY_OVERHEAD
                if filled >= block_size:
                    blocks, filled = blocks + 1, 0
        if held:
            yield done()

    rows = runs.select("run", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v")).repartition("run").sortWithinPartitions("run", "k")
    return write_blobs(rows.mapInArrow(cut, "data binary"), F.col("data"), TABLE_END, path)


def find_in_tables(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """path, v of the table files that hold a key, by their filters and indexes; read through Spark, from any store."""

    def find(batches):
        for batch in batches:
            found = [(path, Table(data.as_py()).find(key)) for path, data in zip(batch.column("path").to_pylist(), batch.column("content"))]
            found = [x for x in found if x[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], ["path", "v"])

    return _binary_files(spark, path).mapInArrow(find, "path string, v binary")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TableReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.keys = paths, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("k",):
                self.keys.append(bytes(f.value))
            yield f  # Spark checks the rows again

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            table = Table(f.read())
        for key in self.keys[:1]:
            value = table.find(key)
            if value is not None:
                number = next(i for i, b in enumerate(table.index) if b[0] >= key)
                yield table.before + number, key, value
            return
        yield from table.entries()


class TableSource(DataSource):
    """Option path: a table file or a folder of them, on a disk that all nodes share."""

    @classmethod
    def name(cls):
        return "strata-table"

    def schema(self):
        return TABLE_ENTRY

    def reader(self, schema):
        from pathlib import Path

        path = Path(self.options["path"])
        return _TableReader([str(p) for p in (sorted(path.glob("**/*.sst")) if path.is_dir() else [path])])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)
