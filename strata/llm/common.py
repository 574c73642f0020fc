"""Shared pieces: the shared scratch folder, written tables that cut lineage, and binary files through Spark's own writers."""

from __future__ import annotations

import ctypes
import gc
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources import files
from strata.sources.files import scratch

REPLICAS = 16  # salts that spread one hot key in joins
BROADCAST_ROWS = 50_000  # small rows of a stored table that are broadcast at most


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: nothing is computed twice, and a lost executor costs no more than its running tasks."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing will read again. Others stay until the shared folder is cleared."""
    for df in tables:
        if path := _paths.pop(df, None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_held: dict = {}


def held_by_worker(key, make):
    """What ``make`` gives, kept in this Python worker until it is asked for another key: workers go from task to task, and hold the tables of one operator at most. None empties it."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # freed pages go back to the system
                trim(0)
        if key is not None:
            _held[key] = make()
    return _held.get(key)


def salted_left(rows: DataFrame, groups: DataFrame, key: str, by: str, replicas: int = REPLICAS) -> DataFrame:
    """rows LEFT JOIN groups USING (key), for a key that may hold a third of all rows.

    ``groups`` is a stored table with one small row per key. It is counted, and broadcast up to BROADCAST_ROWS; beyond that it is
    repeated once for each salt, and ``rows`` are dealt over the salts by a hash of ``by``.
    """
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, "left")
    salt = unused("salt", rows, groups)
    left = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(replicas)).cast("int"))
    right = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return left.join(right.hint("merge"), [key, salt], "left").drop(salt)


def split_join(rows: DataFrame, groups: DataFrame, key: str, by: str, most: int = 10_000) -> DataFrame:
    """rows JOIN groups USING (key), for large ``groups``: of a key with more than ``most`` rows, groups are repeated and rows dealt over the copies by a hash of ``by``."""
    salt, copies = unused("salt", rows, groups), unused("copies", rows, groups)
    hot = cut(rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(copies)).where(F.col(copies) > 1))
    if hot.isEmpty():
        return rows.join(groups, key)
    n = F.coalesce(copies, F.lit(1))
    left = salted_left(rows, hot, key, by).withColumn(salt, F.pmod(F.xxhash64(by), n).cast("int"))
    right = salted_left(groups, hot, key, key).withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1)))
    return left.drop(copies).join(right.drop(copies), [key, salt]).drop(salt)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_blobs(df: DataFrame, column: str, trailer: str) -> str:
    """One file for each row of binary ``column``, ended by ``trailer``, which the format of the file has to allow there; gives the folder."""
    return files.write_blobs(df, F.col(column), trailer, scratch(df.sparkSession))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder of write_blobs: path, content."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
