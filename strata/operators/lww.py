"""The latest-write reducer and what follows from it: live view, lookups, replay, runs and their merge.

All of these take a log (seq, op, k, v). The latest record of each key is found by ``max`` over (seq, op, v) as a struct: Spark combines
it on the map side, so that a key with a third of all records sends one row per task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.schema import CLEAR, PUT


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The latest record of each key (and of further columns ``by``), tombstones included; CLEAR records have no part."""
    keys = [*by, "k"]
    last = log.where(F.col("op") != CLEAR).groupBy(*keys).agg(F.max(F.struct("seq", "op", "v")).alias("w"))
    return last.select(*keys, "w.seq", "w.op", "w.v")


def is_live(op: str | Column = "op", v: str | Column = "v") -> Column:
    """A put of the empty string is a removal."""
    op, v = (F.col(c) if isinstance(c, str) else c for c in (op, v))
    return (op == PUT) & (v != "")


def live(log: DataFrame) -> DataFrame:
    """k, v, seq of the keys that are there."""
    return latest(log).where(is_live()).select("k", "v", "seq")


def after_clear(log: DataFrame) -> DataFrame:
    """The records after the last CLEAR; all of them if there is none. The last CLEAR is one row, and is broadcast."""
    last = log.where(F.col("op") == CLEAR).agg(F.max("seq").alias("cleared"))
    return log.join(F.broadcast(last), F.coalesce(F.col("seq") > F.col("cleared"), F.lit(True))).drop("cleared")


def replay(log: DataFrame) -> DataFrame:
    """What a memtable holds after the whole log has gone through it: the latest record of each key after the last CLEAR."""
    return latest(after_clear(log))


def get(log: DataFrame, key: str) -> DataFrame:
    """k, v of one key if it is live; the key's filter reaches the scan."""
    return live(log.where(F.col("k") == key)).select("k", "v")


def multi_get(log: DataFrame, probes: DataFrame, ordinal: str | None = None) -> DataFrame:
    """For each probe (k, and ``ordinal`` if named), in one job, its value or null. The log is cut to the probed keys before it is reduced."""
    asked = probes.select("k").distinct()
    found = live(log.join(asked, "k", "left_semi")).select("k", "v")
    out = probes.join(found, "k", "left")
    return out.orderBy(ordinal) if ordinal else out


def existing(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that are live."""
    return keys.join(live(log).select("k"), "k", "left_semi")


def missing(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that are not live."""
    return keys.join(live(log).select("k"), "k", "left_anti")


def remove_results(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, removed): whether a removal finds the key. Only these append a record."""
    there = live(log).select("k", F.lit(True).alias("removed"))
    return keys.join(there, "k", "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def merge_runs(runs: DataFrame, drop_removed: bool = True) -> DataFrame:
    """Sorted runs (level, number, k, op, v) -> the newest entry of each key: lower levels first, then higher numbers."""
    first = F.min(F.struct("level", F.negative("number").alias("age"), "op", "v")).alias("w")
    out = runs.groupBy("k").agg(first).select("k", "w.op", "w.v", "w.level", F.negative("w.age").alias("number"))
    return out.where(is_live()) if drop_removed else out
