"""Streams of records into a store, and the latest view of a stream.

Micro-batches are numbered, and the store's manifest keeps the number of the last one: a batch that is delivered again does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators import lww
from strata.plans.store import Store
from strata.schema import CLEAR


def ingest(records: DataFrame, store: Store, name: str, checkpoint: str, ordinal: str | None = None, **trigger) -> StreamingQuery:
    """Starts writing a stream of (k, v) or (op, k, v) to the store, a log batch per micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        store.put_all(batch, ordinal, (name, number))

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()


def latest_view(log: DataFrame) -> DataFrame:
    """The latest record of each key of a stream, for output mode complete or update; what counts is ``seq``, not arrival."""
    last = log.where(F.col("op") != CLEAR).groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("w"))
    return last.select("k", "w.seq", "w.op", "w.v", lww.is_live(F.col("w.op"), F.col("w.v")).alias("live"))


def windowed_commits(log: DataFrame, time: str, width: str = "10 milliseconds", delay: str = "1 minute") -> DataFrame:
    """Group commits of a stream by time: records and sequence numbers of each window, late records up to ``delay``."""
    rows = log.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", delay)
    return rows.groupBy(F.window("__time", width).alias("window")).agg(F.count("*").alias("records"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
