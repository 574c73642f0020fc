"""Blocks of sorted runs: sparse index, lookups in it, statistics.

A block takes entries (8 bytes, key, value) until it has ``block_size`` bytes, and so overshoots. Cuts follow from each other, so a run
is cut by one sequential pass; runs are passed through at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_OVERHEAD = 8


def entry_bytes(k: str = "k", v: str = "v") -> Column:
    return F.octet_length(k) + F.octet_length(v) + ENTRY_OVERHEAD


def cut_blocks(sizes, block_size: int) -> Iterator[tuple[int, int]]:
    """(first, past the last) entry of each block."""
    first = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= block_size:
            yield first, i + 1
            first, held = i + 1, 0
    if held:
        yield first, len(sizes)


def block_index(runs: DataFrame, block_size: int = 4096) -> DataFrame:
    """Runs (run, k, v) -> run, block_no, first_key, last_key, offset, size, entries."""

    def index(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(b=[k.encode() for k in pdf["k"]]).sort_values("b", ignore_index=True)
        ends = pdf["n"].cumsum().tolist()
        rows = []
        for no, (a, b) in enumerate(cut_blocks(pdf["n"].tolist(), block_size)):
            start = ends[a - 1] if a else 0
            rows.append((key[0], no, pdf["k"][a], pdf["k"][b - 1], start, ends[b - 1] - start, b - a))
        return pd.DataFrame(rows, columns=["run", "block_no", "first_key", "last_key", "offset", "size", "entries"])

    rows = runs.select(F.col("run").cast("long").alias("run"), "k", entry_bytes().cast("long").alias("n"))
    return rows.groupBy("run").applyInPandas(index, "run long, block_no int, first_key string, last_key string, offset long, size long, entries int")


def block_for(index: DataFrame, key: str) -> DataFrame:
    """In each run, the first block whose last key isn't below ``key``: the only one that can hold it."""
    at = F.min(F.struct("last_key", "block_no", "offset", "size")).alias("b")
    return index.where(F.col("last_key") >= key).groupBy("run").agg(at).select("run", "b.block_no", "b.last_key", "b.offset", "b.size")


def run_stats(runs: DataFrame) -> DataFrame:
    """Entries, smallest and largest key, and bytes of each run."""
    return runs.groupBy("run").agg(F.count("*").alias("entries"), F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.sum(entry_bytes()).alias("bytes"))


def read_amplification(runs: DataFrame) -> DataFrame:
    """For each key, the runs that hold it, and how many of its entries are tombstones."""
    return runs.groupBy("k").agg(F.count("*").alias("runs"), F.count_if((F.col("op") != "PUT") | (F.col("v") == "")).alias("tombstones"))


def group_commits(log: DataFrame, max_records: int = 1024) -> DataFrame:
    """The log as batches of ``max_records``: batch, records, min_seq, max_seq."""
    batch = F.floor((F.col("seq") - 1) / max_records).alias("batch")
    return log.groupBy(batch).agg(F.count("*").alias("records"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def memtable_epochs(log: DataFrame, entries: int) -> DataFrame:
    """A log with ``epoch``: the memtable that each record falls into, if one is flushed as soon as it holds ``entries`` different keys.

    Each boundary depends on the one before, so the log goes through one task in order. Runs cut at fixed sequence numbers give the
    same view and need no such pass; this is for comparing with logs of other engines.
    """

    def walk(batches):
        held: set[str] = set()
        epoch = 0
        for batch in batches:
            epochs = []
            for op, k in zip(batch["op"], batch["k"]):
                epochs.append(epoch)
                if op == "CLEAR":
                    held.clear()
                    continue
                held.add(k)
                if len(held) >= entries:
                    held.clear()
                    epoch += 1
            yield batch.assign(epoch=epochs)

    return log.select("seq", "op", "k", "v").repartition(1).sortWithinPartitions("seq").mapInPandas(walk, "seq long, op string, k string, v string, epoch long")
