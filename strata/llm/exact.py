"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries of all partitions find the digests that may be frequent. Their exact counts and winners are then computed,
and these few rows, of proven number, are broadcast: rows of frequent texts are settled where they are read. All other digests have
few rows each and are grouped by an ordinary shuffle of digests (texts are never shuffled).
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import cut

COUNTERS = 1024


@F.arrow_udf(T.StringType())
def text_sha256(texts: pa.Array) -> pa.Array:
    """Lower-case hex SHA-256 of the UTF-8 text with A-Z lower-cased; null counts as empty."""
    return pa.array([hashlib.sha256((t or b"").lower()).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def shrink(counts: Counter, counters: int) -> Counter:
    """The Misra-Gries reduction: at most ``counters`` entries, each too low by as much as was taken off."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - off for k, n in counts.items() if n > off})


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates (digest): every digest with more than 2 N / (counters + 1) of the N rows, and at most counters + 1 digests in all.

    A summary is too low by N / (counters + 1) at most, over all partitions together, and all summaries add up to N at most.
    """

    def summary(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch["digest"].value_counts().to_dict())
            counts = shrink(counts, counters)
        yield pd.DataFrame({"digest": list(counts), "n": list(counts.values())}).astype({"digest": object, "n": "int64"})

    least = digests.count() / (counters + 1)
    found = digests.select("digest").mapInPandas(summary, "digest string, n long")
    return found.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("digest")


def groups_of_copies(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """rows (doc_id, digest, row) -> rows with keep_id, keep_row, group_size. ``row`` tells rows apart, and ``rows`` is a stored table."""
    winner = [F.max(F.struct("doc_id", F.negative("row").alias("r"))).alias("w"), F.count("*").alias("group_size")]
    heavy = frequent(rows, counters)
    # at most counters + 1 rows of 64 characters, whatever the input
    heavy = cut(rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(*winner).where("group_size > 1"))
    known = rows.join(F.broadcast(heavy), "digest", "left")
    shown = ["doc_id", "digest", "row", F.col("w.doc_id").alias("keep_id"), F.negative("w.r").alias("keep_row"), "group_size"]
    same = Window.partitionBy("digest")
    light = known.where("group_size is null").select("doc_id", "digest", "row").withColumns({"w": F.max(F.struct("doc_id", F.negative("row").alias("r"))).over(same), "group_size": F.count("*").over(same)})
    return known.where("group_size is not null").select(*shown).unionByName(light.select(*shown))


def find_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """documents -> one row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null text counts as empty, and empty texts are copies of each other. The row
    with the largest doc_id stays (null ids come last); of rows that repeat this id too, one stays. Texts of any length are read whole.
    An empty table gives no rows, and further columns are ignored.
    """
    rows = docs.select("doc_id", text_sha256("text").alias("digest")).withColumn("row", F.monotonically_increasing_id())
    out = groups_of_copies(cut(rows), counters)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of documents, with all their columns, whatever their names, that find_copies keeps; see there for nulls, ties and repeated rows."""
    rows = cut(docs.select(F.struct("*").alias("kept"), "doc_id", text_sha256("text").alias("digest")).withColumn("row", F.monotonically_increasing_id()))
    gone = cut(groups_of_copies(rows.select("doc_id", "digest", "row"), counters).where("row <> keep_row").select("row"))
    return rows.join(gone, "row", "left_anti").select("kept.*")
