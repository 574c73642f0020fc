"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidate rows are kept in blocks as postings: for each dimension, the rows whose component is not zero and those components. A block
of queries goes through its own non-zero components, dimension by dimension, and adds weighted postings to a dense score array. Each
pair of blocks keeps its k best by partition selection; a merge ranks the survivors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut

QUERIES, ROWS = 4096, 8192  # in a block; rows are repeated once for each block of queries
AT_ONCE = 256  # queries that have score arrays at the same time


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (queries x rows), int64, dimension by dimension; in Python's integers, held to 64 bits, where these could overflow."""
    bound = int(np.abs(queries.astype(np.float64)).max(initial=0)) * int(np.abs(rows.astype(np.float64)).max(initial=0)) * max(1, queries.shape[1])
    if bound >= 1 << 62:
        exact = queries.astype(object) @ rows.astype(object).T
        return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for d in range(queries.shape[1]):
        asked, held = np.flatnonzero(queries[:, d]), np.flatnonzero(rows[:, d])
        if len(asked) and len(held):
            if len(held) == len(rows):
                for q in asked:
                    scores[q] += queries[q, d] * rows[:, d]
            else:
                weights = rows[held, d]
                for q in asked:
                    scores[q, held] += queries[q, d] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, queries: int = QUERIES, rows: int = ROWS) -> DataFrame:
    """embeddings -> query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k best other rows.

    Components become floor(scale * x), x as double, held to 64 bits. Vectors that are null or hold a null or non-finite component
    take no part, nor do rows with a null id; shorter vectors end in zeros. Rows that repeat an id are candidates of their own, a
    repeated query id asks once (with the first of its vectors), and no candidate has the query's id. Further columns are ignored,
    and an empty table gives no rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(9.2e18)), F.lit(-9.2e18))))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))
    usable = cut(usable)
    asked = usable.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_asked, n_rows, width = usable.agg(F.countDistinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))), F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    q_blocks, r_blocks = max(1, -(-n_asked // queries)), max(1, -(-n_rows // rows))
    # blocks of queries meet blocks of rows: each side is dealt to its row or column of the grid
    left = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))))
    right = usable.withColumn("rb", F.pmod(F.xxhash64("v", "vec_id"), F.lit(r_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(r):
            q, ids = q.sort_values("vec_id"), r["vec_id"].to_numpy()
            asked, postings = matrix(q["v"], width), np.asfortranarray(matrix(r["v"], width))
            for at in range(0, len(asked), AT_ONCE):
                scores = accumulate(asked[at : at + AT_ONCE], postings)
                for query, row in zip(q["vec_id"].tolist()[at : at + AT_ONCE], scores):
                    others = np.flatnonzero(ids != query)
                    places = others[best(row[others], ids[others], k)]
                    found += zip([query] * len(places), ids[places].tolist(), row[places].tolist())
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
