"""Packing of token sequences by lexical retrieval.

Documents are dealt over shards of bounded size by their contents: by the rarest token id that another document holds, too, which is
what weighs most in BM25, and where that id has more documents than a shard holds, by the second rarest as well. Documents that have
both in common, as copies have, are split at random only if they are too many for a shard by themselves. So a seed finds its nearest
neighbours in its own shard at any size of the corpus.

Each shard holds a BM25 inverted index over token ids, with document frequencies of the whole corpus (a table no longer than the
vocabulary). A window starts with a seed document; the index gives its unused neighbours by falling score, and they fill the window.
The last one is cut there, and its rest is the seed of the next window.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, held_by_worker, salted_left
from strata.llm.tokens import text_ids

K1, B = 1.2, 0.75
SHARD_TOKENS = 2_500_000
SHARD_BIT, SUB_BIT = 39, 19  # of a sequence's number: 2 ** 24 shards, 2 ** 20 random parts of one, 2 ** 19 sequences in each
ROWS_AT_ONCE = 1000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, number=None) -> DataFrame:
    """documents -> doc_id, row, n_tokens, ids: little-endian ids of the whole text (null: none) and the end id, two bytes each if the vocabulary allows.

    ``row`` tells rows apart, or is what ``number`` makes of an array of doc_ids.
    """

    def encode(batches):
        from itertools import count

        from pyspark import TaskContext

        part, following = TaskContext.get().partitionId() << 33, count()
        texts_to_ids = text_ids(tokenizer)
        end = np.array([end_id], texts_to_ids.dtype).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids = [a.tobytes() + end for a in texts_to_ids.batch(batch.column("text").to_pylist())]
                n = [len(b) // texts_to_ids.dtype.itemsize for b in ids]
                rows = number(batch.column("doc_id")) if number else pa.array([part + next(following) for _ in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "row", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, row long, n_tokens long, ids binary")


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """(documents that hold each id, documents, mean tokens) over all rows; as long as the vocabulary, whatever the number of documents."""

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw, n in zip(batch["ids"], batch["n_tokens"]):
                seen = np.unique(np.frombuffer(raw, f"<u{len(raw) // n}"))
                if len(seen) and seen[-1] >= len(total):
                    total = np.r_[total, np.zeros(int(seen[-1]) + 1 - len(total), np.int64)]
                total[seen] += 1
        found = np.flatnonzero(total)
        yield pd.DataFrame({"id": found, "n": total[found]})

    rows = tokens.select("ids", "n_tokens").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n, mean = tokens.agg(F.count("*"), F.coalesce(F.avg("n_tokens"), F.lit(1.0))).first()
    df = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        df[r.id] = r.n
    return df, n, mean


def rarest(ids: np.ndarray, starts: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two ids of greatest rarity (the last place of which says: none) in each document of a flat array."""
    none, out = len(rarity) - 1, []
    of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(ids)))
    held = rarity[ids]
    for _ in range(2):
        most = np.maximum.reduceat(held, starts)
        found = np.full(len(starts), none)
        at = np.flatnonzero((held == most[of]) & (held > 0))[::-1]
        found[of[at]] = ids[at]  # the first place of it
        out.append(found)
        held = np.where(ids == found[of], 0, held)
    return out[0], out[1]


def routed(tokens: DataFrame, rarity) -> DataFrame:
    """tokens with ``first`` and ``second``, their rarest ids; ``rarity`` is a broadcast array."""

    def run(batches):
        held_by_worker(None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                n = batch.column("n_tokens").to_numpy()
                ids = np.concatenate([np.frombuffer(raw.as_buffer(), f"<u{len(raw.as_buffer()) // k}") for raw, k in zip(batch.column("ids"), n.tolist())])
                first, second = rarest(ids, np.cumsum(n) - n, rarity.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(second)], [*batch.schema.names, "first", "second"])

    return tokens.mapInArrow(run, "doc_id long, row long, n_tokens long, ids binary, first long, second long")


def into_shards(tokens: DataFrame, df: np.ndarray, shard_tokens: int) -> DataFrame:
    """Stored tokens with ``shard`` and ``sub``: a group of both has ``shard_tokens`` at most, but for a single document and what chance adds."""
    context = tokens.sparkSession.sparkContext
    rarity = context.broadcast(np.r_[np.where(df > 1, 1 / np.maximum(df, 1), 0), 0])
    rows = routed(tokens, rarity)
    routes = cut(rows.select("n_tokens", "first", "second"))
    # one row per id of the vocabulary at most
    size = np.zeros(len(df) + 1, np.int64)
    for r in routes.groupBy("first").agg(F.sum("n_tokens").alias("n")).collect():
        size[r["first"]] = r.n
    half = max(1, shard_tokens // 2)
    hot = size > half
    # ids with few documents share shards, and the others have some of their own
    shared = np.cumsum(np.where(hot, 0, size)) // half
    many = np.where(hot, -(-size // half), 1)
    base = np.where(hot, int(shared[-1]) + 1 + np.cumsum(np.where(hot, many, 0)) - many, shared)
    places = context.broadcast((base, many))

    @F.arrow_udf("long")
    def shard(first: pa.Array, second: pa.Array) -> pa.Array:
        base, many = places.value
        a, b = first.to_numpy(), second.to_numpy().astype(np.uint64)
        return pa.array(base[a] + ((b * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % many[a].astype(np.uint64)).astype(np.int64))

    heavy = routes.groupBy(shard("first", "second").alias("shard")).agg(F.ceil(F.sum("n_tokens") / shard_tokens).alias("subs")).where("subs > 1")
    rows = salted_left(rows.withColumn("shard", shard("first", "second")).drop("first", "second"), cut(heavy), "shard", "row")
    return rows.withColumn("sub", F.pmod(F.xxhash64("row"), F.coalesce("subs", F.lit(1)))).drop("subs")


class Index:
    """BM25 over documents given as arrays of ids."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n, self.idf = len(docs), idf
        found = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in found]
        term = np.concatenate(self.terms)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        tf = np.concatenate([c for _, c in found])
        length = np.array([len(d) for d in docs])[doc]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def keep(self, docs: np.ndarray) -> None:
        """Only documents that ``docs`` (by document, true or false) holds have scores from now on; others may still ask."""
        kept = docs[self.doc]
        self.at = np.r_[0, np.cumsum(kept)][self.at]
        self.doc, self.weight = self.doc[kept], self.weight[kept]

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents, over every distinct id of the seed."""
        ranges = list(zip(self.at[self.terms[seed]].tolist(), self.at[self.terms[seed] + 1].tolist()))
        return np.bincount(np.concatenate([self.doc[a:b] for a, b in ranges]), np.concatenate([self.weight[a:b] for a, b in ranges]), self.n)


def fill(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int):
    """(document, start, length, sequence, offset) of all pieces, sequence by sequence."""
    index = Index(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    seed, start, sequence, offset, following = -1, 0, 0, 0, 0
    held = len(docs)  # documents whose postings the index holds
    while True:
        if seed < 0:  # nothing was cut: the next document opens a window
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return
            seed, start = following, 0
            unused[seed] = False
        n = min(window - offset, len(docs[seed]) - start)
        yield seed, start, n, sequence, offset
        start, offset = start + n, offset + n
        if offset < window:
            left = int(unused.sum())
            if 4 * left <= 3 * held:  # used documents are no neighbours
                index.keep(unused)
                held = left
            scores = np.where(unused, index.scores(seed), -1.0)
            near = iter(np.argsort(-scores, kind="stable")[:left].tolist())
            seed = -1
            for doc in near:
                unused[doc] = False
                n = min(window - offset, len(docs[doc]))
                yield doc, 0, n, sequence, offset
                offset += n
                if n < len(docs[doc]):
                    seed, start = doc, n
                if offset == window:
                    break
        elif start == len(docs[seed]):
            seed = -1
        sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """documents -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in one piece. Sequences are full but for the last one of each shard, which is padded. Null and empty
    texts are the end id alone, and texts of any length are packed whole. Rows that repeat an id are documents of their own, a null id
    stays null, an empty table gives no rows, and further columns are ignored. Ties in score go to the earlier row of the shard.
    """
    tokens = cut(tokenise(docs, tokenizer, end_id))
    df, n, mean = document_frequencies(tokens)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # as long as the vocabulary

    def shard_pieces(key, pdf):
        held_by_worker(None, None)
        pdf = pdf.sort_values("row", ignore_index=True)
        docs = [np.frombuffer(raw, f"<u{len(raw) // k}") for raw, k in zip(pdf["ids"], pdf["n_tokens"])]
        base = int(key[0]) << SHARD_BIT | int(key[1]) << SUB_BIT
        rows = [(d, a, k, zlib.crc32(docs[d][a : a + k].astype("<u4").tobytes()), len(docs[d]), base + s, o) for d, a, k, s, o in fill(docs, shared.value, mean, window)]
        out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").take(out.pop("doc")).array)
        return out

    return into_shards(tokens, df, shard_tokens).groupBy("shard", "sub").applyInPandas(shard_pieces, PIECES)
