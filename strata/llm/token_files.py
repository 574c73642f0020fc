"""Files of token ids in Simple-8b.

A 64-bit word holds a 4-bit selector and 60 bits of payload: 60 ids of 1 bit, 30 of 2 bits, and so on to one of 60 bits. Ids from
2**60 on are escapes: selector 15, with their place in a table of raw ids. Ids are coded in blocks of 1,024 that start with a word of
their own, whose offsets the file holds. Choosing selectors, packing and unpacking are done for all blocks of a file at once.

File, little-endian: magic, part, documents, ids, blocks, words, escapes (8 bytes each); document ids (and 1 where null), their
numbers of ids, word offsets of the blocks and their end, words, escapes; then TRAILER.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, read_blobs, write_blobs
from strata.llm.packing import tokenise

MAGIC, TRAILER, BLOCK = b"S8BIDS01", "S8BIDEND", 1024
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
AT_ONCE = 256  # blocks
FILE_IDS = 3_000_000  # in a file, about
PART_BYTES, MANY_PARTS, LARGE_PART_BYTES = 8_000_000, 4096, 256_000_000  # of text in a range of documents, about; beyond so many, ranges grow to the last


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unsigned ids -> words, word offsets of the blocks (and the end), escapes; some hundred blocks at a time."""
    words, offsets, escapes, n_words, n_escapes = [], [np.zeros(1, np.uint64)], [], 0, 0
    for at in range(0, len(ids), AT_ONCE * BLOCK):
        w, o, e = _encode(ids[at : at + AT_ONCE * BLOCK].astype(np.uint64), n_escapes)
        words.append(w)
        offsets.append(o[1:] + np.uint64(n_words))
        escapes.append(e)
        n_words, n_escapes = n_words + len(w), n_escapes + len(e)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *words]), np.concatenate(offsets), np.concatenate([none, *escapes])


def _encode(ids: np.ndarray, n_escapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blocks = -(-len(ids) // BLOCK)
    bits = np.full((blocks, BLOCK + 64), 255, np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[: len(ids)] = np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(np.uint8)
    big = ids >= 1 << 48  # where floats round
    flat[: len(ids)][big] = [int(x).bit_length() for x in ids[big]]
    flat[len(ids) :] = 255
    bits[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    top, power = {1: bits}, 1
    while power < 32:
        top[2 * power] = np.maximum(top[power][:, : top[power].shape[1] - power], top[power][:, power:])
        power *= 2
    chosen = np.full((blocks, BLOCK), 15, np.uint8)
    for s in range(14, 0, -1):
        n = int(COUNTS[s])
        p = 1 << (n.bit_length() - 1)
        most = np.maximum(top[p][:, :BLOCK], top[p][:, n - p : n - p + BLOCK])
        chosen[most <= WIDTHS[s]] = s
    steps = COUNTS[chosen]
    first = np.zeros((blocks, BLOCK + 64), bool)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    ends = np.full(blocks, BLOCK)
    ends[-1] = len(ids) - (blocks - 1) * BLOCK
    while len(row):
        first[row, at] = True
        at = at + steps[row, at]
        more = at < ends[row]
        row, at = row[more], at[more]
    first = first[:, :BLOCK]
    offsets = np.r_[0, np.cumsum(first.sum(1))].astype(np.uint64)
    starts = np.flatnonzero(first.ravel())
    selector = chosen.ravel()[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        of = np.flatnonzero(selector == s)
        if len(of):
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            words[of] |= np.bitwise_or.reduce(ids[starts[of][:, None] + np.arange(COUNTS[s])] << shift, axis=1)
    escaped = np.flatnonzero(selector == 15)
    words[escaped] |= np.arange(n_escapes, n_escapes + len(escaped), dtype=np.uint64)
    return words, offsets, ids[starts[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of a run of words that starts with a block; ``escapes`` is the file's table."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(1, 15):
        of = np.flatnonzero(selector == s)
        if len(of):
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            out[at[of][:, None] + np.arange(COUNTS[s])] = (words[of][:, None] >> shift) & np.uint64((1 << int(WIDTHS[s])) - 1)
    of = np.flatnonzero(selector == 15)
    out[at[of]] = escapes[(words[of] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def to_file(part: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    words, offsets, escapes = encode(every)
    head = np.array([part, len(ids), len(every), len(offsets) - 1, len(words), len(escapes)], "<u8")
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "<u8")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, docs, null, np.array([len(i) for i in ids], "<u8"), offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8")))])


def from_file(data: bytes) -> tuple[int, list[int | None], list[np.ndarray]]:
    """part, document ids, ids of each document; ValueError if the file is damaged."""
    if data[:8] != MAGIC or data[-8:] != TRAILER.encode() or len(data) % 8:
        raise ValueError("not a whole file of token ids")
    body = np.frombuffer(data, "<u8")[1:-1]
    part, docs, n, blocks, words, escapes = (int(x) for x in body[:6])
    sizes = np.cumsum([6, docs, docs, docs, blocks + 1, words, escapes])
    if sizes[-1] != len(body):
        raise ValueError("lengths in the file do not agree")
    doc_ids, null, lengths, offsets, coded, table = (body[a:b] for a, b in zip(sizes, sizes[1:]))
    cuts = [*offsets[::AT_ONCE].tolist(), words]
    parts = [decode(coded[a:b], table) for a, b in zip(cuts, cuts[1:])]
    small = all(p.max(initial=0) < 1 << 32 for p in parts)
    ids = np.concatenate([np.zeros(0, np.uint32 if small else np.uint64), *(p.astype(np.uint32) if small else p for p in parts)])
    if len(ids) != n or int(lengths.sum()) != n or int(offsets[-1]) != words:
        raise ValueError("counts in the file do not agree")
    ends = np.cumsum(lengths.astype(np.int64))
    return part, [None if x else d for d, x in zip(doc_ids.view("<i8").tolist(), null.tolist())], [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]


def block(data: bytes, number: int) -> np.ndarray:
    """The ids of one block, without decoding the others."""
    body = np.frombuffer(data, "<u8")[1:]
    _, docs, _, blocks, words, escapes = (int(x) for x in body[:6])
    at = 6 + 3 * docs
    a, b = (int(x) for x in body[at + number : at + number + 2])
    first = at + blocks + 1
    return decode(body[first + a : first + b], body[first + words : first + words + escapes])


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS, parts: int | None = None) -> str:
    """Writes documents in ascending order of doc_id (nulls first; rows that repeat an id in any order); gives the folder.

    Ranges of ids are dealt to tasks, and sorted there; files are cut from the sorted stream.
    """
    if parts is None:
        n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        size += 16 * n
        parts = max(1, min(MANY_PARTS, -(-size // PART_BYTES)), -(-size // LARGE_PART_BYTES))
    shares = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("b")).first().b if shares else []
    bounds = np.array(sorted(set(found or [])), np.int64)

    def dealt(ids: pa.Array) -> pa.Array:
        part = np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "left").astype(np.int64)
        part[ids.is_null().to_numpy(zero_copy_only=False)] = -1
        return pa.array(part)

    def cut_files(batches):
        held: tuple[list, list] = ([], [])
        size = chunk = at = 0

        def done():
            nonlocal held, size, chunk
            out = pa.RecordBatch.from_arrays([pa.array([to_file((at + 1 << 32) + chunk, *held)], pa.binary())], ["data"])
            held, size, chunk = ([], []), 0, chunk + 1
            return out

        for batch in batches:
            for part, doc_id, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "ids"))):
                if held[0] and (part != at or size >= file_ids):
                    yield done()
                if part != at:
                    at, chunk = part, 0
                held[0].append(doc_id)
                held[1].append(np.frombuffer(raw, f"<u{len(raw) // n}"))
                size += n
        if held[0]:
            yield done()

    tokens = tokenise(docs, tokenizer, end_id, dealt).withColumnRenamed("row", "part")
    return write_blobs(tokens.repartition("part").sortWithinPartitions("part", "doc_id").mapInArrow(cut_files, "data binary"), "data", TRAILER)


def read_files(spark, path: str, digest: bool = False) -> DataFrame:
    """A folder of write_files -> doc_id, part, at (in the part), n_tokens, ids (little-endian unsigned 32-bit), or their CRC-32."""

    def rows(batches):
        for batch in batches:
            for data in batch.column("content"):
                part, doc_ids, ids = from_file(data.as_py())
                n = np.array([len(i) for i in ids], np.int64)
                raw = (i.astype("<u4").tobytes() for i in ids)
                last = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digest else pa.array(list(raw), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([part] * len(n), pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), last], ["doc_id", "part", "at", "n_tokens", "ids_crc32" if digest else "ids"])

    return read_blobs(spark, path).select("content").mapInArrow(rows, "doc_id long, part long, at long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def read_digests(spark, path: str) -> DataFrame:
    """A folder of write_files -> doc_id, start, n_tokens, ids_crc32; start counts the ids of all documents before."""
    rows = cut(read_files(spark, path, digest=True))
    # running sums over the files of a range, and over ranges: one row per range in one task
    files = cut(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("range", F.shiftright("part", 32)))
    ranges = files.groupBy("range").agg(F.sum("n").alias("n")).selectExpr("range", "sum(n) OVER (ORDER BY range) - n AS before")
    within = files.selectExpr("part", "range", "sum(n) OVER (PARTITION BY range ORDER BY part) - n AS inside")
    totals = within.join(ranges, "range").selectExpr("part", "before + inside AS before")
    return rows.join(totals, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS, parts: int | None = None) -> DataFrame:
    """documents -> files -> one row per row: doc_id, start, n_tokens, ids_crc32, all from the files.

    Null and empty texts are the end id alone; texts of any length are coded whole. Null ids come first, rows that repeat an id follow
    each other (in one task), an empty table gives no rows, and further columns are ignored.
    """
    return read_digests(docs.sparkSession, write_files(docs, tokenizer, end_id, file_ids, parts))
