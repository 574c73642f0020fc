"""Near duplicates by MinHash with tensored banding, confirmed on whole sets of shingles.

Two small collections of short bands (a few minhashes each) are computed for each document, and every pair of a band of the first
and one of the second is a table key: TABLES ** 2 tables from TABLES * 2 bands. Texts with equal sets are one class beforehand.

Candidates are not all pairs of a bucket: within each batch, and then over all batches, members meet the bucket's first member only.
Pairs are confirmed on the words of whole texts, and confirmed ones joined to components. A member that isn't in its bucket's component
after that may still be like another member: an exact prefix filter (rarest shingles first) over the components concerned finds every
such pair.

Sketches, sizes of sets and the prefix filter take 64-bit hashes of shingles. Words of up to seven bytes have hashes of their own each,
longer ones xxh3 hashes, so that equal hashes of different shingles are a matter of chance (n * n / 2**65 in a text of n); what is
confirmed doesn't depend on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut, drop, held_by_worker, salted_left, split_join
from strata.llm.tokens import eight_bytes

BAND, TABLES = 3, 14  # minhashes in a band (two bands make a key), bands in each collection
THRESHOLD = 80  # per cent
WORDS = 5  # in a shingle
CHUNK = 2_000_000  # bytes of text at a time
SIGNS = 8  # words of 64 bits that refute most pairs that aren't alike
PAIRS_AT_ONCE = 250

_random = np.random.default_rng(11)
MULTIPLY = _random.integers(1, 1 << 63, 2 * TABLES * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
XOR = _random.integers(0, 1 << 63, 2 * TABLES * BAND, dtype=np.uint64)
PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BITS = [f"bits_{i}" for i in range(SIGNS)]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 texts in a row, A-Z lower-cased, with some bytes more; starts and lengths of their words; and where each text's words begin, with the end."""
    raw = [(t or b"").lower() for t in texts]  # bytes: A-Z only
    joined = b"\n".join(raw) + b"\n" * 8
    space = IS_SPACE[np.frombuffer(joined, np.uint8)]
    start = ~space
    start[1:] &= space[:-1]
    cut_at = np.flatnonzero(start | space)
    of_word = start[cut_at]
    starts, lengths = cut_at[of_word], np.diff(cut_at, append=len(joined))[of_word]
    return joined, starts, lengths, np.r_[0, np.searchsorted(starts, np.cumsum([len(b) + 1 for b in raw]))]


def packed(joined: bytes, starts: np.ndarray, lengths: np.ndarray, of_long) -> np.ndarray:
    """A number for each word: bytes and length of up to seven bytes, and of longer ones what ``of_long`` makes of their bytes."""
    out = eight_bytes(joined, starts, np.minimum(lengths, 7)) | np.minimum(lengths, 8).astype(np.uint64) << np.uint64(56)
    at = np.flatnonzero(lengths > 7)
    out[at] = of_long([joined[a : a + n] for a, n in zip(starts[at].tolist(), lengths[at].tolist())])
    return out


def places(first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose words begin at ``first``: the first word of each shingle, the words in it, and where each text's shingles begin, with the end."""
    count = np.diff(first)
    n = np.where(count >= words, count - words + 1, count > 0)
    edges = np.r_[0, np.cumsum(n)]
    return np.arange(edges[-1]) + np.repeat(first[:-1] - edges[:-1], n), np.repeat(np.minimum(count, words), n), edges


def shingles(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of UTF-8 texts in a row (repeats included), and where each text's begin, with the end."""
    joined, starts, lengths, first = words_of(texts)
    h = mixed(packed(joined, starts, lengths, lambda long: [xxhash.xxh3_64_intdigest(w) for w in long]))
    at, size, edges = places(first, words)
    padded = np.r_[h, np.zeros(words, np.uint64)]
    total = size.astype(np.uint64)
    for i in range(words):  # one after the other, so that order counts
        total = mixed(total * PLACE[i] + np.where(size > i, padded[at + i], np.uint64(0)))
    return total, edges


def exact_shingles(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), with numbers that are equal for equal words only; they hold for these texts together."""
    joined, starts, lengths, first = words_of(texts)
    known: dict[bytes, int] = {}
    number = np.unique(packed(joined, starts, lengths, lambda long: [(8 << 56) + known.setdefault(w, len(known)) for w in long]), return_inverse=True)[1].astype(np.int64) + 1
    at, size, edges = places(first, words)
    padded = np.r_[number, np.zeros(words, np.int64)]
    every, total = len(number) + 1, np.zeros(len(at), np.int64)
    for i in range(words):
        total = np.unique(total * every + np.where(size > i, padded[at + i], 0), return_inverse=True)[1]
    return total, edges


def batches_of(column: pa.Array):
    """(from, to, UTF-8 texts) of stretches of about CHUNK bytes."""
    texts = column.cast(pa.binary()).to_pylist()
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < CHUNK:
            size += len(texts[end] or b"")
            end += 1
        yield at, end, texts[at:end]
        at = end


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """documents -> doc_id, row, text, n_shingles, same (a digest of the set; null: empty set), bands (of both collections, by turns)."""

    def run(batches):
        from itertools import count

        from pyspark import TaskContext

        held_by_worker(None, None)
        part, number = TaskContext.get().partitionId() << 33, count()
        for batch in batches:
            sizes, same, bands = [], [], []
            for a, b, texts in batches_of(batch.column("text")):
                every, edges = shingles(texts, words)
                full = np.flatnonzero(np.diff(edges))
                mins = np.full((2 * TABLES * BAND, len(texts)), np.uint64(0))
                if len(full):
                    for i in range(2 * TABLES * BAND):
                        mins[i, full] = np.minimum.reduceat((every ^ XOR[i]) * MULTIPLY[i], edges[full])
                band = np.zeros((2 * TABLES, len(texts)), np.uint64)
                for i in range(BAND):
                    band = mixed(band + mins[i::BAND] * PLACE[i])
                bands.append(band.T.view(np.int64))
                for i in range(len(texts)):
                    own = np.unique(every[edges[i] : edges[i + 1]])
                    sizes.append(len(own))
                    same.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
            rows = [part + next(number) for _ in sizes]
            flat = np.concatenate(bands) if bands else np.zeros((0, 2 * TABLES), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * 2 * TABLES, pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.int64()), batch.column("text"), pa.array(sizes, pa.int64()), pa.array(same, pa.string()), lists], ["doc_id", "row", "text", "n_shingles", "same", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, row long, text string, n_shingles long, same string, bands array<long>")


def bucket_leads(classes: DataFrame, diagonal: bool = False) -> DataFrame:
    """(row, bands, comp and weight: its component and rows in that, null for a row of none) -> (key, u, v, size): for each bucket of a batch its first member u, with its comp as v, and less the bucket's size there and 2 ** 32 times u's weight; and the batch's pairs of a member u and a first member v.

    Rows of larger components come first. A pair of a bucket of two comes under the bucket's key, with size 0; pairs of larger ones, once
    for the batch, under keys of no meaning, with size 2. Sizes are one more for a pair of two components. ``diagonal``: of TABLES tables
    only, one for each band.
    """

    def run(batches):
        held_by_worker(None, None)
        grid_a, grid_b = (np.arange(TABLES),) * 2 if diagonal else (x.ravel() for x in np.meshgrid(np.arange(TABLES), np.arange(TABLES), indexing="ij"))
        table = (grid_a * TABLES + grid_b + 1).astype(np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                weight = np.minimum(batch.column("weight").fill_null(1).to_numpy(), (1 << 31) - 1)
                order = np.lexsort((batch.column("row").to_numpy(), -weight))
                row, weight, comp = batch.column("row").to_numpy()[order], weight[order], batch.column("comp").take(pa.array(order))
                own = comp.fill_null(-1).to_numpy()
                own = np.where(own < 0, row, own)
                bands = batch.column("bands").flatten().to_numpy().view(np.uint64).reshape(len(row), 2 * TABLES)[order]
                keys = mixed(mixed(bands[:, :TABLES][:, grid_a] + table) + bands[:, TABLES:][:, grid_b]).ravel()
                who = np.repeat(np.arange(len(row)), len(table))
                order = np.argsort(keys, kind="stable")  # stable: first rows come first in their buckets
                keys, who = keys[order], who[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                size = np.diff(first, append=len(keys))
                lead, n = np.repeat(who[first], size), np.repeat(size, size)
                later = np.ones(len(keys), bool)
                later[first] = False
                two = later & (n == 2)
                many = np.unique(who[later & (n > 2)] * len(row) + lead[later & (n > 2)])
                member, head = np.r_[who[two], many // len(row)], np.r_[lead[two], many % len(row)]
                u = np.r_[row[member], row[who[first]]]
                v = pa.concat_arrays([pa.array(row[head]), comp.take(pa.array(who[first]))])
                key = np.r_[keys[two], mixed(many.astype(np.uint64) + row[0].astype(np.uint64)), keys[first]].view(np.int64)
                sizes = np.r_[np.repeat([0, 2], [two.sum(), len(many)]) + (own[member] != own[head]), -size - (weight[who[first]] << 32)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(u), v, pa.array(sizes)], ["key", "u", "v", "size"])

    return classes.select("row", "bands", "comp", "weight").mapInArrow(run, "key long, u long, v long, size long")


def candidates(classes: DataFrame, diagonal: bool = False) -> DataFrame:
    """Distinct pairs (u, v, more, apart): v the first member of a bucket that u is in, whether any of these buckets has more members than two, and whether u and v are of two components.

    The first member is one of the largest component in the bucket, so that it's the few that meet one of the many. Of one component, there are only the pairs of a batch that have more. In the shuffle, a bucket has two rows per batch at most.
    """
    key, alone = Window.partitionBy("key"), F.col("size") < 0
    comp, weight, size = F.coalesce("v", "u"), F.expr("-size >> 32"), F.expr("-size & 4294967295")
    lead, total = F.min(F.when(alone, F.struct((-weight).alias("w"), "u", comp.alias("comp")))).over(key), F.sum(F.when(alone, size)).over(key)
    met = bucket_leads(classes, diagonal).select("u", "v", "size", lead.alias("lead"), (total > 2).alias("large"))
    more = F.when(F.col("size") < 2, F.col("large")).otherwise(True)
    apart = F.when(alone, comp != F.col("lead.comp")).otherwise(F.col("size") % 2 == 1)
    pairs = met.select("u", F.when(alone, F.col("lead.u")).otherwise(F.col("v")).alias("v"), more.alias("more"), apart.alias("apart"), alone.alias("alone"))
    pairs = pairs.where("u <> v and (apart or more and not alone)")
    return cut(pairs.groupBy("u", "v").agg(F.max("more").alias("more"), F.max("apart").alias("apart")))


def sets_of(texts: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The whole sets of hashes (row, n, sh: sorted) of some rows of texts (row, text)."""

    def run(batches):
        for batch in batches:
            own = []
            for _, _, some in batches_of(batch.column("text")):
                every, edges = shingles(some, words)
                own += [np.unique(every[a:b]).view(np.int64) for a, b in zip(edges[:-1], edges[1:])]
            ends = np.cumsum([0, *map(len, own)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists], ["row", "sh"])

    return texts.join(rows, "row", "left_semi").select("row", "text").mapInArrow(run, "row long, sh array<long>")


def signs_of(texts: DataFrame, words: int) -> DataFrame:
    """Of each text (row, text): row, n (size of its set), and for 64 * SIGNS places whether an odd number of the set's hashes falls there (bits_0, ...)."""

    def run(batches):
        for batch in batches:
            sizes, odd = [], np.zeros((batch.num_rows, 64 * SIGNS), np.uint8)
            for _, _, some in batches_of(batch.column("text")):
                every, edges = shingles(some, words)
                for a, b in zip(edges[:-1], edges[1:]):
                    own = np.unique(every[a:b])
                    odd[len(sizes)] = np.bincount((own % np.uint64(64 * SIGNS)).astype(np.int64), minlength=64 * SIGNS) & 1
                    sizes.append(len(own))
            bits = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), *(pa.array(bits[:, i].copy()) for i in range(SIGNS))], ["row", "n", *BITS])

    return texts.select("row", "text").mapInArrow(run, "row long, n long, " + ", ".join(f"{b} long" for b in BITS))


def fits(threshold: int):
    """Sizes that allow the similarity."""
    return (100 * F.least("n_u", "n_v")) >= threshold * F.greatest("n_u", "n_v")


def near(threshold: int):
    """Sizes and bits that allow the similarity: sets differ in as many shingles at least as their bits differ in places."""
    differ = sum((F.bit_count(F.col(f"{b}_u").bitwiseXOR(F.col(f"{b}_v"))) for b in BITS), F.lit(0))
    both = F.col("n_u") + F.col("n_v")
    return fits(threshold) & ((100 + threshold) * (both - differ) >= 2 * threshold * both)


def likely(pairs: DataFrame, signs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) that sizes and bits allow."""
    of = lambda c: signs.select(F.col("row").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", *BITS)])
    return cut(split_join(pairs.select("u", "v").join(of("u"), "u"), of("v"), "v", "u").where(near(threshold)).select("u", "v"))


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int, words: int) -> DataFrame:
    """The pairs (u, v) whose texts (row, text) are alike on their whole sets, word by word. Texts that are in many pairs are repeated, so that no task has all of them."""
    at = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}"))
    both = split_join(split_join(pairs.select("u", "v"), at("v"), "v", "u"), at("u"), "u", "v")

    def alike(batches):
        held_by_worker(None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
                batch = whole.slice(at, PAIRS_AT_ONCE)
                u, v = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_u", "text_v"))
                texts = list(dict.fromkeys(u + v))
                every, edges = exact_shingles(texts, words)
                sets = dict(zip(texts, (np.unique(every[a:b]) for a, b in zip(edges[:-1], edges[1:]))))
                keep = []
                for a, b in zip(u, v):
                    common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    keep.append(100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("u", "v", "text_u", "text_v").mapInArrow(alike, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (row, comp): the smallest row that each row of an edge reaches. Rows move to their smallest neighbour, and edges between those go on, until none is left."""
    moves = []
    while True:
        edges = cut(edges.where("u <> v").selectExpr("least(u, v) as u", "greatest(u, v) as v").distinct())
        if edges.isEmpty():
            break
        ends = edges.selectExpr("u as row", "u as other").unionByName(edges.selectExpr("v as row", "u as other")).unionByName(edges.selectExpr("u as row", "v as other"))
        move = cut(ends.groupBy("row").agg(F.least(F.min("row"), F.min("other")).alias("to")))
        moves.append(move)
        edges = edges.join(move.selectExpr("row as u", "to as tu"), "u").join(move.selectExpr("row as v", "to as tv"), "v").selectExpr("tu as u", "tv as v")
    if not moves:
        return edges.selectExpr("u as row", "v as comp")
    out = moves[0].withColumnRenamed("to", "comp")
    for move in moves[1:]:
        step = move.selectExpr("row as comp", "to")
        out = out.join(step, "comp", "left").select("row", F.coalesce("to", "comp").alias("comp"))
    return cut(out)


def left_over(found: DataFrame, comps: DataFrame, texts: DataFrame, signs: DataFrame, threshold: int, words: int) -> DataFrame:
    """Pairs (u, v) over the components that share a bucket without a link: every pair of these that is alike.

    Shingles are ordered by how few of the rows hold them. Of two alike sets, the smaller has one of its first n - ceil(2 t n / (1 + t)) + 1
    shingles among the first n - ceil(t n) + 1 of the larger, and at the first that they share, both have enough shingles left. Most
    pairs of a row and the members of a large component that it isn't like are refuted by their bits, within the join.
    """
    of = lambda c: comps.select(F.col("row").alias(c), F.col("comp").alias(f"comp_{c}"))
    # a bucket of two holds no other pair
    apart = found.where("more and apart").join(of("u"), "u", "left").join(of("v"), "v", "left").select("u", "v", F.coalesce("comp_u", "u").alias("cu"), F.coalesce("comp_v", "v").alias("cv")).where("cu <> cv")
    apart = cut(apart)
    if apart.isEmpty():
        return apart.select("u", "v")
    # a row meets its batch's first member, and that one the whole bucket's: rows whose batch's first member is apart from the bucket's are open, too
    leads = apart.select(F.col("u").alias("row")).distinct()
    behind = found.where("more").join(leads.withColumnRenamed("row", "v"), "v", "left_semi").select(F.col("u").alias("row"))
    open_rows = cut(leads.unionByName(behind).distinct())
    touched = apart.select(F.col("cu").alias("comp")).unionByName(apart.select(F.col("cv").alias("comp"))).distinct()
    alone = apart.select(F.col("u").alias("row")).unionByName(apart.select(F.col("v").alias("row"))).distinct().withColumn("comp", F.col("row")).join(comps, "row", "left_anti")
    members = cut(comps.join(touched, "comp", "left_semi").select("row", "comp").unionByName(alone.select("row", "comp")))
    sets = cut(sets_of(texts, members, words).join(signs, "row"))
    each = sets.select("row", "n", *BITS, F.explode("sh").alias("sh"))
    counts = sets.select(F.explode("sh").alias("sh")).groupBy("sh").agg(F.count("*").alias("df")).where("df > 1")  # a shingle of one row finds nobody, and comes first
    known = each.join(counts, "sh", "left").withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("df", F.lit(1)), "sh")) - 1)
    t = threshold / 100
    probe = F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1
    index = F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - 1e-9) + 1
    prefix = known.where((F.col("place") < probe) & F.col("df").isNotNull()).withColumns({"left": F.col("n") - F.col("place"), "short": F.col("place") < index})
    prefix = cut(prefix.join(members, "row").join(open_rows.withColumn("open", F.lit(True)), "row", "left").select("sh", "row", "n", "left", "comp", F.coalesce("open", F.lit(False)).alias("open"), "short", *BITS))
    named = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("row", "n", "left", "comp", "open", *BITS)]
    larger = (F.col("n_u") > F.col("n_v")) | ((F.col("n_u") == F.col("n_v")) & (F.col("row_u") > F.col("row_v")))
    enough = (100 + threshold) * F.least("left_u", "left_v") >= threshold * (F.col("n_u") + F.col("n_v"))
    # one of a pair is open: open rows look in all short prefixes, and the others in those of open rows
    asked, held = prefix.select("sh", *named("u")), prefix.where("short").select("sh", *named("v"))
    met = split_join(asked.where("open_u"), held, "sh", "row_u", 1000).unionByName(split_join(asked.where("not open_u"), held.where("open_v"), "sh", "row_u", 1000))
    pairs = met.where(larger & enough & (F.col("comp_u") != F.col("comp_v")) & near(threshold))
    pairs = cut(pairs.select(F.col("row_u").alias("u"), F.col("row_v").alias("v")).distinct())
    alike = confirmed(pairs, texts, threshold, words)
    drop(sets, prefix, pairs)
    return alike


def link(sketches: DataFrame, threshold: int, words: int, *carried: str) -> DataFrame:
    """Stored sketches -> one row per row: row, doc_id, n_shingles, ``carried`` columns, component_id. Deletes the sketches."""
    groups = sketches.where("same is not null").groupBy("same").agg(F.min("row").alias("first"), F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    groups = cut(groups.where("copies > 1").select("same", "first", "first_doc"))
    rows = salted_left(sketches.select("row", "doc_id", "n_shingles", "same", *carried), groups, "same", "row")
    rows = cut(rows.select("row", "doc_id", "n_shingles", "same", *carried, F.coalesce("first", "row").alias("class"), F.coalesce("first_doc", "doc_id").alias("class_doc")))
    later = cut(rows.where("row <> class").select("row"))
    classes = sketches.where("same is not null").select("row", F.col("n_shingles").alias("n"), "bands").join(later, "row", "left_anti")
    rows_of = lambda pairs: pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct()
    text = sketches.select("row", "text")
    # a few tables link most of what is alike; then all tables, for what is apart still
    pairs = candidates(classes.withColumns({"comp": F.lit(None).cast("long"), "weight": F.lit(None).cast("long")}), diagonal=True)
    rows_met = cut(rows_of(pairs))
    first_texts = cut(text.join(rows_met, "row", "left_semi"))
    first_signs = cut(signs_of(first_texts, words))
    edges = confirmed(likely(pairs, first_signs, threshold), first_texts, threshold, words)
    comps = components(edges)
    weights = comps.groupBy("comp").agg(F.count("*").alias("weight"))
    found = candidates(salted_left(classes, cut(comps.join(weights, "comp")), "row", "row"))
    apart = found.where("apart")
    other_texts = cut(text.join(rows_of(apart).join(rows_met, "row", "left_anti"), "row", "left_semi"))
    texts, signs = first_texts.unionByName(other_texts), first_signs.unionByName(cut(signs_of(other_texts, words)))
    asked = likely(apart.join(pairs, ["u", "v"], "left_anti"), signs, threshold)
    if not asked.isEmpty():
        edges = edges.unionByName(confirmed(asked, texts, threshold, words))
        comps = components(edges)
    more = left_over(found, comps, texts, signs, threshold, words)
    if not more.isEmpty():
        comps = components(edges.unionByName(more))
    # the smallest doc_id of a component, over its classes
    named = rows.where("row = class").select(F.col("row"), "class_doc").join(comps, "row")
    smallest = named.groupBy("comp").agg(F.min("class_doc").alias("component_doc"))
    labels = cut(comps.join(smallest, "comp").select(F.col("row").alias("class"), "component_doc"))
    drop(sketches, first_texts, other_texts, found)  # rows and labels are stored, too
    return salted_left(rows, labels, "class", "row").select("row", "doc_id", "n_shingles", *carried, F.coalesce("component_doc", "class_doc", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """documents -> one row per row: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat an id are texts of their own under one
    name. Rows with a null id take part in links; they are kept, and their component is null unless it holds an id. Texts of any length
    are read whole. An empty table gives no rows, and further columns are ignored.
    """
    out = link(cut(sketch(docs, words)), threshold, words)
    return out.select("doc_id", "n_shingles", "component_id", is_kept().alias("kept"))


def is_kept():
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of documents, with all their columns, that near_duplicates keeps.

    A row is known by its doc_id and text: of rows that repeat an id, those with other texts are judged each for itself, and those
    with the same text stay or go together. Rows with a null id, and those without a word, stay. Columns may have any names.
    """
    gone = cut(link(cut(sketch(docs, words).withColumn("h", F.xxhash64("text"))), threshold, words, "h").where(~is_kept()).select("doc_id", "h").distinct())
    return docs.select(F.struct("*").alias("kept"), "doc_id", F.xxhash64("text").alias("h")).join(gone, ["doc_id", "h"], "left_anti").select("kept.*")
