import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from strata.llm import packing, token_files
from strata.llm.queries import tokenizer
from strata.llm.tokens import Numbers, TextIds

SCHEMA = "doc_id long, text string, ids string, row int"  # with names that the operators use inside


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer())
    full.encode_special_tokens = True
    return lambda text: full.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_docs():
    rnd = random.Random(2)
    words = ["the", "Straße", "don't", "x's", "été", "ÀÉ", "漢字", "1234", "!!", "a-b", "<|endoftext|>", "İΣ", "\x1c", "½"]
    texts = [None, "", " ", "a", " ".join(rnd.choice(words) for _ in range(9000)), "same", "same", "z" * 5000] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    return [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)] + [(5, "same", "x", 1), (5, "other", "x", 1)]


def test_ids_are_those_of_the_library(library):
    rnd = random.Random(1)
    ours = TextIds(tokenizer())
    for alphabet in ("abAB's' 't'll'é è́  \x1c\x85\t\n0123½²ßİΣσ漢字　<|endoftext|>&%$#_-ñÑªº·​😀\x00", "abAB's't'll're'vE'mÀÉÐÿ \t\n\xa0 0123½²ß''&%$#_-ñÑªº·\xad×÷µ"):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
        assert [x.tolist() for x in ours.batch(texts)] == [library(t) for t in texts]
    assert ours.batch([None, ""])[0].tolist() == []


def test_pieces_are_known_by_their_bytes(library):
    """The two words have equal polynomial hashes modulo 2**64, whatever the multiplier."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    for texts in ([f"{one} {other}"], [one, other], [other, f"{one} x"]):
        ours = TextIds(tokenizer())
        assert [x.tolist() for x in ours.batch(texts)] == [library(t) for t in texts]
        assert ours.batch([other])[0].tolist() == library(other)


def test_numbers_of_pieces():
    rnd = random.Random(3)
    pieces = list({bytes(rnd.choices(b"abc\xff", k=rnd.randint(1, 12))) for _ in range(4000)})
    numbers = Numbers()
    for i, p in enumerate(pieces[:2000]):
        numbers.add(p, i)
    data = b" ".join(pieces) + bytes(8)
    lengths = np.array([len(p) for p in pieces])
    found, _ = numbers.find(data, np.cumsum(lengths + 1) - lengths - 1, lengths)
    assert found.tolist() == [*range(2000), *[-1] * (len(pieces) - 2000)]


def test_packing_holds_every_id_once(spark, library, odd_docs):
    docs = spark.createDataFrame(odd_docs, SCHEMA)
    out = packing.pack(docs, tokenizer(), window=256, shard_tokens=4000).toPandas()
    full = sorted((-1 if d is None else d, zlib.crc32(np.array(library(t) + [2], "<u4").tobytes()), len(library(t)) + 1) for d, t, *_ in odd_docs)
    assert out["length"].sum() == sum(n for *_, n in full)
    for _, pieces in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (pieces["offset"].to_numpy() == pieces["length"].cumsum().shift(fill_value=0).to_numpy()).all() and pieces["length"].sum() <= 256
    # shards are half full at least, but for the last and those of the most frequent ids
    assert (out.groupby("sequence_id")["length"].sum() < 256).sum() <= 2 * -(-out["length"].sum() // 4000)
    texts = {d: [] for d, *_ in odd_docs}
    for d, t, *_ in odd_docs:
        texts[d].append(np.array(library(t) + [2], "<u4"))
    for r in out.itertuples():
        choices = texts[None if pd.isna(r.doc_id) else int(r.doc_id)]
        assert any(len(c) == r.doc_tokens and zlib.crc32(c[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for c in choices)


def test_neighbours_share_words():
    docs = [np.array(x) for x in ([1, 2, 3, 4], [9, 9, 8, 7], [1, 2, 3, 5], [9, 8, 7, 6], [0] * 9)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=10)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    pieces = list(packing.fill(docs, idf, 5.0, 8))
    assert [p[0] for p in pieces][:4] == [0, 2, 1, 3]
    index = packing.Index(docs, idf, 5.0)
    for seed in range(len(docs)):  # brute-force BM25
        for d, words in enumerate(docs):
            want = sum(idf[t] * (words == t).sum() * 2.2 / ((words == t).sum() + 1.2 * (0.25 + 0.75 * len(words) / 5)) for t in np.unique(docs[seed]) if t in words)
            assert abs(index.scores(seed)[d] - want) < 1e-9


def brute_fill(docs, window):
    """Packs from the definition: BM25 of every unused document, the best first, ties to the earlier one."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    tf = [Counter(d.tolist()) for d in docs]
    df = Counter(t for c in tf for t in c)
    idf = {t: math.log(1 + (n - k + 0.5) / (k + 0.5)) for t, k in df.items()}

    def score(seed, d):
        return sum(idf[t] * tf[d][t] * 2.2 / (tf[d][t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in sorted(tf[seed]) if t in tf[d])

    pieces, unused, carried, sequence = [], list(range(n)), None, 0
    while carried or unused:
        seed, start = carried or (unused.pop(0), 0)
        taken = min(window, len(docs[seed]) - start)
        pieces.append((seed, start, taken, sequence, 0))
        carried, offset = (seed, start + taken) if start + taken < len(docs[seed]) else None, taken
        for d in sorted(unused, key=lambda d: (-score(seed, d), d)) if offset < window else []:
            taken = min(window - offset, len(docs[d]))
            pieces.append((d, 0, taken, sequence, offset))
            unused.remove(d)
            offset += taken
            carried = (d, taken) if taken < len(docs[d]) else None
            if offset == window:
                break
        sequence += 1
    return pieces


def test_filling_equals_brute_force():
    rnd = np.random.default_rng(4)
    for window in (16, 50, 200):
        docs = [rnd.zipf(1.4, rnd.integers(1, 60)) % 97 for _ in range(80)] + [np.arange(300) % 89]
        docs += [docs[3], docs[3]]
        df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=97)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        assert list(packing.fill(docs, idf, sum(map(len, docs)) / len(docs), window)) == brute_fill(docs, window)


def test_the_query_equals_brute_force(spark, library):
    """One shard, rows in order."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).orderBy("doc_id").collect()
    found = packing.pack(spark.createDataFrame(table).coalesce(1), tokenizer()).collect()
    ids = [np.array(library(r.text) + [2], "<u4") for r in table]
    want = [(table[d].doc_id, a, n, zlib.crc32(ids[d][a : a + n].tobytes()), len(ids[d]), s, o) for d, a, n, s, o in brute_fill(ids, 4096)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_rarest_ids_equal_brute_force():
    rnd = np.random.default_rng(3)
    docs = [rnd.integers(0, 50, rnd.integers(1, 30)) for _ in range(300)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs[:40]]), minlength=50)
    rarity = np.r_[np.where(df > 1, 1 / np.maximum(df, 1), 0), 0.0]
    starts = np.cumsum([0, *map(len, docs[:-1])])
    found = np.array(packing.rarest(np.concatenate(docs), starts, rarity)).T.tolist()
    for d, pair in zip(docs, found):
        best = sorted({x for x in d.tolist() if rarity[x]}, key=lambda x: (-rarity[x], d.tolist().index(x)))
        assert [*best, 50, 50][:2] == pair


def test_shards_hold_what_belongs_together(spark, library):
    """Pairs share a word each; a third of all rows are copies, which no shard holds together."""
    rnd = random.Random(6)
    common = "the of and to in is it on as at by".split()
    texts = [" ".join(rnd.choices(common, k=30) + [f"xq{i // 2}zv"] * 3) for i in range(400)] + ["always the same text here again"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    tokens = packing.cut(packing.tokenise(docs, tokenizer(), 2))
    df, *_ = packing.document_frequencies(tokens)
    rows = packing.into_shards(tokens, df, 1000).select("doc_id", "n_tokens", "shard", "sub").toPandas()
    assert len(rows) == 600 and rows["doc_id"].is_unique
    sizes = rows.groupby(["shard", "sub"])["n_tokens"].sum()
    assert len(sizes) > 10 and sizes.max() < 1500
    place = {r.doc_id: (r.shard, r.sub) for r in rows.itertuples()}
    assert sum(place[2 * i] == place[2 * i + 1] for i in range(200)) > 150


def test_every_id_of_a_long_seed_counts():
    """A seed of 60 rare ids that no other document holds, and ten common ones: its neighbour shares only common ones."""
    docs = [np.arange(70), np.arange(100, 170), np.r_[np.arange(60, 70), np.arange(200, 260)], *(np.r_[60 + i, np.arange(300 + 70 * i, 369 + 70 * i)] for i in range(10))]
    df = np.bincount(np.concatenate(docs), minlength=1100)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    index = packing.Index(docs, idf, 70.0)
    for seed in range(len(docs)):
        for d, words in enumerate(docs):
            want = sum(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(words) / 70)) for t in np.intersect1d(docs[seed], words))
            assert abs(index.scores(seed)[d] - want) < 1e-9
    assert [p[0] for p in packing.fill(docs, idf, 70.0, 140)][:2] == [0, 2]
    index.keep(np.arange(len(docs)) == 2)
    assert np.flatnonzero(index.scores(0)).tolist() == [2]


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer()).count() == 0


@pytest.mark.parametrize("top", [1, 2, 1 << 10, 1 << 16, 1 << 31, 1 << 59, (1 << 64) - 1])
def test_simple_8b_round_trip(top):
    rnd = random.Random(top)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 5000):
        ids = np.array([rnd.randint(0, top) if rnd.random() < 0.7 else rnd.randint(0, 1) for _ in range(n)], np.uint64)
        words, offsets, escapes = token_files.encode(ids)
        assert (token_files.decode(words, escapes) == ids).all() and int(offsets[-1]) == len(words)
    assert top < 1 << 60 or len(escapes)


def test_simple_8b_packs_small_ids():
    assert len(token_files.encode(np.zeros(1020, np.uint64))[0]) == 17
    assert len(token_files.encode(np.full(1020, 1000, np.uint64))[0]) == 170


def test_blocks_are_read_alone_and_damage_is_found():
    ids = [np.arange(3000, dtype=np.uint64), np.arange(10, dtype=np.uint64)]
    raw = token_files.to_file(3, [7, None], ids) + token_files.TRAILER.encode()
    assert (token_files.block(raw, 2) == np.concatenate(ids)[2048:3010]).all()
    part, docs, back = token_files.from_file(raw)
    assert (part, docs) == (3, [7, None]) and [len(b) for b in back] == [3000, 10]
    for bad in (raw[:-8], raw[:-16] + raw[-8:], b"x" + raw[1:]):
        with pytest.raises(ValueError):
            token_files.from_file(bad)


def test_token_files_hold_the_documents_in_order(spark, library, odd_docs):
    docs = spark.createDataFrame(odd_docs, SCHEMA)
    out = token_files.token_files(docs, tokenizer(), file_ids=700, parts=5).toPandas().sort_values("start", ignore_index=True)
    assert out["start"].tolist() == (out["n_tokens"].cumsum() - out["n_tokens"]).tolist()
    assert [-1 if pd.isna(d) else int(d) for d in out["doc_id"]] == sorted(-1 if d is None else d for d, *_ in odd_docs)
    want = sorted((-1 if d is None else d, zlib.crc32(np.array(library(t) + [1], "<u4").tobytes())) for d, t, *_ in odd_docs)
    assert sorted((-1 if pd.isna(d) else int(d), c) for d, c in zip(out["doc_id"], out["ids_crc32"])) == want
    assert token_files.token_files(spark.createDataFrame([], SCHEMA), tokenizer()).count() == 0
