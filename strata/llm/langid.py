"""Language of texts by cross-parsing entropy.

For each language, the suffix automaton of some labelled text recognises every string that occurs in it. A text is parsed greedily
into the longest phrases that occur there (a symbol that doesn't occur is a phrase of its own). The cost of a language is its number
of phrases times the bits that point to a phrase, log2 of the length of its labelled text; the cheapest language wins. The automata
are dense tables, and many stretches of texts go through them in lock-step. A stretch is parsed from its start, and the parse of the
stretch before it goes on into it until both begin a phrase at the same place; from there on they are the same, so that phrases are
those of the text parsed in one go.

A tenth of the labelled text is kept back, and tells what a language costs by letter in its own texts, and in their letters in random
order. Texts that cost more than a limit between these two are in no learned language.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import held_by_worker

SAMPLE_DOCS = 64  # labelled documents for each language at most
SAMPLE_CHARS = 2_000  # from each of these, at most
TOTAL_SYMBOLS = 96_000  # of labelled text, shared by the languages: bounds the tables
SYMBOLS = 64  # 0: padding, 1: between words, 2: a letter of no labelled text, then the most frequent letters, and an escape for the rest if need be
DIGITS = SYMBOLS - 4  # a rarer letter is the last symbol and three digits, which are symbols from 3 on
STRETCH = 512  # symbols in a stretch
PIECE = 100  # symbols in a piece of the text that is kept back
DOUBTS = 4  # deviations by which a text's cost may be over the limit, and phrases at its ends: DOUBT_PHRASES
DOUBT_PHRASES = 2
LIMIT = 0.6  # of the way from a language's own cost to that of random letters

_alphabetic: list[np.ndarray] = []


def alphabetic() -> np.ndarray:
    if not _alphabetic:
        _alphabetic.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _alphabetic[0]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 starts."""
    links, lengths, goes, last = [-1], [0], [{}], 0
    for c in symbols:
        cur = len(goes)
        goes.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = cur
            p = links[p]
        if p >= 0:
            q = goes[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[cur] = q
            else:
                clone = len(goes)
                goes.append(dict(goes[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    return goes


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # of each letter, by code point; from SYMBOLS on: numbers of rarer letters
    tables: list[np.ndarray]  # at state * SYMBOLS + symbol: four times the next state * SYMBOLS, plus the phrases that end
    bits: np.ndarray  # for a phrase, by language
    limits: np.ndarray  # by language: bits by symbol at the limit, and their deviation in a piece of PIECE symbols; infinite if nothing was kept back

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> "Model":
        langs = sorted(samples)
        share = TOTAL_SYMBOLS // max(1, len(langs))
        counts: dict[int, int] = {}
        for texts in samples.values():
            found, n = np.unique(points("".join(texts).lower()), return_counts=True)
            for c, k in zip(found.tolist(), n.tolist()):
                if chr(c).isalpha():
                    counts[c] = counts.get(c, 0) + k
        frequent = SYMBOLS - 3 if len(counts) <= SYMBOLS - 3 else DIGITS
        symbol = np.where(alphabetic(), 2, 1).astype(np.uint8 if frequent > DIGITS else np.int32)
        for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))):
            symbol[c] = 3 + i if i < frequent else SYMBOLS + i - frequent
        tables, bits, kept = [], [], []
        for lang in langs:
            text, _ = to_symbols(samples[lang], symbol)
            learned = min(share, len(text) - len(text) // 10)
            kept.append(text[learned : learned + share // 4])
            goes = suffix_automaton(text[:learned].tolist())
            states, start = len(goes), np.zeros(SYMBOLS, np.int64)
            start[list(goes[0])] = list(goes[0].values())
            # a symbol that doesn't go on ends the phrase and begins another one; an unknown one is a second phrase by itself
            table = np.tile(np.where(start > 0, start * SYMBOLS * 4 + 1, 2), states)
            table[::SYMBOLS] = 1  # padding ends the phrase
            table[:SYMBOLS] = np.where(start > 0, start * SYMBOLS * 4, 1)
            table[0] = 0
            at = np.repeat(np.arange(states), [len(g) for g in goes]) * SYMBOLS + np.array([c for g in goes for c in g], np.int64)
            table[at] = np.array([s for g in goes for s in g.values()], np.int64) * SYMBOLS * 4
            tables.append(table.astype(np.int32))
            bits.append(np.log2(max(2, learned)))
        model = cls(langs, symbol, tables, np.array(bits), np.full((len(langs), 2), np.inf))
        rnd = np.random.default_rng(5)
        for k, text in enumerate(kept):
            if pieces := len(text) // PIECE:
                text, owner = text[: pieces * PIECE], np.repeat(np.arange(pieces), PIECE)
                own, mixed = (model.phrases([""] * pieces, (x, owner))[:, k] * bits[k] / PIECE for x in (text, rnd.permutation(text)))
                model.limits[k] = own.mean() + LIMIT * (mixed.mean() - own.mean()), own.std() + bits[k] / PIECE
        return model

    def phrases(self, texts: list[str], coded: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Phrases of each text (rows) by language; ``coded``: to_symbols() of the texts."""
        symbols, owner = coded or to_symbols(texts, self.symbol)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(symbols):
            return out
        first = np.searchsorted(owner, np.arange(len(texts)))
        size = np.diff(first, append=len(owner))
        n = -(-size // STRETCH)
        text_of = np.repeat(np.arange(len(texts)), n)
        number = np.arange(len(text_of)) - np.repeat(np.cumsum(n) - n, n)
        begin = first[text_of] + number * STRETCH
        length = np.minimum(STRETCH, first[text_of] + size[text_of] - begin)
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        later = np.flatnonzero(number > 0)
        later, before = place[later], place[later - 1]  # stretches that go on after another one
        goes_on = np.zeros(len(order), bool)
        goes_on[before] = True
        text_of, begin, length = text_of[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, STRETCH + 1), "right")
        padded = np.r_[symbols, np.zeros(1, np.uint8)]
        steps = [padded[begin[: active[t]] + t].astype(np.int64) for t in range(int(length.max()))]
        starts = np.zeros((len(steps), len(begin)), bool)  # where phrases begin
        for k, table in enumerate(self.tables):
            state = np.zeros(len(begin), np.int64)
            starts[:] = False
            for t, s in enumerate(steps):
                m = len(s)
                got = table[state[:m] + s]
                starts[t, :m] = (state[:m] == 0) | (got & 3 > 0)
                state[:m] = got >> 2
            count = starts.sum(0)
            open_, t = later[state[before] != 0], 0
            at = state[before[state[before] != 0]]
            lost: list[int] = []  # texts of which a stretch was passed through to its end, and others follow
            while len(open_):
                got = table[at + padded[begin[open_] + t]]
                begins, own = (at == 0) | (got & 3 > 0), starts[t, open_]
                count[open_] += np.where(begins & own, 0, begins.astype(np.int64) - own)
                t += 1
                ended = length[open_] == t
                lost += text_of[open_[ended & goes_on[open_] & ~(begins & own)]].tolist()
                go = ~ended & ~(begins & own)
                open_, at = open_[go], (got >> 2)[go]
            out[:, k] = np.bincount(text_of, count, len(texts))
            for i in set(lost):
                out[i, k] = parsed(symbols[first[i] : first[i] + size[i]].tolist(), table)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """The cheapest language of each text (ties: the first by name) and its share of the posterior; `und`, 0 without letters.

        And whether the text is in a learned language: at least half of its letters are known, and what it costs is within the limit
        of some language. Where nothing was kept back, the limit is infinite.
        """
        full = [t or "" for t in texts]
        symbols, owner = to_letters(full, self.symbol)
        known = np.bincount(owner[symbols > 2], minlength=len(full)) / np.maximum(1, np.bincount(owner[symbols > 1], minlength=len(full)))
        coded = spelled(symbols, owner)
        phrases = self.phrases(full, coded)
        cost, size = phrases * self.bits, np.bincount(coded[1], minlength=len(full))[:, None]
        limit = size * self.limits[:, 0] + DOUBTS * self.limits[:, 1] * np.sqrt(size * PIECE) if self.langs else np.zeros((len(full), 0))
        fits = (known >= 0.5) & ((phrases - DOUBT_PHRASES) * self.bits <= np.nan_to_num(limit, nan=np.inf)).any(1)
        langs, scores = [], []
        for t, c in zip(texts, cost):
            if not self.langs or not c.any() or not t or not any(map(str.isalpha, t)):
                langs.append("und")
                scores.append(0.0)
            else:
                best = int(np.argmin(c))
                langs.append(self.langs[best])
                scores.append(float(1 / np.exp2(np.minimum(0, c[best] - c)).sum()))
        return langs, scores, fits.tolist()


def parsed(symbols: list[int], table: np.ndarray) -> int:
    """Phrases of one text, symbol by symbol."""
    state = count = 0
    for s in symbols:
        got = int(table[state + s])
        count += state == 0 or got & 3 > 0
        state = got >> 2
    return count


def to_symbols(texts: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of lower-cased texts in a row, one between words; and the text that each belongs to."""
    return spelled(*to_letters(texts, symbol))


def spelled(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rarer letters as an escape and their digits, without loss."""
    rare = symbols >= SYMBOLS
    if not rare.any():
        return symbols.astype(np.uint8, copy=False), owner
    n = np.where(rare, 4, 1)
    out, first, number = np.repeat(symbols, n), (np.cumsum(n) - n)[rare], symbols[rare] - SYMBOLS
    out[first] = SYMBOLS - 1
    for i in range(3):
        out[first + 1 + i] = 3 + number // DIGITS ** (2 - i) % DIGITS
    return out.astype(np.uint8), np.repeat(owner, n)


def to_letters(texts: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As to_symbols(), with rarer letters by their numbers."""
    lowered = [t.lower() for t in texts]
    codes = points("\n".join(lowered))
    out = symbol[codes]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[: len(codes)]
    keep = out != 1
    keep[:-1] |= (out[1:] != 1) & (owner[1:] == owner[:-1])  # of a run between words, the last
    return out[keep], owner[keep]


def fit(docs: DataFrame, usable=None) -> Model:
    """A model from documents with lang (null: none) for which ``usable`` holds: for each language, excerpts of the SAMPLE_DOCS with the smallest hashes."""
    labelled = docs.where(F.col("lang").isNotNull())
    labelled = labelled if usable is None else labelled.where(usable)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS).select("doc_id").distinct()
    # SAMPLE_DOCS ids for each language at most
    rows = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))).where(F.col("n") <= SAMPLE_DOCS).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        samples.setdefault(r.lang, []).append(r.text or "")
    return Model.fit(samples)


def with_language(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """docs with a struct column (lang, score, fits) from its text."""
    raw = zlib.compress(pickle.dumps(model), 1)
    held = docs.sparkSession.sparkContext.broadcast(raw)  # of bounded size: TOTAL_SYMBOLS
    key = zlib.crc32(raw)

    @F.arrow_udf("lang string, score double, fits boolean")
    def predict(texts: pa.Array) -> pa.Array:
        own = held_by_worker(("language", key), lambda: pickle.loads(zlib.decompress(held.value)))
        langs, scores, fits, given = [], [], [], texts.to_pylist()
        at = 0
        while at < len(given):
            end, size = at, 0
            while end < len(given) and size < 2_000_000:
                size += len(given[end] or "")
                end += 1
            a, b, c = own.predict(given[at:end])
            langs, scores, fits, at = langs + a, scores + b, fits + c, end
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())], ["lang", "score", "fits"])

    return docs.withColumn(name, predict("text"))


def held_out():
    """Documents that are not learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """documents -> one row per row: doc_id, held_out, lang_pred, score.

    The model learns from rows that are not held out and have a lang. Texts that are null or without a letter are `und`
    with score 0, and all texts if nothing can be learned. Every row, repeated ones too, is predicted from its whole text alone, however
    long; a null id is not held out, and further columns are ignored.
    """
    model = fit(docs, ~held_out())
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of documents, with all their columns, whose text is in a learned language.

    Texts without a letter (null and empty ones, too: `und`) go; so do texts in another script, and texts that the automata of all
    languages parse hardly better than letters in random order. Texts too short to tell, and those that several languages fit as well,
    stay. Every row is judged by its whole text alone, however long, repeated rows alike. Nothing stays if no row has a lang.
    """
    rows = with_language(docs.select(F.struct("*").alias("kept"), "text"), fit(docs))
    return rows.where((F.col("language.lang") != "und") & F.col("language.fits")).select("kept.*")
