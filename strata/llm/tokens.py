"""Token ids of whole texts with a public tokenizer file, through the tokenizers library, one distinct piece at a time.

The word-level BPE file drops white space, lower-cases, and splits letters, digits and marks, so a text's ids are those of its pieces
in a row. Pieces are cut for some megabytes of text at a time in numpy. Each worker keeps the ids of the pieces that it has met, a bounded
table, and asks the library only about new ones. A piece is known by its bytes: up to eight of them are a number in an open-addressing
table, longer ones are keys of a dict; no hash stands for a piece. Texts with characters beyond Latin-1, or with control characters, go
through the library's whole chain. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import os

import numpy as np

from strata.llm.common import held_by_worker

KNOWN = 500_000  # pieces that a worker remembers
CHUNK = 1_000_000  # characters that are cut at a time

SPACE, LETTER, NUMBER, MARK = range(4)
KIND = np.full(256, MARK, np.uint8)
KIND[[9, 10, 11, 12, 13, 32, 160]] = SPACE
KIND[[c for c in range(256) if chr(c).isalpha()]] = LETTER
KIND[[*b"0123456789", 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
LOWER = bytes(ord(chr(c).lower()) if ord(chr(c).lower()) < 256 else c for c in range(256))
CONTROL = bytes([*range(9), *range(14, 32), *range(127, 160)])
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SPREAD, SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 21


def text_ids(path: str) -> "TextIds":
    """The tokenizer of this worker."""
    return held_by_worker(("tokens", path), lambda: TextIds(path))


def eight_bytes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes of each piece data[start : start + length] as a little-endian number, zeros behind short ones; ``data`` has seven bytes more than its pieces need."""
    loads = np.ndarray(max(0, len(data) - 7), "<u8", data, 0, (1,))
    return loads[starts] & FIRST_BYTES[np.minimum(lengths, 8)]


class Numbers:
    """Numbers of pieces without zero bytes, from 0 on in the order of add()."""

    def __init__(self):
        self.keys, self.values = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.long: dict[bytes, int] = {}

    def find(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, -1 where it has none; and its first eight bytes."""
        keys = eight_bytes(data, starts, lengths)
        slots = (keys * SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = self.keys[slots]
        numbers = np.where(held == keys, self.values[slots], -1)
        walk = np.flatnonzero((held != keys) & (held != 0))
        while len(walk):  # past pieces of the same slot; an empty one ends the search
            slots[walk] = slots[walk] + 1 & (1 << SLOT_BITS) - 1
            held = self.keys[slots[walk]]
            same = held == keys[walk]
            numbers[walk[same]] = self.values[slots[walk[same]]]
            walk = walk[~same & (held != 0)]
        of_long = np.flatnonzero(lengths > 8)
        get = self.long.get
        numbers[of_long] = [get(data[a : a + n], -1) for a, n in zip(starts[of_long].tolist(), lengths[of_long].tolist())]
        return numbers, keys

    def add(self, piece: bytes, number: int) -> None:
        if len(piece) > 8:
            self.long[piece] = number
            return
        key = int.from_bytes(piece, "little")
        slot = (key * int(SPREAD) & (1 << 64) - 1) >> 64 - SLOT_BITS
        while self.keys[slot]:
            slot = slot + 1 & (1 << SLOT_BITS) - 1
        self.keys[slot], self.values[slot] = key, number


class TextIds:
    """batch(texts) -> for each text an array of its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() < 1 << 16 else "<u4")
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        self.ends[[i for t, i in self.full.get_vocab().items() if t.endswith("</w>")]] = True
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.as_bytes = {b: chr(b if b in keep else next(others)) for b in range(256)}
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.flat, self.at, self.n = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces in a row, and how many each has; an id whose token ends a word ends a piece."""
        ids, counts = [], []
        for at in range(0, len(pieces), 5000):
            some = pieces[at : at + 5000]
            line = " ".join(p if p.isascii() else p.encode().decode("latin-1").translate(self.as_bytes) for p in some)
            got = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != len(some):  # a vocabulary of another kind: every piece by itself
                each = self._plain(some)
                got, cuts = np.concatenate(each), np.cumsum([len(e) for e in each])
            ids.append(got)
            counts.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null gives none."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < CHUNK:
                size += len(texts[end] or "")
                end += 1
            out += self._some(texts[at:end])
            at = end
        return out

    def _some(self, texts: list[str | None]) -> list[np.ndarray]:
        raw: list[bytes] = []
        odd = []
        for i, t in enumerate(texts):
            try:
                b = (t or "").encode("latin-1").translate(LOWER)
                if len(b.translate(None, CONTROL)) != len(b):
                    raise ValueError
            except ValueError:
                odd.append(i)
                b = b""
            raw.append(b)
        out = self._latin(raw)
        for i, ids in zip(odd, self._plain([texts[i] for i in odd])):
            out[i] = ids
        return out

    def _cut(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased Latin-1 bytes -> the bytes, and starts and lengths of the pieces."""
        data = np.frombuffer(joined, np.uint8)
        kind = KIND[data]
        start = np.diff(kind, prepend=np.uint8(SPACE)) != 0
        start |= kind == NUMBER
        start &= kind != SPACE
        for p in np.flatnonzero(start & (data == 39)).tolist():
            tail = joined[p + 1 : p + 3]
            n = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
            if n:
                start[p + 1] = False
                if p + 1 + n < len(data) and kind[p + 1 + n] == LETTER:
                    start[p + 1 + n] = True
        cut = start | (kind == SPACE)
        edges = np.flatnonzero(cut)
        of_piece = start[edges]
        return data, edges[of_piece], np.diff(edges, append=len(data))[of_piece]

    def _latin(self, raw: list[bytes]) -> list[np.ndarray]:
        joined = b"\n".join(raw) + b"\n" * 8
        _, starts, lengths = self._cut(joined)
        if not len(starts):
            return [np.zeros(0, self.dtype)] * len(raw)
        if len(self.n) > KNOWN:
            self._forget()
        pieces, _ = self.known.find(joined, starts, lengths)
        new = np.flatnonzero(pieces < 0)
        if len(new):
            words = list(dict.fromkeys(joined[a : a + n] for a, n in zip(starts[new].tolist(), lengths[new].tolist())))
            ids, counts = self._learn([w.decode("latin-1") for w in words])
            for number, word in enumerate(words, len(self.n)):
                self.known.add(word, number)
            self.at = np.r_[self.at, len(self.flat) + np.cumsum(counts) - counts]
            self.n = np.r_[self.n, counts]
            self.flat = np.r_[self.flat, ids]
            pieces[new], _ = self.known.find(joined, starts[new], lengths[new])
        n = self.n[pieces]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.at[pieces] - (ends - n), n)]
        text_ends = np.cumsum([len(b) + 1 for b in raw])
        cuts = np.r_[0, ends][np.searchsorted(starts, text_ends)]
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
