"""Token ids of whole texts by a tokenizer file, encoded unit by unit.

For a tokenizer that drops white space, folds case and separates letters, digits and signs, the ids
of a text are the ids of its units, one after another. A unit is a run of Latin letters, of digits
or of ASCII signs inside a word; a word with an apostrophe or with any other character is one unit.
Units repeat, so each worker keeps a unit's ids, by the unit's bytes, in a table of bounded size, from
which rare units go when it is full; texts are assembled from that table with array operations. ``Encoder`` checks
the property on a probe text, which has every letter of that range beside letters, digits and signs,
when it opens a file, and otherwise encodes whole texts. Strings of special tokens inside a text are
ordinary text, as the tokenizers' own notes have it (``encode_special_tokens``).
"""

from __future__ import annotations

import os

import numpy as np

from .words import LOWER, SPACE, Words, per_text, split_words

#: Of each byte: 0 white space, 1 letter, 2 digit, 3 sign, 4 apostrophe or part of another character.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3

#: U+00C0 to U+017F without the signs of multiplication and division, and without the dotted capital I, which lower-cases to two characters.
_LETTERS = [chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130)]
_PROBE = "Un,deux...Trois(4x56)É!ça-va ×÷, x÷y One\ttwo  THREE\n\n4.5 déjà-vu, it's\r\nnon break (x) end. Á\x0bΣΣ ́z " + " ".join(f"{c} a{c}B {c}{c} 1{c}2 .{c}! {c}İ İ. 1İ_ " for c in _LETTERS)
_open: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "Encoder":
    """One encoder for each file and process."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def split_units(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """The units of several texts; buf has ASCII letters in lower case."""
    words = split_words(buf, offsets)
    kind = _CLASS[buf]
    # Two-byte letters: those of _LETTERS.
    lead = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5))
    lead = lead[~((buf[lead] == 0xC3) & ((buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)) | (buf[lead] == 0xC4) & (buf[lead + 1] == 0xB0))]
    kind[lead] = kind[lead + 1] = 1
    odd = np.concatenate([[0], np.cumsum(kind == 4)])
    plain = odd[words.end] == odd[words.start]
    change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    word = np.searchsorted(words.start, change, side="right") - 1
    inside = (change > words.start[word]) & (change < words.end[word]) & plain[word] if len(words.start) else np.zeros(0, bool)
    change, word = change[inside], word[inside]
    start = np.sort(np.concatenate([words.start, change]))
    end = np.sort(np.concatenate([words.end, change]))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(buf, offsets, start, end, doc, np.searchsorted(doc, np.arange(len(offsets))))


#: Bytes of text that are encoded at a time: the more, the fewer times a unit is looked up.
CHUNK = 1 << 20


class Encoder:
    KEEP, KEEP_BYTES = 250_000, 1 << 24

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()
        raw = np.frombuffer(_PROBE.encode(), np.uint8)
        self.by_word = True
        self.by_word = self._plain(_PROBE) == self.ids(raw, np.array([0, len(raw)], np.int64))[0].tolist()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        """An empty table: number of each unit, and where in the pool the ids of each number begin, with one more for the end."""
        self.number: dict[bytes, int] = {}
        self.begin, self.bytes = np.zeros(1 << 12, np.int64), 0
        self.hits = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)

    def _thin(self) -> None:
        """Leaves those units that several chunks had since the last time: the most frequent ones, up to half of the table's bounds."""
        units, hits = list(self.number), self.hits[: len(self.number)]
        keep = np.flatnonzero(hits > 1)
        keep = keep[np.argsort(-hits[keep], kind="stable")[: self.KEEP // 2]]
        keep = np.sort(keep[np.cumsum([len(units[k]) for k in keep.tolist()]) <= self.KEEP_BYTES // 2])
        size = self.begin[keep + 1] - self.begin[keep]
        ids = self.pool[np.repeat(self.begin[keep] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        self._forget()
        self._add([units[k] for k in keep.tolist()], size, ids)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((x for i in ids for x in i), np.uint32)

    def _add(self, units: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.number)
        while n + len(units) >= len(self.begin):
            self.begin, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.hits))
        self.begin[n + 1 : n + 1 + len(units)] = self.begin[n] + np.cumsum(sizes)
        end = int(self.begin[n + len(units)])
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.begin[n] : end] = ids
        self.number.update(zip(units, range(n, n + len(units)), strict=True))
        self.bytes += sum(map(len, units))

    def _known(self, buf: np.ndarray, offsets: np.ndarray):
        """Where each word's ids lie in the pool, how many there are, and the words."""
        words = split_units(LOWER[buf], offsets)
        place, distinct = words.numbers()
        units = distinct.to_pylist()
        if len(self.number) > self.KEEP or self.bytes > self.KEEP_BYTES:
            self._thin()
        found = list(map(self.number.get, units))
        if None in found:
            new = [u for u, k in zip(units, found, strict=True) if k is None]
            self._add(new, *self._batch([u.decode("utf-8", "replace") for u in new]))
            found = list(map(self.number.get, units))
        number = np.array(found, np.int64)
        self.hits[number] += 1
        return words, self.begin[number][place], (self.begin[number + 1] - self.begin[number])[place]

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        if self.by_word:
            words, _, size = self._known(buf, offsets)
            return per_text(size, words.first)
        return self._batch(self._texts(buf, offsets))[0]

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        if self.by_word:
            words, at, size = self._known(buf, offsets)
            ends = np.cumsum(size)
            ids = self.pool[np.repeat(at - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            sizes = per_text(size, words.first)
        else:
            sizes, ids = self._batch(self._texts(buf, offsets))
        return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def _texts(buf: np.ndarray, offsets: np.ndarray) -> list[str]:
        raw = buf.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
