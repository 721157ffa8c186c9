"""Hashes of words and of runs of words, for many texts at a time."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20_24)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 3 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mapping of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words (runs of bytes other than blank and \\x09-\\x0D) of several texts."""

    def __init__(self, texts: list[str | None], lower: bool):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        if lower:
            data = _LOWER[data]
        ends = np.cumsum([len(r) + 1 for r in raw])
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        starts, stops = edge[0::2], edge[1::2]
        lengths = stops - starts
        # Place of each word's text, words of each text, and the first word of each text.
        self.doc = np.searchsorted(ends, starts, side="right")
        self.count = np.bincount(self.doc, minlength=len(raw)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1])).astype(np.int64)
        if not len(starts):
            self.hash = np.empty(0, np.uint64)
            return
        letters = data[~space]
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        # Each letter is mixed with its place, so the sum has no arithmetic that chosen letters could cancel.
        place = np.arange(len(letters)) - np.repeat(begin, lengths)
        value = mix(_BYTE[letters] + _place(int(lengths.max()))[place])
        self.hash = mix(np.add.reduceat(value, begin) + mix(lengths.astype(np.uint64)))

    def inside(self, length: int) -> np.ndarray:
        """First words of all runs of `length` words within one text."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])

    def run_hash(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the runs of `length` words that begin at the words `at`."""
        found = np.zeros(len(at), np.uint64)
        for i, salt in enumerate(_place(length)):
            found += mix(self.hash[at + i] + salt)
        return mix(found)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `length` words within one text, and their first words."""
        at = self.inside(length)
        return self.run_hash(at, length), at

    def whole(self, salt: int) -> np.ndarray:
        """A hash of each text's sequence of words."""
        out = mix(self.count.astype(np.uint64) + np.uint64(salt))
        if len(self.hash):
            at = np.arange(len(self.hash)) - np.repeat(self.first, self.count)
            some = self.count > 0
            out[some] += np.add.reduceat(mix(self.hash + _place(int(self.count.max()))[at]), self.first[some])
        return mix(out)


def _place(n: int) -> np.ndarray:
    """A number for each of the places 0 to n - 1."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP)


def chunks(batches, size: int = CHUNK_BYTES, text: int = -1):
    """Lists of columns out of Arrow batches, cut so that the texts in column `text` have about
    `size` characters; a longer text stands alone. Nothing is dropped."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        texts = columns[text]
        at = 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto] or "") <= size):
                held += len(texts[upto] or "")
                upto += 1
            yield [c[at:upto] for c in columns]
            at = upto
