"""Numbers of greedy longest-match word pieces, counted without building the pieces.

The vocabulary is a trie with failure links. Where a node has no edge for the next byte,
the longest pieces that are certain by then are popped and the failure link leads to what
is left of them; only how many were popped is kept. With the links followed in advance,
each byte of a word costs one look-up in a table, so the time is linear in the text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import worker_cache

_BATCH_BYTES = 1 << 22


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """The byte strings of a byte-level vocabulary file of the tokenizers library, with their
    ids; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    # Byte-level vocabularies show each byte as a printable character: printable Latin-1
    # as itself, the others from U+0100 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"] for t in content.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}


class Automaton:
    """Greedy longest match over `vocabulary`, which has to hold every single byte."""

    def __init__(self, vocabulary: list[bytes]):
        missing = set(range(256)) - {t[0] for t in vocabulary if len(t) == 1}
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        children, accepts, depth, parent, label = [{}], [False], [0], [0], [0]
        for token in set(vocabulary) - {b""}:
            node = 0
            for c in token:
                to = children[node].get(c)
                if to is None:
                    to = children[node][c] = len(children)
                    children.append({})
                    accepts.append(False)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    label.append(c)
                node = to
            accepts[node] = True
        n = len(children)
        fail, popped = [0] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if accepts[v]:
                popped[v] = 1
                continue
            z, count = fail[parent[v]], popped[parent[v]]
            while label[v] not in children[z]:
                # The root has every byte, so this ends.
                count += popped[z]
                z = fail[z]
            fail[v], popped[v] = children[z][label[v]], count
        # The same with all links followed: next node and pieces popped, by node and byte.
        self.next = np.zeros((n, 256), np.int32)
        self.pops = np.zeros((n, 256), np.uint8)
        self.rest = np.zeros(n, np.int32)
        for v in sorted(range(n), key=depth.__getitem__):
            if v:
                self.next[v] = self.next[fail[v]]
                self.pops[v] = self.pops[fail[v]] + popped[v]
                self.rest[v] = popped[v] + self.rest[fail[v]]
            for c, to in children[v].items():
                self.next[v, c] = to
                self.pops[v, c] = 0
        self.next, self.pops = self.next.ravel(), self.pops.ravel()

    def count_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
        """Pieces of the words data[start:start+length], each with the byte `first` before it."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n = len(starts)
        state = np.full(n, self.next[first], np.int64)
        count = np.full(n, int(self.pops[first]), np.int64)
        left = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if n else 0) + 1), side="right")
        # In step t all words longer than t advance; sorted by length, these are the first ones.
        for t, k in enumerate(left):
            at = state[:k] * 256 + data[starts[:k] + t]
            count[:k] += self.pops[at]
            state[:k] = self.next[at]
        count += self.rest[state]
        out = np.empty(n, np.int64)
        out[order] = count
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _count_texts(automaton: Automaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    pieces = automaton.count_words(data, starts, stops - starts, 32)
    doc = np.searchsorted(ends, starts, side="right")
    return np.bincount(doc, minlength=len(raw)), np.bincount(doc, pieces, minlength=len(raw)).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: `key` (null stays null), n_words long, n_tokens long.

    Words are runs of bytes other than blank and \\x09-\\x0D. The pieces of a word are those of
    greedy longest match on the word with one blank before it, over the bytes of the vocabulary
    at `vocabulary_path` (a file of the tokenizers library, there on each executor; its size is
    fixed and does not depend on the data). Null and empty texts have 0 words and 0 tokens.
    Repeated rows are counted each. Rows are neither shuffled nor put together.
    """

    def task(batches):
        cache = worker_cache()
        slot = ("automaton", vocabulary_path)
        if slot not in cache:
            cache[slot] = Automaton(list(byte_vocabulary(vocabulary_path)))
        automaton = cache[slot]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, tokens = [], []
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size < _BATCH_BYTES):
                    size += len(texts[upto] or "")
                    upto += 1
                w, t = _count_texts(automaton, texts[at:upto])
                words.append(w)
                tokens.append(t)
                at = upto
            if texts:
                cols = [batch.column(0), pa.array(np.concatenate(words)), pa.array(np.concatenate(tokens))]
                yield pa.RecordBatch.from_arrays(cols, [key, "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(task, f"`{key}` {kind}, n_words long, n_tokens long")
