"""Packing tokenised documents into sequences by bounded-space online best fit.

A fixed number of sequences is open at a time. They are kept by free space, and a bitset
says which amounts of free space occur, so the best fit for a piece is the lowest set bit at
or above its length. If nothing fits and all places are taken, the fullest one closes.
"""

from __future__ import annotations

import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import worker_cache
from .token_count import byte_vocabulary

CAPACITY = 1024
OPEN_BINS = 4096
END_ID = 2
# Documents packed together; more groups as the table grows, each packed by one task.
GROUP_DOCS = 8192
# White space as Unicode defines it, which Python's \s exceeds. Runs from LONG_RUN on are not given to the
# pattern of the parts, whose look-ahead keeps a state for each character (1,000,000 at most).
LONG_RUN = 100_000
_SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_RUNS = re.compile(rf"(?<!{_SPACES}){_SPACES}{{{LONG_RUN},}}")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Places pieces one after another; `place` gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open ones, by free space
        self.mask = self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        found = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.n_bins
            self.n_bins += 1
            self.n_open += 1
            if length < free and self.n_open > self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.n_open -= 1
        rest = free - length
        if rest:
            self.bins[rest].append(found)
            self.mask |= 1 << rest
        else:
            self.n_open -= 1
        return found, self.capacity - free


def added_tokens(path: str, encode_special_tokens: bool) -> dict[str, int]:
    """Strings of the tokenizer's file that are no text, with their ids: all that were added to the
    vocabulary, but for special ones if these are to be encoded as text."""
    with open(path, encoding="utf-8") as f:
        added = [t for t in json.load(f).get("added_tokens", []) if not (t["special"] and encode_special_tokens)]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that depend on what is around them are not supported")
    return {t["content"]: t["id"] for t in added}


def ids_of(path: str, encode_special_tokens: bool = True):
    """A function from a text to its ids as little-endian 32-bit numbers.

    The ids are those of the tokenizers library for the byte-level BPE file at `path` (tests
    compare them). They are computed by tiktoken from that file's vocabulary, at about five
    times the speed. `encode_special_tokens` is as in the library, whose default is False: strings
    of special tokens are ordinary text if it is True, and their own ids otherwise.
    """
    import tiktoken

    vocabulary = byte_vocabulary(path)
    # Parts of a text that are encoded on their own, as in the file's pre-tokenizer (fixed value).
    parts = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding(path, pat_str=parts, mergeable_ranks=vocabulary, special_tokens={})
    spaces = tiktoken.Encoding(path, pat_str=r"\s+", mergeable_ranks=vocabulary, special_tokens={})

    def encode(text: str, by=encoding) -> bytes:
        return by.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def encode_any(text: str) -> bytes:
        if len(text) < LONG_RUN:
            return encode(text)
        # A part never reaches into a run of white space from before it. The run is one part, but for
        # its last character if more follows, with which the next part begins.
        out, at = [], 0
        for m in _LONG_RUNS.finditer(text):
            stop = m.end() - (m.end() < len(text))
            out += [encode(text[at : m.start()]), encode(text[m.start() : stop], spaces)]
            at = stop
        return b"".join((*out, encode(text[at:])))

    added = {t: i.to_bytes(4, "little") for t, i in added_tokens(path, encode_special_tokens).items()}
    if not added:
        return encode_any
    # The longest of those that begin at the same place.
    apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode_all(text: str) -> bytes:
        if not any(t in text for t in added):
            return encode_any(text)
        # Every other one of these is an added token; what is between is encoded on its own.
        cut = apart.split(text)
        return b"".join(added[t] if i % 2 else encode_any(t) for i, t in enumerate(cut))

    return encode_all


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, encode_special_tokens: bool = True
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document, in one pass."""
    end = end_id.to_bytes(4, "little")

    def task(batches):
        cache = worker_cache()
        slot = ("ids", tokenizer_path, encode_special_tokens)
        if slot not in cache:
            cache[slot] = ids_of(tokenizer_path, encode_special_tokens)
        encode = cache[slot]
        for batch in batches:
            out = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    crc = zlib.crc32(ids[4 * start : 4 * stop])
                    for column, value in zip(out, (doc_id, piece, start, stop - start, crc)):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(task, _PIECES)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
    encode_special_tokens: bool = True,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Every document is its ids and `end_id` (null and empty text: `end_id` alone). Documents of more than
    `capacity` ids are cut into pieces of that length, the first of which may be shorter. The
    pieces of a sequence fill it from offset 0 without gaps. Pieces are packed in groups that a
    hash deals out, the longest first, so that reruns agree and little is left open; rows that are the same in all columns may swap
    places. Only the pieces' numbers are shuffled, never ids or texts. The tokenizer's file is
    there on each executor. With `encode_special_tokens` False, strings of the file's special tokens
    become those tokens, as in the library by default.
    """
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    h = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    found = (
        pieces(docs, tokenizer_path, capacity, end_id, encode_special_tokens)
        .withColumn("group", F.pmod(h, F.lit(groups)).cast("int"))
        .repartition("group")
        .sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    )

    def task(batches):
        group, fit = None, None
        for batch in batches:
            sequence, offset = [], []
            for g, length in zip(batch.column(5).to_pylist(), batch.column(3).to_pylist()):
                if g != group:
                    group, fit = g, BestFit(capacity, open_bins)
                at, start = fit.place(length)
                sequence.append((g << 36) + at)
                offset.append(start)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return found.mapInArrow(task, _PIECES + ", sequence_id long, offset long")
