"""Repeated passages, found by difference-cover anchors.

Two places that show the same 35 words are in step modulo the period only by chance, but a
difference cover has for every shift two of its positions that far apart: so among the first
21 words of the two windows there is one place where both stand on positions of the cover
and the next 15 words agree. Only windows of 15 words at cover positions are hashed and compared, 5 in 21.
Where such an anchor is repeated, the passage is extended: the 35-word windows around it,
and no others, are hashed and compared in turn.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, heavy_values
from .postings import coarse, repeated
from .words import Words, chunks

WINDOW = 35
# A perfect difference set: every number modulo PERIOD is the difference of two of COVER.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)


def _distinct(columns):
    """The rows of a chunk, each text once."""
    at = {k: i for i, k in reversed(list(enumerate(columns[0])))}
    keep = sorted(at.values())
    return [[c[i] for i in keep] for c in columns]


def _keys(values) -> np.ndarray:
    return np.array(values, np.int64).view(np.uint64)


def anchors(window: int = WINDOW):
    """Postings of the hashes at cover positions."""
    short = window - PERIOD + 1
    if short < 1:
        raise ValueError(f"windows have to be of {PERIOD} words at least")
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def postings(batches):
        for columns in chunks(batches):
            keys, texts = _distinct(columns)
            words = Words(texts, lower=False)
            at = words.inside(short)
            doc = words.doc[at]
            place = at - words.first[doc]
            # Texts too short for one window have no anchors.
            chosen = in_cover[place % PERIOD] & (words.count[doc] >= window)
            yield coarse(words.run_hash(at[chosen], short)), doc[chosen], place[chosen], _keys(keys)

    return postings


def windows(window: int = WINDOW):
    """Postings of the whole windows that hold a repeated anchor within the first period."""

    def postings(batches):
        for columns in chunks(batches):
            _, _, keys, found, texts = columns
            words = Words(texts, lower=False)
            at = words.inside(window)
            change = np.zeros(len(words.hash) + 1, np.int32)
            for i, b in enumerate(found):
                place = np.frombuffer(b, "<u4").astype(np.int64)
                np.add.at(change, words.first[i] + np.maximum(place - PERIOD + 1, 0), 1)
                np.add.at(change, words.first[i] + place + 1, -1)
            at = at[np.cumsum(change)[at] > 0]
            doc = words.doc[at]
            yield words.run_hash(at, window), doc, at - words.first[doc], _keys(keys)

    return postings


def _places(found: np.ndarray) -> pa.Table:
    """key, places: the numbers of each document's postings."""
    order = np.lexsort((found["number"], found["key"]))
    keys, numbers = found["key"][order], found["number"][order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    stop = np.append(edge[1:], len(keys))
    return pa.table(
        {
            "key": pa.array(keys[edge].view(np.int64), pa.int64()),
            "places": pa.array([np.unique(numbers[a:b]).tobytes() for a, b in zip(edge, stop)], pa.binary()),
        }
    )


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _sizes(batches):
    for batch in batches:
        found = [(len(w), _sha(w)) for w in ((t or "").encode().split() for t in batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())],
            ["doc_id", "key", "n_words", "sha"],
        )


def _cover(places: bytes, n: int, window: int) -> np.ndarray:
    """Which of n words lie in no window that begins at one of the places."""
    change = np.zeros(n + 1, np.int32)
    starts = np.frombuffer(places, "<u4").astype(np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) == 0


def kept_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row per row of `docs`.

    A word is removed if it lies in a run of `window` words that also begins at another place, in
    the same document or another one. All documents are judged as they came. `kept_text` is
    what is left, joined by single blanks; it is null where nothing is removed, as the text
    then stays as it is. Null and empty texts have no words. Rows with equal texts are separate
    documents, so that of these nothing is left if they have `window` words. Words and texts are told
    apart by 64-bit hashes.
    """
    table = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.col("text").cast("string").alias("text"))
    sizes = cut(table.mapInArrow(_sizes, "doc_id long, key long, n_words long, sha string"), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    found = cut(
        repeated(table.select("key", "text"), anchors(window), _places, "key long, places binary", total * len(COVER) // PERIOD, 2),
        "anchors",
    )
    # Each text once, copies folded before the shuffle, so there are no hot keys. This is the only shuffle of texts: both
    # joins read it, for which they have to take the same columns from it (the hints keep the plan the same at every size).
    folded = table.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    places = folded.join(found.hint("merge"), "key").select("doc_id", "n", "key", "places", "text")
    spans = repeated(places, windows(window), _places, "key long, places binary", total // 4, 2)

    def task(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for doc_id, n, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if n > 1:
                    continue
                words = (text or "").encode().split()
                kept = list(compress(words, _cover(places, len(words), window).tolist())) if places else words
                gone = len(words) - len(kept)
                row = (doc_id, len(words), gone, _sha(kept), b" ".join(kept).decode() if gone else None)
                for column, value in zip(out, row):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    single = folded.join(spans.hint("merge"), "key", "left").select("doc_id", "n", "text", "places").mapInArrow(task, schema)
    # Of a text that several rows have, all or nothing is repeated.
    copied = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    # Those with the most rows are known by name, so that their rows stay where they are.
    hot = heavy_values(sizes, "key")
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    copies = sizes.filter(is_hot).unionByName(sizes.filter(~is_hot).join(copied.hint("merge"), "key", "left_semi").select(*sizes.columns))
    whole = F.col("n_words") >= window
    return single.unionByName(
        copies.select(
            "doc_id",
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(0).alias("n_removed"),
            F.when(whole, F.lit(_sha([]))).otherwise(F.col("sha")).alias("kept_sha256"),
            F.when(whole, F.lit("")).alias("kept_text"),
        )
    )
