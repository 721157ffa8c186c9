"""Hashes that occur in several places of a corpus.

A posting is a hash, the document it occurs in and a number (such as the place). Postings are
exchanged packed: a chunk of documents sends each range of hashes one row with all its
postings there. A hash that is frequent within one chunk is known to be repeated without
asking, so only a mark goes to its range, and its postings go straight to their documents.
Thus a range gets few postings of one hash from a chunk, however frequent it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

OFTEN = np.uint32(0xFFFFFFFF)  # stands for a count too large to matter
RANGE_POSTINGS = 1 << 21
_MAPPED = "part int, hashes binary, docs binary, numbers binary, keys binary, marks binary, known binary"
_REDUCED = "part int, postings binary"
POSTING = np.dtype([("key", "<u8"), ("hash", "<u8"), ("number", "<u4"), ("count", "<u4")])


def part_bits(total: int) -> int:
    """Leading bits of a hash that name its range: ranges hold about RANGE_POSTINGS postings."""
    return max(6, (total // RANGE_POSTINGS).bit_length())


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes first: sorted numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not b:
        return np.empty(0, dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _pack(hashes, docs, numbers, keys, limit, bits, of_document):
    """Rows of _MAPPED for the postings of a chunk; `docs` points into `keys`."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    own = numbers
    numbers = own[docs] if of_document else own[order]
    edge = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    size = np.diff(np.append(edge, len(hashes)))
    often = np.repeat(size >= limit, size)
    marks = hashes[edge[size >= limit]]
    known = np.zeros(int(often.sum()), POSTING)
    known["key"], known["hash"], known["number"] = keys[docs[often]], hashes[often], numbers[often]
    known["count"] = OFTEN
    known = known[np.argsort(known["key"], kind="stable")]
    hashes, docs, numbers = hashes[~often], docs[~often], numbers[~often]
    shift = np.uint64(64 - bits)
    # Ranges that something falls into, and where each begins and ends in the three sorted arrays.
    ranges = [x >> shift for x in (hashes, marks, known["key"])]
    occupied = np.unique(np.concatenate(ranges))
    cuts = [(np.searchsorted(x, occupied), np.searchsorted(x, occupied, side="right")) for x in ranges]
    out = [[] for _ in range(7)]
    for i, part in enumerate(occupied.astype(np.int64).tolist()):
        (a, b), (c, d), (e, f) = ((first[i], stop[i]) for first, stop in cuts)
        used, local = np.unique(docs[a:b], return_inverse=True)
        row = (
            part,
            _planes(hashes[a:b]),
            _planes(local.astype("<u4")),
            _planes((own[used] if of_document else numbers[a:b]).astype("<u4")),
            keys[used].tobytes(),
            marks[c:d].tobytes(),
            known[e:f].tobytes(),
        )
        for column, value in zip(out, row):
            column.append(value)
    types = [pa.int32()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [c.split()[0] for c in _MAPPED.split(", ")])


def _reduce(table: pa.Table, least: int, bits: int, of_document: bool) -> pa.Table:
    hashes, keys, numbers, marks, known = [], [], [], [], []
    for row in table.to_pylist():
        hashes.append(_unplanes(row["hashes"], "<u8"))
        at = _unplanes(row["docs"], "<u4")
        keys.append(np.frombuffer(row["keys"], "<u8")[at])
        number = _unplanes(row["numbers"], "<u4")
        numbers.append(number[at] if of_document else number)
        marks.append(np.frombuffer(row["marks"], "<u8"))
        known.append(np.frombuffer(row["known"], POSTING))
    del table
    h, k, n, marks, known = (np.concatenate(x) for x in (hashes, keys, numbers, marks, known))
    del hashes, keys, numbers
    order = np.lexsort((n, k, h))
    h, k, n = h[order], k[order], n[order]
    # The same document may have come from several chunks, as copies.
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])
    h, k, n = h[new], k[new], n[new]
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(edge, len(h)))
    count = np.where(np.isin(h[edge], marks), OFTEN, size.astype(np.uint32))
    count = np.repeat(count, size)
    keep = count >= least
    found = np.zeros(int(keep.sum()), POSTING)
    found["key"], found["hash"], found["number"], found["count"] = k[keep], h[keep], n[keep], count[keep]
    found = np.concatenate((found, known))
    found = found[np.argsort(found["key"], kind="stable")]
    parts, first = np.unique(found["key"] >> np.uint64(64 - bits), return_index=True)
    stop = np.append(first[1:], len(found))
    return pa.table(
        {
            "part": pa.array(parts.astype(np.int32), pa.int32()),
            "postings": pa.array([found[a:b].tobytes() for a, b in zip(first, stop)], pa.binary()),
        }
    )


def coarse(hashes: np.ndarray) -> np.ndarray:
    """The leading 48 bits. Enough where a false match costs a little work and no more; bytes
    that are all zero take no room in the exchange."""
    return hashes & np.uint64(0xFFFFFFFFFFFF0000)


def repeated(
    source: DataFrame, chunk_postings, gather, schema: str, total: int, limit: int, least: int = 2, of_document: bool = False
) -> DataFrame:
    """Postings whose hash occurs at least `least` times, by document.

    `chunk_postings(batches)` gives, for each chunk, hashes, documents as places in keys,
    numbers and keys (all arrays; keys are hashes of the documents, and with `of_document` numbers are
    theirs, not the postings'). The same (hash, key, number) counts once. Within a chunk `limit` or more occurrences are taken to be repeated,
    and the hash's count is OFTEN everywhere. `gather(postings)` gets a POSTING array of whole
    documents, ordered by key, and gives a table of `schema`. `total` is about the number of
    postings, for the number of ranges.
    """
    bits = part_bits(total)

    def pack(batches):
        for hashes, docs, numbers, keys in chunk_postings(batches):
            if len(hashes):
                yield _pack(hashes, docs, numbers, keys, limit, bits, of_document)

    def count(table: pa.Table) -> pa.Table:
        return _reduce(table, least, bits, of_document)

    def assemble(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(b, POSTING) for b in table.column("postings").to_pylist()])
        found = found[np.lexsort((found["number"], found["hash"], found["key"]))]
        # A document that is in several chunks brings its frequent hashes from each.
        new = np.ones(len(found), bool)
        new[1:] = found[1:][["key", "hash", "number"]] != found[:-1][["key", "hash", "number"]]
        return gather(found[new])

    counted = source.mapInArrow(pack, _MAPPED).groupBy("part").applyInArrow(count, _REDUCED)
    return counted.groupBy("part").applyInArrow(assemble, schema)
