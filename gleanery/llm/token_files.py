"""Token ids in files of directly addressable codes.

An id is cut into chunks of bits, the lowest first. Level 0 of a file holds the lowest chunk of every
token, level 1 the next chunk of those tokens that have one, and so on. A bitmap beside each level but the last says
which of its tokens go on, and a rank directory, how many do before every 256th of them. So token i is
found by one chunk and one rank per level, and tokens a to b are one stretch of every level: no
block is ever decoded. The widths of the chunks are those with the fewest bits for the file's ids.

A file is, in little-endian numbers: MAGIC; the documents, the tokens, whether ids of documents can be
null, and the levels (4 longs); width and tokens of each level (2 longs each); the documents' ids and, if
they can be null, a byte each that says so; where each document ends, counted in tokens of the
file; then for every level its chunks, its bitmap and its directory, each padded to 8 bytes.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_dir
from .common import cut, partitions, worker_cache
from .packing import ids_of

MAGIC = b"DACIDS01"
END_ID = 0
# A file is closed when it has so many tokens; documents are not cut, so a longer one has a longer file.
FILE_TOKENS = 1 << 23
# Tokens that are coded or read at a time.
STRETCH = 1 << 19
RANK_BITS = 256
_MANIFEST = "path string, part int, seq int, n_docs long, n_tokens long"


def file_system(uri: str):
    """The Arrow file system of a Spark path, and the path in it."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def widths_for(ids: np.ndarray) -> list[int]:
    """Widths of the chunks, lowest first, whose levels and bitmaps take the fewest bits."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    above = [int(np.count_nonzero(ids >> np.uint32(k))) for k in range(top)]
    above[0] = len(ids)
    # best[k]: bits for everything from bit k upwards, and the width of the chunk that begins there.
    best = {top: (0, 0)}
    for k in reversed(range(top)):
        # Level 1 and up hold the tokens that reach bit k. The last level has no bitmap. At most 24 bits are read at once.
        best[k] = min((above[k] * (w + (k + w < top)) + best[k + w][0], w) for w in range(1, min(24, top - k) + 1))
    widths, k = [], 0
    while k < top:
        widths.append(best[k][1])
        k += widths[-1]
    return widths


def _pack(values: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bits one after another, padded to 8 bytes and by 8 more, so that reads need no bounds."""
    out = []
    # A multiple of 8 numbers ends on a byte.
    for at in range(0, len(values), STRETCH):
        bits = (values[at : at + STRETCH, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    raw = b"".join(out)
    return raw + bytes(-len(raw) % 8 + 8)


def _level_bytes(n: int, width: int, last: bool) -> tuple[int, int, int]:
    """Bytes of a level's chunks, bitmap and directory."""

    def padded(bits):
        return -(-bits // 64) * 8 + 8

    return padded(n * width), 0 if last else padded(n), 0 if last else (n // RANK_BITS + 1) * 8


def encode_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file: documents that end at `ends` among `ids` (unsigned 32-bit numbers)."""
    widths = widths_for(ids)
    missing = [d is None for d in doc_ids]
    sections, levels = [], []
    rest = ids
    for i, width in enumerate(widths):
        levels += [width, len(rest)]
        sections.append(_pack(rest & np.uint32((1 << width) - 1), width))
        if i + 1 < len(widths):
            # What is left of those tokens that go on.
            more = rest >> np.uint32(width)
            goes_on = more > 0
            marks = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.int64) if len(rest) else []
            directory = np.concatenate(([0], np.cumsum(marks)))[: len(rest) // RANK_BITS + 1]
            sections += [_pack(goes_on.astype(np.uint32), 1), directory.astype("<i8").tobytes()]
            rest = more[goes_on]
    head = np.array([len(doc_ids), len(ids), any(missing), len(widths), *levels], "<i8").tobytes()
    numbers = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    if any(missing):
        numbers += bytes(missing)
    return b"".join((MAGIC, head, numbers, np.asarray(ends, "<i8").tobytes(), *sections))


class TokenFile:
    """Random access to a file of ids. `read(at, size)` gives bytes; only what an answer needs is read."""

    def __init__(self, read):
        self._read = read
        if read(0, 8) != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_docs, self.n_tokens, self._nulls, n_levels = self._longs(8, 4)
        levels = self._longs(40, 2 * n_levels)
        self._docs_at = 40 + 16 * n_levels
        self._ends_at = self._docs_at + 8 * self.n_docs + (self.n_docs if self._nulls else 0)
        at = self._ends_at + 8 * self.n_docs
        self.levels = []
        for i in range(n_levels):
            width, n = levels[2 * i : 2 * i + 2]
            sizes = _level_bytes(n, width, i + 1 == n_levels)
            self.levels.append((width, at, at + sizes[0], at + sizes[0] + sizes[1]))
            at += sum(sizes)
        self.size = at

    @classmethod
    def open(cls, uri: str) -> "TokenFile":
        system, path = file_system(uri)
        handle = system.open_input_file(path)
        return cls(lambda at, size: handle.read_at(size, at))

    def _longs(self, at: int, n: int) -> list[int]:
        return np.frombuffer(self._read(at, 8 * n), "<i8").tolist()

    def _bits(self, at: int, a: int, b: int) -> np.ndarray:
        raw = np.frombuffer(self._read(at + a // 8, (b + 7) // 8 - a // 8), np.uint8)
        return np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + b - a]

    def _chunks(self, at: int, width: int, a: int, b: int) -> np.ndarray:
        first = a * width
        raw = np.frombuffer(self._read(at + first // 8, (b * width + 7) // 8 - first // 8 + 4), np.uint8).astype(np.uint32)
        place = np.arange(first, b * width, width) - first // 8 * 8
        byte = place >> 3
        value = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16 | raw[byte + 3] << 24
        return (value >> (place & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)

    def get(self, a: int, b: int) -> np.ndarray:
        """Ids of the tokens a to b (b not included), as unsigned 32-bit numbers."""
        if not 0 <= a <= b <= self.n_tokens:
            raise IndexError(f"tokens {a} to {b} of {self.n_tokens}")
        out = np.zeros(b - a, np.uint32)
        places, shift = np.arange(b - a), 0
        for width, chunks, bitmap, directory in self.levels:
            if a == b:
                break
            out[places] |= self._chunks(chunks, width, a, b) << np.uint32(shift)
            shift += width
            if directory == bitmap:
                break  # the last level
            goes_on = self._bits(bitmap, a, b).astype(bool)
            before = self._longs(directory + 8 * (a // RANK_BITS), 1)[0]
            a = before + int(np.count_nonzero(self._bits(bitmap, a // RANK_BITS * RANK_BITS, a)))
            places = places[goes_on]
            b = a + len(places)
        return out

    def token(self, i: int) -> int:
        return int(self.get(i, i + 1)[0])

    def ends(self) -> np.ndarray:
        """Where each document ends, in tokens of the file."""
        return np.array(self._longs(self._ends_at, self.n_docs), np.int64)

    def doc_ids(self) -> list[int | None]:
        ids = self._longs(self._docs_at, self.n_docs)
        if self._nulls:
            missing = self._read(self._docs_at + 8 * self.n_docs, self.n_docs)
            ids = [None if m else i for i, m in zip(ids, missing)]
        return ids

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        first, last = ([0] + self._longs(self._ends_at, 1)) if i == 0 else self._longs(self._ends_at + 8 * (i - 1), 2)
        return self.get(first, last)

    def crcs(self) -> list[int]:
        """CRC-32 of each document's ids, read a stretch at a time."""
        found, doc, crc, ends = [], 0, 0, self.ends().tolist()
        for at in range(0, self.n_tokens, STRETCH):
            stop = min(at + STRETCH, self.n_tokens)
            raw = memoryview(self.get(at, stop).astype("<u4").tobytes())
            begin = at
            while doc < self.n_docs and ends[doc] <= stop:
                found.append(zlib.crc32(raw[4 * (begin - at) : 4 * (ends[doc] - at)], crc))
                begin, crc, doc = ends[doc], 0, doc + 1
            crc = zlib.crc32(raw[4 * (begin - at) :], crc)
        return found + [0] * (self.n_docs - len(found))


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = END_ID,
    encode_special_tokens: bool = False,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Writes the ids of `docs` (doc_id, text) below `folder`, which all executors reach, and returns the manifest:
    path, part, seq, n_docs, n_tokens and before, the tokens in all files before it.

    Documents stand in ascending order of doc_id (null last; rows with the same id by a hash of the text), each
    followed by `end_id` (null and empty texts are `end_id` alone). A file that a lost or repeated
    task left behind is in no manifest. Texts are shuffled once, by ranges, so rows of one
    id may lie in several ranges. An empty table has no files.
    """
    end = end_id.to_bytes(4, "little")
    folder = folder.rstrip("/")

    def task(batches):
        cache = worker_cache()
        slot = ("ids", tokenizer_path, encode_special_tokens)
        if slot not in cache:
            cache[slot] = ids_of(tokenizer_path, encode_special_tokens)
        encode = cache[slot]
        part = TaskContext.get().partitionId()
        seq, held, doc_ids, raw = 0, 0, [], []

        def close():
            nonlocal seq, held, doc_ids, raw
            ends = np.cumsum([len(r) // 4 for r in raw])
            path = f"{folder}/part-{part:05}-{seq:05}-{uuid.uuid4().hex[:12]}.ids"
            system, inner = file_system(path)
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inner) as out:
                out.write(encode_file(doc_ids, ends, np.frombuffer(b"".join(raw), "<u4")))
            row = [[path], [part], [seq], [len(doc_ids)], [held]]
            seq, held, doc_ids, raw = seq + 1, 0, [], []
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = [c.split()[0] for c in _MANIFEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = (encode(text) if text else b"") + end
                doc_ids.append(doc_id)
                raw.append(ids)
                held += len(ids) // 4
                if held >= file_tokens:
                    yield close()
        if doc_ids:
            yield close()

    order = [F.asc_nulls_last("doc_id"), F.asc("__hash"), F.asc("__row")]
    sorted_docs = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
        .withColumn("__hash", F.xxhash64("text"))
        .withColumn("__row", F.monotonically_increasing_id())
        .repartitionByRange(partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
    )
    files = cut(sorted_docs.select("doc_id", "text").mapInArrow(task, _MANIFEST), "manifest")
    return with_starts(files)


def with_starts(files: DataFrame) -> DataFrame:
    """A manifest with the tokens before each file. One number per part is summed on the driver (as many as there
    were shuffle partitions); files are numbered within their part."""
    spark = files.sparkSession
    before, rows = 0, []
    for part, n in sorted(map(tuple, files.groupBy("part").agg(F.sum("n_tokens")).collect())):
        rows.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(rows, "part int, part_before long"))
    earlier = "coalesce(sum(n_tokens) over (partition by part order by seq rows between unbounded preceding and 1 preceding), 0)"
    return files.join(starts, "part").selectExpr(*(c.split()[0] for c in _MANIFEST.split(", ")), f"part_before + {earlier} as before")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def task(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile.open(path)
                ends = file.ends()
                lengths = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids(), pa.int64()), pa.array(before + ends - lengths), pa.array(lengths), pa.array(file.crcs(), pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.select("path", "before").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """place, id: the tokens at the places in the column `place` of `wanted` (counted over all files, repeats kept;
    null and places that do not exist give null). Each place is read on its own, in the task that has its file's places.

    Files are found by the stretches of places that they cover, so the join is on equal numbers.
    """
    width = F.lit(FILE_TOKENS)
    first, last = F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("n_tokens") - 1) / width)
    covers = manifest.select("path", "before", "n_tokens", F.explode(F.sequence(first, last)).alias("stretch"))
    asked = wanted.select(F.col("place").cast("long").alias("place"), F.floor(F.col("place") / width).alias("stretch"))
    inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n_tokens"))
    found = asked.join(covers, "stretch").filter(inside).select("path", (F.col("place") - F.col("before")).alias("at"), "place")
    # A file that many ask is asked by several tasks.
    salt = F.pmod(F.xxhash64("place"), F.lit(8))

    def task(batches):
        path = file = None
        for batch in batches:
            out = []
            for p, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != path:
                    path, file = p, TokenFile.open(p)
                out.append(file.token(at))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.int64())], ["place", "id"])

    by_file = found.distinct().repartition(partitions(manifest.sparkSession), "path", salt).sortWithinPartitions("path", "at")
    ids = by_file.mapInArrow(task, "place long, id long")
    return wanted.select(F.col("place").cast("long").alias("place")).join(ids, "place", "left")


def token_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the files of `docs` in the shared folder and reads every document back."""
    return read_token_files(write_token_files(docs, work_dir(spark, "ids"), tokenizer_path, **options))
