"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of a fixed size. Equal blocks get the same
integer name and different blocks different ones, because names are ranks in the sort
order of the blocks themselves. Then the names of neighbouring blocks are paired, and the
pairs are named in the same way, until one name is left for each document. Two texts have
the same (level, name) exactly if they are equal: no hash decides, so none can collide.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import cut, heavy_values, partitions, rows_of, with_digest

BLOCK_BYTES = 4096
# Ranks stay below 2^40 within one bucket; the bucket stands above them.
RANK_BITS = 40
_BLOCKS = "rid long, doc_id long, n_chars long, sha string, n_blocks int, pos int, h long, block binary"


def _block_rows(batches, size, with_text):
    import xxhash

    for batch in batches:
        out = [[] for _ in range(8)]
        for rid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = text or ""
            # bytes.split() parts at blank and \x09-\x0D, and at nothing else
            norm = b"".join(text.encode().split())
            n = max(1, -(-len(norm) // size))
            for pos in range(n):
                block = norm[pos * size : (pos + 1) * size]
                h = xxhash.xxh3_64_intdigest(block) - (1 << 63)
                first = pos == 0
                row = (
                    rid,
                    doc_id if first else None,
                    len(text) if first else None,
                    hashlib.sha256(norm).hexdigest() if first and with_text else None,
                    n,
                    pos,
                    h,
                    block if with_text else None,
                )
                for column, value in zip(out, row):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def _blocks(docs: DataFrame, size: int, with_text: bool) -> DataFrame:
    """One row per block; what belongs to the document stands in its first block's row."""

    def task(batches):
        return _block_rows(batches, size, with_text)

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(task, _BLOCKS)


def _heavy_names(hashes: DataFrame, df: DataFrame, key: list[str]) -> DataFrame | None:
    """Names of the values that many rows share; they are few, and found by counting `h`.

    Their rows need no sorting together, so that no task gets all rows of one value.
    """
    heavy = heavy_values(hashes.select("h"), "h")
    if not heavy:
        return None
    # Partial aggregation leaves each task at most one row per heavy value.
    distinct = df.filter(F.col("h").isin(heavy)).select("h", *key).distinct()
    rank = F.row_number().over(Window.orderBy("h", *key)).cast("long")
    return cut(distinct.select("h", *key, (-rank).alias("known")), "heavy-names")


def _named(df: DataFrame, known: DataFrame | None, key: list[str], keep: list[str]) -> DataFrame:
    """`keep` and `name`: equal names for equal `key`, by rank in sort order within buckets."""
    buckets = 16 * partitions(df.sparkSession)
    if known is None:
        df = df.withColumn("known", F.lit(None).cast("long"))
    else:
        df = df.join(F.broadcast(known), ["h", *key], "left")
    rest = F.col("known").isNull()
    bucket = F.pmod(F.when(rest, F.col("h")).otherwise(F.xxhash64("rid", "pos")), F.lit(buckets))
    df = df.select(
        *keep, "known", bucket.alias("bucket"), *[F.when(rest, F.col(k)).alias(k) for k in key]
    )
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*key)).cast("long")
    name = F.coalesce("known", F.shiftleft("bucket", RANK_BITS) + rank)
    return df.select(*keep, name.alias("name"))


_META = ["rid", "doc_id", "n_chars", "sha", "n_blocks", "pos"]


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid, doc_id, n_chars, sha, level, name: equal (level, name) for equal normalised texts."""
    blocks = _blocks(docs, block_bytes, True)
    known = _heavy_names(_blocks(docs, block_bytes, False), blocks, ["block"])
    level, done = 0, []
    cur = cut(_named(blocks, known, ["block"], _META), "names-0")
    most = cur.agg(F.max("n_blocks")).first()[0] or 1
    while True:
        done.append(
            cur.filter("n_blocks = 1").select("rid", "doc_id", "n_chars", "sha", F.lit(level).alias("level"), "name")
        )
        if most == 1:
            return reduce(DataFrame.unionByName, done)
        level, most = level + 1, -(-most // 2)
        left = F.col("pos") % 2 == 0
        pairs = (
            cur.filter("n_blocks > 1")
            .groupBy("rid", F.shiftright("pos", 1).alias("half"))
            .agg(
                F.max(F.when(left, F.col("name"))).alias("a"),
                F.max(F.when(~left, F.col("name"))).alias("b"),
                *[F.max(c).alias(c) for c in ("doc_id", "n_chars", "sha")],
                F.ceil(F.max("n_blocks") / 2).cast("int").alias("n_blocks"),
            )
            .withColumnRenamed("half", "pos")
            # An odd last block is paired with 0, which is no name.
            .withColumn("b", F.coalesce("b", F.lit(0)))
            .withColumn("h", F.xxhash64("a", "b"))
        )
        known = _heavy_names(pairs, pairs, ["a", "b"])
        cur = cut(_named(pairs, known, ["a", "b"], _META), f"names-{level}")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string; other columns are not looked at).

    doc_id, keep_id, group_size, kept, text_sha256. Texts are equal if they are the same
    after deleting blank and \\x09-\\x0D. Of equal texts the row with the most code points
    stays, then the smallest doc_id (null comes last), then, for a doc_id that occurs more than
    once, the first such row: exactly one row of a group is kept. Null text counts as empty,
    and all empty texts are equal. An empty table gives an empty result.
    """
    names = document_names(docs, block_bytes)
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("u"), "doc_id", "rid")
    best = cut(
        names.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")),
        "groups",
    )
    # Both sides are shuffled here, so that adaptive execution can split a large group.
    return names.join(best, ["level", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _digests(texts):
    return [hashlib.sha256(b"".join((t or "").encode().split())).hexdigest() for t in texts]


def without_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, that exact_dedup keeps."""
    kept = exact_dedup(docs.select("doc_id", "text"), block_bytes).filter("kept")
    winners = cut(kept.select("doc_id", F.col("text_sha256").alias("digest")), "kept")
    return rows_of(with_digest(docs, _digests, T.StringType()), winners)
