"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table. The shards take
turns, each claiming the first free slot of its permutation, until the table is full. So
all shards get the same number of slots, give or take one, and if a shard goes, nearly all
slots of the others stay with them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The number of the shard (its place in `shards`) for each slot. `size` is a prime of at
    least the number of shards; shard names are distinct."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size has to be a prime, not below the number of shards")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "little") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "little") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table = np.full(size, -1, np.int32)
    nxt, filled = [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while True:
                slot = (offset[i] + nxt[i] * skip[i]) % size
                nxt[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            filled += 1
            if filled == size:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of its MD5 as text. Null is a key of its own."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\x00null")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)).cast("int")


def shard(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """`df` with `slot` int and `shard` string (columns of these names are replaced).

    Rows of equal keys have the same shard; rows of a null key too. The lookup table has
    `size` entries whatever the input's size, so it may be broadcast; rows are not shuffled.
    """
    table = lookup_table(shards, size)
    entries = [(slot, shards[i]) for slot, i in enumerate(table.tolist())]
    lookup = df.sparkSession.createDataFrame(entries, "slot int, shard string")
    placed = df.drop("shard").withColumn("slot", slot_of(F.col(key), size))
    return placed.join(F.broadcast(lookup), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], size: int = TABLE_SIZE) -> None:
    """A folder of Parquet files for each shard; large shards are cut into several files."""
    shard(df, key, shards, size).drop("slot").write.partitionBy("shard").parquet(path)
