"""The content cache: a table partitioned by owner, with removal and orphan clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import identity
from ..sources.tables import COMPACTED, COMPACTED_BATCH, MAIN, append_batch, is_batch, read_batches
from .joins import light

CACHE = (
    "cache_id string, partition_key string, file_extension string, unique_id string, "
    "is_binary boolean, content_text string, content_binary binary"
)


def cache_rows(content: DataFrame) -> DataFrame:
    """partition_key, file_extension, unique_id and content columns -> cache rows."""
    df = content
    for name, kind in (("content_text", "string"), ("content_binary", "binary")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    df = df.withColumn("is_binary", F.col("content_text").isNull())
    return df.select(
        identity.cache_id_encode(
            F.col("partition_key"), F.col("file_extension"), F.col("unique_id"), F.col("is_binary")
        ).alias("cache_id"),
        "partition_key",
        "file_extension",
        "unique_id",
        "is_binary",
        "content_text",
        "content_binary",
    )


def cache_list(cache: DataFrame, partition_key: str) -> DataFrame:
    return cache.filter(F.col("partition_key") == partition_key).select("cache_id")


def cache_get(cache: DataFrame, ids: DataFrame) -> DataFrame:
    """Content of the listed ids; ids that are not cached give no row.

    The partition is part of the id, so joining on it too prunes the other folders.
    """
    wanted = ids.select("cache_id").distinct()
    wanted = wanted.withColumn(
        "partition_key", identity.cache_id_decode(F.col("cache_id"))["partition_key"]
    )
    return cache.join(light(wanted), ["partition_key", "cache_id"], "left_semi")


def cache_remove(cache: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, ids that were there and are removed)."""
    gone = light(ids.select("cache_id").distinct())
    return (
        cache.join(gone, "cache_id", "left_anti"),
        cache.select("cache_id").join(gone, "cache_id", "left_semi"),
    )


def cache_orphans(cache: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of cache rows that no stored item points to."""
    used = items.select(F.col("location").alias("cache_id")).filter("cache_id is not null").distinct()
    return cache.select("cache_id", "partition_key").join(used, "cache_id", "left_anti")


class CacheTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, content: DataFrame, batch_id: int, writer: str = MAIN) -> DataFrame:
        """Stores the rows and returns the ids they got."""
        append_batch(cache_rows(content), f"{self.root}/rows", batch_id, "partition_key", writer=writer)
        return self._rows().filter(is_batch(batch_id, writer)).select("cache_id", "partition_key")

    def _rows(self) -> DataFrame:
        rows = read_batches(self.spark, f"{self.root}/rows", CACHE)
        return rows if "batch_id" in rows.columns else rows.withColumns({"batch_id": F.lit(0), "writer": F.lit("")})

    def _removed(self, without_seq: int | None = None) -> DataFrame:
        gone = read_batches(self.spark, f"{self.root}/removed", "cache_id string, seq long")
        if without_seq is not None and "batch_id" in gone.columns:
            gone = gone.filter(~is_batch(without_seq))
        return gone.select("cache_id", "seq")

    def read(self, without_removal: int | None = None) -> DataFrame:
        """The cached rows; `without_removal` is the number of a removal that does not count."""
        return self._rows().drop("batch_id", "writer").join(
            self._removed(without_removal).select("cache_id").distinct(), "cache_id", "left_anti"
        )

    def list(self, partition_key: str) -> DataFrame:
        return cache_list(self.read(), partition_key)

    def get(self, ids: DataFrame) -> DataFrame:
        return cache_get(self.read(), ids)

    def remove_all(self, ids: DataFrame, seq: int) -> DataFrame:
        """Returns the ids that were cached and now are not; a retry under the same number, too."""
        _, removed = cache_remove(self.read(without_removal=seq), ids)
        append_batch(removed.withColumn("seq", F.lit(seq).cast("long")), f"{self.root}/removed", seq)
        return self._removed().filter(F.col("seq") == seq).select("cache_id")

    def remove_orphans(self, items: DataFrame, seq: int) -> DataFrame:
        return self.remove_all(cache_orphans(self.read(without_removal=seq), items), seq)

    def partition(self, partition_key: str) -> "PartitionCache":
        return PartitionCache(self, partition_key)

    def compact_to(self, root: str) -> "CacheTable":
        fresh = CacheTable(self.spark, root)
        append_batch(self.read(), f"{fresh.root}/rows", COMPACTED_BATCH, "partition_key", writer=COMPACTED)
        return fresh


class PartitionCache:
    """The cache of one owner, its partition key filled in."""

    def __init__(self, table: CacheTable, partition_key: str):
        self.table, self.partition_key = table, partition_key

    def save(self, content: DataFrame, batch_id: int, writer: str = MAIN) -> DataFrame:
        return self.table.save(content.withColumn("partition_key", F.lit(self.partition_key)), batch_id, writer)

    def list(self) -> DataFrame:
        return self.table.list(self.partition_key)

    def get(self, ids: DataFrame) -> DataFrame:
        return self.table.get(ids)

    def remove_all(self, ids: DataFrame, seq: int) -> DataFrame:
        return self.table.remove_all(ids, seq)
