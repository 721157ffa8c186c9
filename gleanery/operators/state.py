"""Versioned key/value state: an append-only log and its latest-value view.

The last arrival wins, whatever its version says. A stored JSON null is a value; only
a key that was never stored is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import STATE_LOG
from ..sources.tables import COMPACTED, COMPACTED_BATCH, MAIN, append_batch, read_batches
from .joins import join_unique

KEYS = ["partition_key", "key"]


def state_latest(log: DataFrame, order: str | Column = "seq") -> DataFrame:
    """One row per key. Folded before the shuffle, so hot keys cost one row per task."""
    return (
        log.groupBy(*KEYS)
        .agg(F.max_by(F.struct("value_json", "version"), order).alias("__v"))
        .select(*KEYS, "__v.value_json", "__v.version")
    )


def state_get(latest: DataFrame, requests: DataFrame, spread_by) -> DataFrame:
    """Requests (partition_key, key, default_json) with the stored value or the default."""
    found = latest.select(*KEYS, F.lit(True).alias("found"), F.col("value_json").alias("__v"))
    return (
        join_unique(requests, found, KEYS, "left", spread_by)
        .withColumn("value_json", F.when(F.col("found"), F.col("__v")).otherwise(F.col("default_json")))
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .drop("__v", "default_json")
    )


def state_older_than(latest: DataFrame, partition_key: str, version: int) -> DataFrame:
    return (
        latest.filter((F.col("partition_key") == partition_key) & (F.col("version") < version))
        .select("key", "value_json", "version")
        .orderBy("version", "key")
    )


def state_keys_with_value(latest: DataFrame, partition_key: str, value_json: str) -> DataFrame:
    """Keys whose stored JSON text is exactly this one."""
    return latest.filter(
        (F.col("partition_key") == partition_key) & (F.col("value_json") == value_json)
    ).select("key")


def state_exists(latest: DataFrame) -> DataFrame:
    return latest.select(*KEYS, (F.col("value_json") != "null").alias("exists"))


def state_delete(requests: DataFrame) -> DataFrame:
    """Log entries that delete the requested keys: a stored null."""
    return requests.select(
        *KEYS, F.lit("null").alias("value_json"), F.lit(1).alias("version"), "seq"
    )


class StateTable:
    """The log as a table, one folder per writer, batch and partition key.

    Entries are ordered by batch number, then seq, then writer: writers that store the same keys
    count their batches in common. What a compaction leaves comes before all batches.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def store(self, entries: DataFrame, batch_id: int, writer: str = MAIN) -> None:
        if "version" not in entries.columns:
            entries = entries.withColumn("version", F.lit(1))
        append_batch(entries.select(*STATE_LOG.fieldNames()), self.root, batch_id, "partition_key", writer=writer)

    def log(self, partition_key: str | None = None) -> DataFrame:
        log = read_batches(self.spark, self.root, STATE_LOG)
        if "batch_id" not in log.columns:
            log = log.withColumns({"batch_id": F.lit(0), "writer": F.lit("")})
        return log if partition_key is None else log.filter(F.col("partition_key") == partition_key)

    def latest(self, partition_key: str | None = None, before: int | None = None) -> DataFrame:
        """The view; naming the partition reads only that partition's folders, and `before`
        leaves that batch and later ones out."""
        log = self.log(partition_key)
        if before is not None:
            log = log.filter(F.col("batch_id") < int(before))
        return state_latest(log, F.struct("batch_id", "seq", "writer"))

    def partition(self, partition_key: str) -> "PartitionState":
        return PartitionState(self, partition_key)

    def compact_to(self, root: str) -> "StateTable":
        fresh = StateTable(self.spark, root)
        fresh.store(self.latest().withColumn("seq", F.lit(0)), COMPACTED_BATCH, COMPACTED)
        return fresh


class PartitionState:
    """The state of one owner, its partition key filled in."""

    def __init__(self, table: StateTable, partition_key: str):
        self.table, self.partition_key = table, partition_key

    def store(self, entries: DataFrame, batch_id: int, writer: str = MAIN) -> None:
        self.table.store(entries.withColumn("partition_key", F.lit(self.partition_key)), batch_id, writer)

    def latest(self) -> DataFrame:
        return self.table.latest(self.partition_key)

    def older_than(self, version: int) -> DataFrame:
        return state_older_than(self.latest(), self.partition_key, version)

    def keys_with_value(self, value_json: str) -> DataFrame:
        return state_keys_with_value(self.latest(), self.partition_key, value_json)
