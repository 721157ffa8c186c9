"""The items table: look-ups, updates, removals, explicit de-duplication.

Plain operators take and return DataFrames. `ItemsTable` keeps appended batches and a
small log of changes next to each other and folds them when read, so an update of a
few rows never rewrites the table; `compact_to` does that when it pays off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import ITEMS, METADATA_FIELDS
from ..sources.tables import COMPACTED, COMPACTED_BATCH, MAIN, append_batch, is_batch, read_batches
from .joins import is_small, join_unique, light, only_matching


def _order():
    """"Earlier" means smaller insert_seq; the id settles ties, so the order is total."""
    return F.struct("insert_seq", "item_id")


def first_item_per_url(items: DataFrame) -> DataFrame:
    return items.groupBy("source_url").agg(F.min_by("item_id", _order()).alias("item_id"))


def find_item_id(probes: DataFrame, items: DataFrame, spread_by) -> DataFrame:
    """Probe rows with the id of the first stored item of their URL, null if none."""
    asked = only_matching(items, probes, "source_url")
    return join_unique(probes, first_item_per_url(asked), "source_url", "left", spread_by)


def find_item(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(light(ids.select("item_id").distinct()), "item_id", "left_semi")


def stored_urls(items: DataFrame) -> DataFrame:
    return items.select("source_url").distinct()


def skip_existing(discovered: DataFrame, items: DataFrame, spread_by=None) -> DataFrame:
    """Discovered rows whose URL is not stored yet.

    A file listing has each URL once; for listings that repeat URLs name the columns
    that tell the copies apart in `spread_by`.
    """
    stored = stored_urls(only_matching(items, discovered, "source_url"))
    if spread_by is None:
        return discovered.join(stored, "source_url", "left_anti")
    return join_unique(discovered, stored, "source_url", "left_anti", spread_by)


def last_per_item(changes: DataFrame, order: str) -> DataFrame:
    """One change per item id: the last one."""
    rest = [c for c in changes.columns if c != "item_id"]
    return (
        changes.groupBy("item_id")
        .agg(F.max_by(F.struct(*rest), order).alias("__c"))
        .select("item_id", "__c.*")
    )


def update_items(items: DataFrame, updates: DataFrame) -> DataFrame:
    """New hash and type for the ids in `updates` (one row per id); others unchanged."""
    u = updates.select(
        "item_id", F.col("content_hash").alias("__h"), F.col("content_type").alias("__t")
    )
    return (
        items.join(light(u), "item_id", "left")
        .withColumns(
            {
                "content_hash": F.coalesce("__h", "content_hash"),
                "content_type": F.coalesce("__t", "content_type"),
            }
        )
        .select(*items.columns)
    )


def update_metadata(items: DataFrame, updates: DataFrame) -> DataFrame:
    """All metadata replaced for the ids in `updates` (one row per id), nulls included."""
    fields = [c for c in METADATA_FIELDS if c in items.columns]
    u = updates.select("item_id", F.struct(*fields).alias("__m"))
    replaced = {
        c: F.when(F.col("__m").isNotNull(), F.col(f"__m.{c}")).otherwise(F.col(c)) for c in fields
    }
    return items.join(light(u), "item_id", "left").withColumns(replaced).select(*items.columns)


def remove_item(items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed rows' ids). `cache_id` is the nominal id, `location` the usable one."""
    gone = light(ids.select("item_id").distinct())
    return (
        items.join(gone, "item_id", "left_anti"),
        _removed(items.join(gone, "item_id", "left_semi")),
    )


def remove_by_url(items: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = urls.select("source_url").distinct()
    how = dict(on="source_url", spread_by="item_id", right_is_small=is_small(gone))
    return (
        join_unique(items, gone, how="left_anti", **how),
        _removed(join_unique(items, gone, how="left_semi", **how)),
    )


def _removed(rows: DataFrame) -> DataFrame:
    location = F.col("location") if "location" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "item_id", F.concat(F.lit("cache_"), "item_id").alias("cache_id"), location.alias("location")
    )


def duplicate_groups(items: DataFrame) -> DataFrame:
    return (
        items.groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min_by("item_id", _order()).alias("first_item_id"))
        .filter("copies > 1")
    )


def dedup_by_hash(items: DataFrame) -> DataFrame:
    """Earliest item of each content hash with the number of copies.

    An aggregate, not a window: copies are folded before the shuffle, so a text that
    makes up a third of the table costs one row per task.
    """
    rest = [c for c in items.columns if c != "content_hash"]
    return (
        items.groupBy("content_hash")
        .agg(F.min_by(F.struct(*rest), _order()).alias("__first"), F.count(F.lit(1)).alias("copies"))
        .select("content_hash", "__first.*", "copies")
    )


def item_ids(rows: DataFrame, order: str = "insert_seq", bucket_rows: int = 1 << 20) -> DataFrame:
    """`item_1 … item_N` in the order of a unique whole-number column, without one global sort.

    Ranges of the order column are counted, the counts summed up to give each range
    its offset, and rows numbered inside their range.
    """
    bucketed = rows.withColumn("__b", F.floor(F.col(order) / bucket_rows))
    counts = bucketed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # One row per range; summed in two steps so that no task sees all of them.
    blocks = counts.withColumn("__s", F.floor(F.col("__b") / 4096))
    block_sums = blocks.groupBy("__s").agg(F.sum("__n").alias("__sn"))
    later = block_sums.selectExpr(
        "__s", "sum(__sn) over (order by __s) - __sn as __block_offset"
    )
    offsets = blocks.join(later, "__s").selectExpr(
        "__b",
        "__block_offset + sum(__n) over (partition by __s order by __b) - __n as __offset",
    )
    return (
        bucketed.join(offsets, "__b")
        .withColumn("__r", F.expr(f"row_number() over (partition by __b order by {order})"))
        .withColumn("item_number", F.col("__offset") + F.col("__r"))
        .withColumn("item_id", F.concat(F.lit("item_"), F.col("item_number").cast("string")))
        .drop("__b", "__offset", "__r")
    )


_CHANGE = "op string, change_seq long, " + ", ".join(
    f"{f.name} {f.dataType.simpleString()}" for f in ITEMS.fields
)

_FAILURES = "source_url string, stage string, message string"
_IS_REMOVAL = "op in ('remove', 'remove-url')"

# What single items are asked for by.
LOOK_UP_BY = ("item_id", "source_url", "content_hash")


class ItemsTable:
    """Appended batches plus a change log under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, items: DataFrame, batch_id: int, writer: str = MAIN) -> None:
        rows = items.select(*ITEMS.fieldNames())
        append_batch(rows, f"{self.root}/rows", batch_id, look_up_by=LOOK_UP_BY, writer=writer)

    def _log(self, changes: DataFrame, op: str, seq: int) -> None:
        cols = [
            (F.col(f.name) if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ITEMS.fields
        ]
        # Each kind of change is a writer of its own, so one number can stand for several kinds.
        append_batch(
            changes.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("change_seq"), *cols),
            f"{self.root}/changes",
            seq,
            writer=op,
        )

    def update_items(self, updates: DataFrame, seq: int) -> None:
        self._log(updates, "content", seq)

    def update_metadata(self, updates: DataFrame, seq: int) -> None:
        self._log(updates, "metadata", seq)

    def remove_item(self, ids: DataFrame, seq: int) -> DataFrame:
        # A retry finds what the first try found: its own entry in the log does not count.
        return self._remove(find_item(self.read(without_removal=("remove", seq)), ids), "remove", seq)

    def remove_by_url(self, urls: DataFrame, seq: int) -> DataFrame:
        gone = urls.select("source_url").distinct()
        rows = self.read(without_removal=("remove-url", seq)).select("item_id", "source_url")
        hit = join_unique(rows, gone, "source_url", "left_semi", "item_id", is_small(gone))
        return self._remove(hit, "remove-url", seq)

    def _remove(self, hit: DataFrame, op: str, seq: int) -> DataFrame:
        # The ids are logged, not the request: items stored later are not affected.
        self._log(hit.select("item_id"), op, seq)
        gone = self.changes().filter(is_batch(seq, op))
        return _removed(self.rows().join(gone.select("item_id"), "item_id", "left_semi"))

    def rows(self, without_batch: tuple[str, int] | None = None) -> DataFrame:
        """All appended rows; `without_batch` is a writer and its batch number."""
        rows = read_batches(self.spark, f"{self.root}/rows", ITEMS)
        if without_batch is not None and "batch_id" in rows.columns:
            # The folder of that batch may be replaced meanwhile.
            rows = rows.filter(~is_batch(without_batch[1], without_batch[0]))
        return rows.select(*ITEMS.fieldNames())

    def batch(self, batch_id: int, writer: str = MAIN) -> DataFrame:
        rows = read_batches(self.spark, f"{self.root}/rows", ITEMS)
        return rows.filter(is_batch(batch_id, writer)).select(*ITEMS.fieldNames())

    def changes(self, without: tuple[str, int] | None = None) -> DataFrame:
        log = read_batches(self.spark, f"{self.root}/changes", _CHANGE)
        if without is not None and "batch_id" in log.columns:
            log = log.filter(~is_batch(without[1], without[0]))
        return log

    def add_failures(self, failures: DataFrame, batch_id: int, writer: str = MAIN) -> None:
        """Rows that a batch could not store: source_url, stage, message."""
        append_batch(failures.select("source_url", "stage", "message"), f"{self.root}/failures", batch_id, writer=writer)

    def failures(self) -> DataFrame:
        found = read_batches(self.spark, f"{self.root}/failures", _FAILURES)
        return found.select("source_url", "stage", "message")

    def read(self, without_batch=None, without_removal=None) -> DataFrame:
        """Rows with the changes applied. Later changes win; a removed id stays removed."""
        log, rows = self.changes(without_removal), self.rows(without_batch)
        if "batch_id" not in log.columns:  # nothing was logged yet
            return rows
        removed = log.filter(_IS_REMOVAL).select("item_id").distinct()
        content = last_per_item(
            log.filter("op = 'content'").select("item_id", "content_hash", "content_type", "change_seq"),
            "change_seq",
        )
        meta = last_per_item(
            log.filter("op = 'metadata'").select("item_id", *METADATA_FIELDS, "change_seq"), "change_seq"
        )
        rows = rows.join(removed, "item_id", "left_anti")
        return update_metadata(update_items(rows, content), meta)

    def item(self, item_id: str) -> DataFrame:
        """The row of one id. The filter reaches the scan, also past the change log."""
        return self.read().filter(F.col("item_id") == item_id)

    def with_hash(self, content_hash: str) -> DataFrame:
        return self.read().filter(F.col("content_hash") == content_hash)

    def urls(self, without_batch: tuple[str, int] | None = None) -> DataFrame:
        """Distinct URLs of the current rows, without folding what does not bear on them."""
        log = self.changes()
        rows = self.rows(without_batch).select("item_id", "source_url")
        if "batch_id" not in log.columns:
            return stored_urls(rows)
        removed = log.filter(_IS_REMOVAL).select("item_id").distinct()
        moved = last_per_item(
            log.filter("op = 'metadata'").select("item_id", "source_url", "change_seq"), "change_seq"
        )
        return stored_urls(update_metadata(rows.join(removed, "item_id", "left_anti"), moved))

    def compact_to(self, root: str) -> "ItemsTable":
        """The folded rows as a new table; switch over to it once this returns."""
        fresh = ItemsTable(self.spark, root)
        fresh.append(self.read(), COMPACTED_BATCH, COMPACTED)
        fresh.add_failures(self.failures(), COMPACTED_BATCH, COMPACTED)
        return fresh
