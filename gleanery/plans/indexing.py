"""List, skip what is stored, read the rest, route, extract, store."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.extract import extract, extract_nested, to_items
from ..operators.items import ItemsTable, skip_existing
from ..operators.routing import route_fetch
from ..session import work_dir
from ..sources.files import balance_by_size, list_files, read_listed
from ..sources.tables import MAIN
from ..sources.union import union_sources
from .registry import Registry


NO_READER = "No reader registered for fetcher: "
# Fetchers that read files if they have no reader of their own.
_READ_FILES = ("file", "store")


def fetch(listed: DataFrame, registry: Registry, with_errors: bool = True) -> DataFrame:
    """Reads each listed row with the fetcher it is routed to. Rows that no fetcher takes, or whose fetcher
    has no reader, come out as error rows, unless not asked for."""
    routed = route_fetch(listed, registry.fetchers)
    readers = {f.name: f.read or _default_read for f in registry.fetchers if f.read or f.name in _READ_FILES}
    parts = [read(routed.filter(F.col("fetcher") == name)) for name, read in readers.items()]
    if with_errors or not parts:
        unread = routed.filter(F.col("fetcher").isNull() | ~F.col("fetcher").isin(*readers))
        why = F.when(F.col("fetcher").isNull(), F.col("message")).otherwise(F.concat(F.lit(NO_READER), F.col("fetcher")))
        parts.append(unread.withColumn("error", why))
    fetched = parts[0]
    for p in parts[1:]:
        fetched = fetched.unionByName(p, allowMissingColumns=True)
    return fetched


def _default_read(listed: DataFrame) -> DataFrame:
    if "path" not in listed.columns:
        listed = listed.withColumn("path", F.col("source_url"))
    if "file_size" in listed.columns:
        listed = balance_by_size(listed)
    return read_listed(listed)


def extract_rows(fetched: DataFrame, registry: Registry) -> DataFrame:
    # Failed to fetch, or to extract: the column `error` alone does not tell afterwards.
    rows = fetched.drop("route_status", "message", "fetcher").withColumn("fetch_failed", F.col("error").isNotNull())
    if any(e.members is not None for e in registry.extractors):
        return extract_nested(rows, registry.extractors)
    return extract(rows, registry.extractors)


def index_listing(
    listed: DataFrame, items: ItemsTable, batch_id: int, registry: Registry | None = None, writer: str = MAIN, failed=None
):
    """One batch. Running it again with the same number and writer replaces what it stored.

    Every listed row that is not stored yet ends up in the items or in `items.failures()`, with
    the stage it failed in. `failed` has further failures (source_url, stage, message) to go there.
    """
    registry = registry or Registry()
    # Listings hold no content, and are used more than once: counted, joined, sized, read.
    listed = listed.persist()
    # What an earlier try of this batch stored does not count as stored.
    fresh = skip_existing(listed, items.urls(without_batch=(writer, batch_id))).persist()
    try:
        extracted = extract_rows(fetch(fresh, registry), registry)
        ok = (F.col("route_status") == "success") & F.col("error").isNull()
        stage = F.when(ok, F.lit(None)).when(F.col("fetch_failed"), F.lit("fetch")).otherwise(F.lit("extract"))
        judged = extracted.withColumn("insert_seq", F.lit(batch_id))
        # Hashes and metadata only, no content: read and extracted once, then parted.
        work = f"{work_dir(listed.sparkSession, 'staged')}"
        staged = to_items(judged, stage.alias("stage"), F.coalesce("error", "message").alias("failure"))
        staged.write.parquet(work)
        staged = listed.sparkSession.read.schema(staged.schema).parquet(work)
        items.append(staged.filter("stage is null"), batch_id, writer)
        failures = staged.filter("stage is not null").select("source_url", "stage", F.col("failure").alias("message"))
        items.add_failures(failures if failed is None else failures.unionByName(failed), batch_id, writer)
    finally:
        fresh.unpersist()
        listed.unpersist()
    # From what was just written: the files are not read a second time.
    write_stores(items.batch(batch_id, writer), batch_id, registry.stores)


def write_stores(rows: DataFrame, batch_id: int, stores: dict) -> None:
    """The rows in all stores. Those that can commit do so when all have written, or abort if one failed."""
    written = []
    try:
        for store in stores.values():
            if hasattr(store, "commit"):
                written.append((store, store.write(rows, batch_id)))
            else:
                store(rows, batch_id)
    except BaseException:
        for store, token in written:
            store.abort(token)
        raise
    for store, token in written:
        store.commit(token)


def index_folder(
    spark: SparkSession, root: str, items: ItemsTable, batch_id: int, extensions=None, registry=None, writer: str = MAIN
):
    index_listing(list_files(spark, root, extensions), items, batch_id, registry, writer)


def index_sources(spark: SparkSession, items: ItemsTable, batch_id: int, registry: Registry, writer: str = MAIN):
    """All registered sources in one batch; URLs listed twice are read once. A source that fails, while it
    is opened or while it is read, is recorded as a failure and does not stop the others."""
    good, failed = {}, []
    for name, listing in registry.sources.items():
        path = work_dir(spark, "source")
        try:
            listing(spark).write.parquet(path)
            # The reader is bound now: each source has a folder of its own.
            good[name] = lambda s, path=path: s.read.parquet(path)
        except Exception as e:  # noqa: BLE001  whatever a source raises is that source's failure
            condition = e.getCondition() if isinstance(e, PySparkException) else None
            failed.append((name, "source", condition or f"{type(e).__name__}: {e}"))
    failures = spark.createDataFrame(failed, "source_url string, stage string, message string") if failed else None
    if not good:
        listed = spark.createDataFrame([], "source_url string")
    else:
        listed = union_sources(spark, good).filter("error is null").drop("error")
        rest = [c for c in listed.columns if c != "source_url"]
        once = listed.groupBy("source_url").agg(F.min(F.struct(*rest)).alias("__r"))
        listed = once.select("source_url", "__r.*")
    index_listing(listed, items, batch_id, registry, writer, failures)
