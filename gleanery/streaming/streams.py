"""Structured Streaming jobs.

Every sink commits a batch as a whole and replaces it when it is retried, so
results are stored once whatever fails. All state is either the stream's own list of
seen files or a table; nothing grows in executor memory unless said so.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.items import ItemsTable
from ..operators.state import KEYS, StateTable
from ..plans.indexing import index_listing
from ..plans.registry import Registry
from ..schemas import BINARY_FILE
from ..functions import paths
from ..sources import listing
from ..sources.files import from_tasks, glob_for, listing as as_listing, pack
from ..sources.tables import append_batch


def discover_stream(
    spark: SparkSession, root: str, extensions=None, max_files_per_batch: int | None = None
) -> DataFrame:
    """Listing of files not seen before. A changed file with a known path is not repeated.

    A mounted folder is listed by the tasks and the paths seen are kept in the state store, spread over the executors. For
    other file systems, patterns and batches of a number of files Spark's own file stream is used: it lists on the driver,
    remembers every path there and looks up each file of a batch once more, which took 2 to 3 ms a file.
    """
    if not max_files_per_batch and listing.is_mounted(spark, root):
        listing.register(spark)
        files = spark.readStream.format("filelist").option("path", root).option("by", "names").option("every", 1).load()
        return from_tasks(files.filter(paths.has_suffix(F.col("path"), extensions)).dropDuplicates(["path"]))
    reader = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    )
    if glob_for(extensions):
        reader = reader.option("pathGlobFilter", glob_for(extensions))
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return as_listing(reader.load(root).filter(paths.has_suffix(F.col("path"), extensions)))


def listing_stream(
    spark: SparkSession, root: str, extensions=None, once: bool = True, settle: float = 5, every: float = 10
) -> DataFrame:
    """Listing of files as they arrive, hidden and empty ones included. The tasks list, and the stream keeps one point in
    time instead of a list of files. The folder has to be mounted on the executors.

    A changed file with a known path is not repeated: each path is kept in the state store, by hash and spread over the
    executors. `once` False leaves that to what comes after, such as `index_stream`, which asks the items table;
    a changed file is then listed again. `settle` and `every` are those of the data source.
    """
    listing.register(spark)
    reader = spark.readStream.format("filelist").option("path", root).option("settle", settle).option("every", every)
    files = reader.load().filter(paths.has_suffix(F.col("path"), extensions))
    return files.dropDuplicates(["path"]) if once else files


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting for what is started meanwhile: a stream takes the session's settings when it starts."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run(
    stream: DataFrame,
    each_batch,
    checkpoint: str,
    available_now: bool = True,
    output_mode: str = "append",
    name: str | None = None,
) -> StreamingQuery:
    writer = (
        stream.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .outputMode(output_mode)
    )
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def writer_of(checkpoint: str) -> str:
    """A stream's name as a writer. Its batches count from 0 in each checkpoint folder, so that
    folder is what tells streams apart."""
    return "stream-" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def append_stream(stream: DataFrame, root: str, checkpoint: str, **kw) -> StreamingQuery:
    writer = writer_of(checkpoint)
    return run(stream, lambda df, batch: append_batch(df, root, batch, writer=writer), checkpoint, **kw)


def index_stream(
    listed: DataFrame, items: ItemsTable, checkpoint: str, registry: Registry | None = None, **kw
) -> StreamingQuery:
    """List, skip, read, extract and store as one continuous query.

    A restart goes on after the last finished batch; a batch that was cut off is done
    again under its number. URLs that are stored already are skipped by a join with the
    items table, so the stream itself keeps no record of them.
    """
    writer = writer_of(checkpoint)
    return run(
        listed, lambda df, batch: index_listing(pack(df), items, batch, registry, writer), checkpoint, **kw
    )


def dedup_stream(rows: DataFrame) -> DataFrame:
    """First row of each URL across batches. The state store holds every URL seen; for
    unbounded URL sets skip against the table instead, as `index_stream` does."""
    return rows.dropDuplicates(["source_url"])


def state_stream(log: DataFrame, table: StateTable, checkpoint: str, **kw) -> StreamingQuery:
    """Arriving log entries stored batch by batch; `table.latest()` is the current state."""
    writer = writer_of(checkpoint)
    return run(log, lambda df, batch: table.store(df, batch, writer), checkpoint, **kw)


def latest_stream(log: DataFrame) -> DataFrame:
    """Latest value per key as a streaming aggregate (output mode update or complete).
    The state store holds one row per key."""
    return (
        log.groupBy(*KEYS)
        .agg(F.max_by(F.struct("value_json", "version"), "seq").alias("__v"))
        .select(*KEYS, "__v.value_json", "__v.version")
    )
