"""Files: listing them, reading them, reading only the listed ones."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import paths, text as tx
from ..schemas import FILES
from .listing import is_mounted, register

PLUGIN = "directory"
UNDECODABLE = "content is not valid UTF-8"
# A binary cell holds less than 2 GiB.
MAX_CELL = (1 << 31) - 1024
# Bytes a task hands to the JVM at once.
CHUNK = 32 << 20


def glob_for(extensions) -> str | None:
    exts = list(extensions or [])
    return "*{" + ",".join(exts) + "}" if exts else None


def _binary_files(spark: SparkSession, root: str, extensions) -> DataFrame | None:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    glob = glob_for(extensions)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        df = reader.load(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return df.filter(paths.has_suffix(F.col("path"), extensions))


def listing(df: DataFrame) -> DataFrame:
    """binaryFile rows as a listing; the content column is pruned from the scan."""
    return df.select(
        F.col("path"),
        paths.file_uri(F.col("path")).alias("source_url"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("file_modified"),
        F.lit(PLUGIN).alias("source_plugin"),
    )


def pack(files: DataFrame, factor: int = 16) -> DataFrame:
    """A listing in fewer tasks. Splits are cut by content size plus a charge for opening
    each file, but a listing opens none: small files would mean 32 rows a task."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(cores, files.rdd.getNumPartitions() // factor))


def discover_files(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """Recursive listing with a case-sensitive suffix allow-list; a missing folder is empty.

    Spark's file sources leave out empty files and names starting with `.` or `_`;
    sources.listing lists those too.
    """
    df = _binary_files(spark, root, extensions)
    if df is None:
        return spark.createDataFrame([], FILES).filter(F.lit(False))
    return pack(listing(df))


def from_tasks(files: DataFrame) -> DataFrame:
    """Rows of the data source `filelist`, `by` names, as a listing like that of Spark's file sources."""
    as_spark = files.select(
        F.concat(F.lit("file:"), "path").alias("path"),
        F.date_trunc("millisecond", "file_modified").alias("modificationTime"),
        F.col("file_size").alias("length"),
    )
    return listing(as_spark)


def list_files(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """The rows of `discover_files`, for jobs on many files: a mounted folder is listed by the tasks, whenever the rows are
    computed, and the driver holds no paths. Anything else is left to Spark's file source, which lists on the driver once.
    """
    if not is_mounted(spark, root):
        return discover_files(spark, root, extensions)
    register(spark)
    files = spark.read.format("filelist").option("path", root).option("by", "names").load()
    return pack(from_tasks(files.filter(paths.has_suffix(F.col("path"), extensions))))


def decode(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Raw bytes -> fetched columns: text or binary, name as title, type from the suffix."""
    p, raw, binary, valid = F.col(path), F.col(content), F.col("__binary"), F.col("__valid")
    # Checked in a projection of its own, so that each check runs once.
    df = df.withColumns({"__binary": tx.is_binary(raw), "__valid": F.try_validate_utf8(raw)})
    return df.withColumns(
        {
            "title": paths.file_name(p),
            "mime_type": paths.mime_from_path(p),
            "content_text": F.when(~binary, tx.newlines(valid)),
            "content_binary": F.when(binary, raw),
            "content_type": F.when(binary, F.lit("blob")).otherwise(F.lit("string")),
            "fetcher": F.lit("file"),
            "route_status": F.lit("success"),
            "error": _read_error(df, F.when(~binary & valid.isNull(), F.lit(UNDECODABLE))),
        }
    ).drop(content, "read_error", "__binary", "__valid")


def _read_error(df: DataFrame, other: Column) -> Column:
    return F.coalesce(F.col("read_error"), other) if "read_error" in df.columns else other


def read_files(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """All files below a folder, read and decoded."""
    df = _binary_files(spark, root, extensions)
    if df is None:
        df = spark.createDataFrame([], "path string, length long, content binary").filter(F.lit(False))
    rows = df.select(
        "path",
        paths.file_uri(F.col("path")).alias("source_url"),
        F.col("length").alias("file_size"),
        "content",
    )
    return decode(rows)


MAX_TASKS = 50_000


def balance_by_size(files: DataFrame, target_bytes: int = 256 << 20) -> DataFrame:
    """Files spread by hash of the path so that a task reads about `target_bytes`.

    Never fewer tasks than a shuffle has; never more than a scheduler copes with. A
    larger share is no harm: bytes pass through a task in chunks.
    """
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = files.agg(F.sum("file_size")).first()[0] or 0
    tasks = min(max(least, -(-total // target_bytes)), MAX_TASKS)
    return files.repartition(tasks, F.xxhash64("path"))


def open_filesystem(path: str):
    """(file system, path) for a local path or any URL pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return fs.FileSystem.from_uri(path)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends content and read_error, handing rows on before they grow too large."""
    for batch in batches:
        contents, errors, start, held, fs = [], [], 0, 0, None
        for i, path in enumerate(batch.column("path").to_pylist()):
            data, error = None, None
            try:
                fs, local = open_filesystem(path)
                size = fs.get_file_info(local).size
                if size is not None and size > MAX_CELL:
                    error = "file is too large for one row"
                else:
                    with fs.open_input_file(local) as f:
                        data = f.read()
            except (OSError, ValueError, pa.ArrowException) as e:
                # An unknown scheme or a broken path is this row's failure, not the job's.
                code = getattr(e, "errno", None)
                error = f"cannot read file: {os.strerror(code) if code else e}"
            contents.append(data)
            errors.append(error)
            held += len(data or b"")
            if held >= CHUNK or i == batch.num_rows - 1:
                rows = batch.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())],
                    names=[*rows.schema.names, "content", "read_error"],
                )
                contents, errors, start, held = [], [], i + 1, 0


def read_listed(files: DataFrame) -> DataFrame:
    """Reads and decodes exactly the listed files, each in the task that holds its row.

    A file source cannot take its paths from a table; this way the bytes of files that
    an earlier join dropped are never read.
    """
    schema = T.StructType(list(files.schema.fields)).add("content", "binary").add("read_error", "string")
    return decode(files.mapInArrow(_read_batches, schema))
