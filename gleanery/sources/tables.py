"""Batch-keyed Parquet tables: every batch of every writer is what its last committed attempt wrote.
Writing a batch again replaces it in one step, so a retried append is harmless and one that is cut off is not seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .commits import abort, commit, committed, new_attempt

# Who writes when nobody says so, and who writes what a compaction leaves.
MAIN, COMPACTED = "main", "compacted"
COMPACTED_BATCH = -1


def append_batch(
    df: DataFrame, root: str, batch_id: int, partition_by: str | None = None, look_up_by=(), writer: str = MAIN
) -> None:
    """`look_up_by` columns get bloom filters, so that reads for one value skip row groups.

    Batch numbers belong to their writer: two writers, such as a job and a stream, never replace each
    other's batches.
    """
    out = df.write
    if partition_by:
        # AQE cuts large partition values into several writers and packs small ones,
        # so neither one hot value nor thousands of tiny files result.
        out = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    if look_up_by:
        out = out.option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in look_up_by:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    spark, attempt = df.sparkSession, new_attempt(root, batch_id, writer)
    try:
        out.parquet(attempt.path)
    except BaseException:
        abort(spark, attempt)
        raise
    commit(spark, attempt)


def is_batch(batch_id: int, writer: str = MAIN) -> Column:
    """Rows of one batch. A partition filter, so other folders are not read, nor is this one's if negated."""
    return (F.col("writer") == f"w-{writer}") & (F.col("batch_id") == int(batch_id))


def read_batches(spark: SparkSession, root: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All committed batches, with the columns writer and batch_id; an empty table of `schema`, without these two, if there
    is none yet. Which attempts count is settled now, not when the rows are read."""
    attempts = committed(spark, root)
    if not attempts:
        if schema is None:
            raise ValueError(f"nothing was written to {root} yet")
        # The constant filter lets the optimizer drop joins with the missing table.
        return spark.createDataFrame([], schema).filter(F.lit(False))
    reader = spark.read.option("basePath", root)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*(a.path for a in attempts)).drop("attempt")


def spread(df: DataFrame) -> DataFrame:
    """Rows of few splits dealt out to all cores, for what is costly per row. A file of one row group is one split and
    keeps one core busy; tables with as many splits as there are cores stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
