"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T

from ..session import work_dir

# A key is heavy when it holds more than 1/HEAVY_SHARE of all rows. There are fewer than
# HEAVY_SHARE such keys in a table of any size, which bounds what is broadcast for them.
HEAVY_SHARE = 1000
HEAVY_ROWS = 500


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, so that later steps and retries start from there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_values(df: DataFrame, column: str) -> list:
    """Values of `column` (null left out) that hold more than 1/HEAVY_SHARE of the rows:
    fewer than HEAVY_SHARE of them. Counted over all rows, with partial counts before the shuffle."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    # The total comes from the same pass. The heavy ones are among the most frequent.
    seen = Observation()
    top = counts.observe(seen, F.sum("__n").alias("total")).orderBy(F.desc("__n")).limit(HEAVY_SHARE).collect()
    total = seen.get["total"] or 0
    return sorted(r[0] for r in top if r[0] is not None and r[1] > max(HEAVY_ROWS, total / HEAVY_SHARE))


DIGEST = "__digest"


def with_digest(docs: DataFrame, digests, kind: T.DataType) -> DataFrame:
    """`docs` and the column DIGEST: digests(texts) of its column `text`, for whole texts."""
    out = T.StructType(docs.schema.fields + [T.StructField(DIGEST, kind)])
    at = docs.columns.index("text")

    def task(batches):
        for batch in batches:
            column = pa.array(digests(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, DIGEST])

    return docs.mapInArrow(task, out)


def rows_of(digested: DataFrame, winners: DataFrame) -> DataFrame:
    """One row of `digested` for each (doc_id, digest) of `winners`: these are distinct. Of several rows with the
    same two, that with the longest text is taken."""
    names = [c for c in digested.columns if c != DIGEST]
    # No null in the keys, so that the join and the numbering share one shuffle.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    left = digested.withColumn("__key", key)
    right = winners.select(key.alias("__key"), F.col("digest").alias(DIGEST))
    nth = F.row_number().over(Window.partitionBy("__key", DIGEST).orderBy(F.length("text").desc()))
    return left.join(right, ["__key", DIGEST], "left_semi").withColumn("__nth", nth).filter("__nth = 1").select(*names)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker. Task functions travel by value,
    so their own module globals start empty in every task."""
    name = "gleanery_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__
