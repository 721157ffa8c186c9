"""All sources as one listing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F


def union_sources(
    spark: SparkSession, sources: dict[str, Callable[[SparkSession], DataFrame]]
) -> DataFrame:
    """Rows of every source, tagged with its name. A source that cannot be opened adds
    one error row and does not stop the others."""
    parts, failed = [], []
    for name, listing in sources.items():
        try:
            df = listing(spark)
            parts.append(
                df.withColumns({"source": F.lit(name), "error": F.lit(None).cast("string")})
            )
        except (PySparkException, OSError) as e:
            condition = e.getCondition() if isinstance(e, PySparkException) else type(e).__name__
            failed.append((name, condition or type(e).__name__))
    if failed:
        parts.append(spark.createDataFrame(failed, "source string, error string"))
    if not parts:
        return spark.createDataFrame([], "source_url string, source string, error string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
