"""Counters over the pipeline's stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How a component's status counts towards the whole.
SEVERITY = {"healthy": 0, "degraded": 1, "disabled": 1, "unhealthy": 2, "error": 2}
LEVELS = ("healthy", "degraded", "unhealthy")


def discovery_summary(discovered: DataFrame, items: DataFrame) -> DataFrame:
    """How many discovered rows are new and how many are stored already."""
    # Counted per URL first: what is joined then has each URL once on both sides.
    per_url = discovered.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"))
    stored = items.select("source_url").distinct().withColumn("stored", F.lit(True))
    return per_url.join(stored, "source_url", "left").agg(
        F.coalesce(F.sum(F.when(F.col("stored").isNull(), F.col("n"))), F.lit(0)).alias("scheduled"),
        F.coalesce(F.sum(F.when(F.col("stored"), F.col("n"))), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("discovered"),
    )


def message_class(message: Column) -> Column:
    """The message without the part that differs from row to row."""
    return F.trim(F.regexp_replace(message, "(: | from ).*$", ""))


def stage_status(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per stage, status and kind of message."""
    parts = [
        df.select(
            F.lit(stage).alias("stage"),
            F.col("route_status").alias("status"),
            message_class(F.col("message")).alias("message"),
        )
        for stage, df in stages.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("stage", "status", "message").agg(F.count(F.lit(1)).alias("rows"))


def severity(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(0))


def pipeline_health(components: DataFrame) -> DataFrame:
    """Worst status of (component, status) rows."""
    worst = F.coalesce(F.max(severity(F.col("status"))), F.lit(0))
    return components.agg(worst.alias("severity")).select(
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("severity") + 1).alias("status")
    )


def stage_components(status: DataFrame, degraded_share: float = 0.0) -> DataFrame:
    """One (component, status) row per stage: all failed is unhealthy, some is degraded."""
    bad = F.sum(F.when(F.col("status") != "success", F.col("rows")).otherwise(0))
    return status.groupBy(F.col("stage").alias("component")).agg(
        F.when(bad == F.sum("rows"), "unhealthy")
        .when(bad > F.sum("rows") * degraded_share, "degraded")
        .otherwise("healthy")
        .alias("status")
    )


def backlog(rows: DataFrame) -> DataFrame:
    """Rows not completed yet, per processing state."""
    return (
        rows.filter(F.col("processing_state") != "completed")
        .groupBy("processing_state")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
