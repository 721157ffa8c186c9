"""Parent/child trees of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written
from .joins import join_unique


def item_tree(items: DataFrame) -> DataFrame:
    """(item_id, parent_id, depth, root_id) from item_id and parent_id.

    Every row holds a pointer to an ancestor, first its parent. A round replaces it by
    the ancestor's own pointer, so distances double and a tree of depth d is done after
    log2(d) joins. Rows that reached their root are written once and not carried on. A
    parent that is not in the table is a root. Rows on or below a cycle have no root: they come out
    with null depth and root_id, and do not stop the others.
    """
    rows = items.select(
        "item_id",
        "parent_id",
        F.coalesce("parent_id", "item_id").alias("up"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("parent_id").isNull().alias("done"),
    ).transform(written, "paths")
    finished, open_rows = rows.filter("done"), rows.filter("not done")
    # No path is longer than there are rows, so after that many doublings only cycles are left.
    for _ in range(rows.count().bit_length() + 1):
        if open_rows.isEmpty():
            break
        target = finished.unionByName(open_rows).select(
            F.col("item_id").alias("up"),
            F.col("up").alias("__up"),
            F.col("depth").alias("__hops"),
            F.col("done").alias("__done"),
        )
        moved = (
            join_unique(open_rows, target, "up", "left", "item_id")
            .select(
                "item_id",
                "parent_id",
                F.coalesce("__up", "up").alias("up"),
                (F.col("depth") + F.coalesce("__hops", F.lit(0))).alias("depth"),
                F.coalesce("__done", F.lit(True)).alias("done"),
            )
            .transform(written, "paths")
        )
        finished, open_rows = finished.unionByName(moved.filter("done")), moved.filter("not done")
    lost = open_rows.withColumns({"depth": F.lit(None).cast("long"), "up": F.lit(None).cast("string")})
    return finished.unionByName(lost).select("item_id", "parent_id", "depth", F.col("up").alias("root_id"))
