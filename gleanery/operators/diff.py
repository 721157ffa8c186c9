"""Differences between two snapshots held as leaf rows.

A changed leaf shows up twice: its old value as removed, its new one as added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nested import EMPTY
from ..session import written
from .joins import join_unique
from .merge import proper_prefixes, to_leaves
from .state import StateTable, state_latest

ADDED, REMOVED, UNCHANGED = "added", "removed", "unchanged"


def snapshot_diff(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """(*on, kind, value_json) from two tables with one value_json per `on`."""
    o = old.select(*on, F.col("value_json").alias("__o"), F.lit(True).alias("__in_old"))
    n = new.select(*on, F.col("value_json").alias("__n"), F.lit(True).alias("__in_new"))
    pair = o.join(n, on, "full_outer")
    return _explode_kinds(pair, on, F.col("__in_old").isNotNull(), F.col("__in_new").isNotNull())


def _explode_kinds(pair: DataFrame, on: list[str], in_old: Column, in_new: Column) -> DataFrame:
    def row(kind, value):
        return F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value_json"))

    rows = (
        F.when(in_old & in_new & F.col("__o").eqNullSafe(F.col("__n")), F.array(row(UNCHANGED, "__n")))
        .when(in_old & in_new, F.array(row(REMOVED, "__o"), row(ADDED, "__n")))
        .when(in_old, F.array(row(REMOVED, "__o")))
        .when(in_new, F.array(row(ADDED, "__n")))
    )
    return pair.select(*on, F.explode(rows).alias("__r")).select(*on, "__r.*")


def nested_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Diff of nested records given as (key, path, kind, value_json) leaves.

    A record without an older snapshot has no diff. An empty object counts as a leaf
    only where the other side holds no object with content. Both sides are read more
    than once; give them as tables, or checkpointed.
    """
    new = join_unique(new, old.select(key).distinct(), key, "left_semi", "path")
    o, n = _paths(old, key, "old"), _paths(new, key, "new")
    pair = o.join(n, [key, "path"], "full_outer")

    def leaf(side, other):
        """The side's own leaf here, unless it is an empty object the other side fills."""
        filled = (F.col(f"{side}.kind") == EMPTY) & F.coalesce(F.col(f"{other}_inside"), F.lit(False))
        return F.when(~filled, F.col(f"{side}.value_json"))

    pair = pair.select(key, "path", leaf("old", "new").alias("__o"), leaf("new", "old").alias("__n"))
    return _explode_kinds(pair, [key, "path"], F.col("__o").isNotNull(), F.col("__n").isNotNull())


def _paths(side: DataFrame, key: str, name: str) -> DataFrame:
    """Per path: the leaf there, if any, and whether there is something below it."""
    own = F.struct("path", F.struct("kind", "value_json").alias("leaf"))
    above = F.transform(
        proper_prefixes(F.col("path")),
        lambda p: F.struct(p.alias("path"), F.lit(None).cast("struct<kind:string,value_json:string>").alias("leaf")),
    )
    return (
        side.select(key, F.explode(F.concat(F.array(own), above)).alias("__e"))
        .groupBy(key, F.col("__e.path").alias("path"))
        .agg(
            F.max("__e.leaf").alias(name),
            F.max(F.col("__e.leaf").isNull()).alias(f"{name}_inside"),
        )
    )


# The state partition in which the last snapshot of each record is kept.
SNAPSHOTS = "_system.configuration"


def diff_with_last(state: StateTable, records: DataFrame, batch_id: int, levels: int = 8) -> DataFrame:
    """Stores records (key, value_json) as their newest snapshot and returns what changed.

    A record that is new, or whose last snapshot was empty, has no diff. Neither have
    records that are not among these.
    """
    state.store(
        records.select(
            F.lit(SNAPSHOTS).alias("partition_key"), "key", "value_json", F.lit(0).alias("seq")
        ),
        batch_id,
    )

    def leaf_table(rows):
        return to_leaves(rows, ["key"], "value_json", levels)

    now = state_latest(state.log(SNAPSHOTS).filter(F.col("batch_id") == int(batch_id)))
    last = state.latest(SNAPSHOTS, before=batch_id).join(now.select("key"), "key", "left_semi")
    before = leaf_table(last).filter(F.size("path") > 0)
    return nested_diff(written(before, "before"), written(leaf_table(now), "now"), "key")


def _below(dotted: str):
    parts = dotted.split(".")
    return F.slice("path", 1, len(parts)) == F.array(*[F.lit(p) for p in parts])


def has_changed(diff: DataFrame, key: str, dotted: str) -> DataFrame:
    """Per record: whether the path or anything under it was added or removed."""
    hit = (F.col("kind") != UNCHANGED) & _below(dotted)
    return diff.groupBy(key).agg(F.max(hit).alias("changed"))


def side_at(diff: DataFrame, side: str, dotted: str) -> DataFrame:
    """Leaves at or under the path on one side, with the path relative to it."""
    n = len(dotted.split("."))
    return diff.filter((F.col("kind") == side) & _below(dotted)).withColumn(
        "path", F.slice("path", n + 1, F.greatest(F.size("path") - n, F.lit(0)))
    )


def keys_added(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    return new.select(*on).distinct().join(old.select(*on).distinct(), on, "left_anti")


def keys_removed(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    return keys_added(new, old, on)


def key_union(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    return old.select(*on).unionByName(new.select(*on)).distinct()
