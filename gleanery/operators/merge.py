"""Folding ordered layers of nested records, on leaf rows.

A record is a set of rows (key, layer, path, kind, value_json), see
functions.nested.leaves. The fold is: a later layer wins, objects merge, and lists
either concatenate (`layered_merge`) or are replaced (`fold_extra`). It is not
associative when kinds clash, so every path gets the layer below which nothing
survives ("cut"), found by aggregation; no record is ever gathered in one place.

A merged list stays one row per element, ordered by (layer, idx).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nested import EMPTY, LIST, OPEN, SCALAR, leaves, list_elements
from ..schemas import METADATA_FIELDS
from ..session import work_dir, written
from .joins import join_unique

_INSIDE = "inside"
EMPTY_LIST = "empty_list"


def to_leaves(records: DataFrame, keep: list[str], column: str, levels: int = 8) -> DataFrame:
    """keep, path, kind, value_json: a row per leaf of each record, however deep.

    `levels` levels are opened in one pass. Whether any record can be deeper is told by its number of
    braces; only then are the objects that are still closed written to the shared folder and opened in turn.
    """
    braces = F.max(F.length(column) - F.length(F.replace(column, F.lit("{"), F.lit(""))))
    deep = (records.agg(braces).first()[0] or 0) > levels
    rows = records.select(*keep, F.array().cast("array<string>").alias("__at"), F.col(column).alias("__json"))
    done = None
    while True:
        found = rows.select(*keep, "__at", F.explode(leaves(F.col("__json"), levels)).alias("__l")).select(
            *keep, F.concat("__at", "__l.path").alias("path"), "__l.kind", "__l.value_json"
        )
        closed = found.filter(F.col("kind") != OPEN)
        done = closed if done is None else done.unionByName(closed)
        if not deep:
            return done
        path = work_dir(records.sparkSession, "records")
        found.filter(F.col("kind") == OPEN).write.parquet(path)
        rest = records.sparkSession.read.schema(found.schema).parquet(path)
        if rest.isEmpty():
            return done
        rows = rest.select(*keep, F.col("path").alias("__at"), F.col("value_json").alias("__json"))


def proper_prefixes(path: Column) -> Column:
    n = F.size(path)
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(path, 1, i))
    )


def _last(kind: str) -> Column:
    return F.max(F.when(F.col("kind") == kind, F.col("layer")))


def _fold(entries: DataFrame, key: str, lists_concatenate: bool) -> DataFrame:
    """Per (key, path): the last layer of each kind, the last scalar, and `wiped_at`, the
    last layer that put a plain value where this path has a parent."""
    kind = F.col("kind")
    if not lists_concatenate:
        kind = F.when(kind == LIST, SCALAR).otherwise(kind)
    # A leaf says something about its own path, and that all paths above it are objects.
    own = F.struct("path", kind.alias("kind"), "value_json")
    above = F.transform(
        proper_prefixes(F.col("path")),
        lambda p: F.struct(
            p.alias("path"), F.lit(_INSIDE).alias("kind"), F.lit(None).cast("string").alias("value_json")
        ),
    )
    said = entries.select(key, "layer", F.explode(F.concat(F.array(own), above)).alias("__e"))
    at_path = (
        said.select(key, "layer", "__e.*")
        .groupBy(key, "path")
        .agg(
            _last(SCALAR).alias("scalar_at"),
            _last(LIST).alias("list_at"),
            _last(EMPTY).alias("empty_at"),
            _last(_INSIDE).alias("inside_at"),
            F.max_by("value_json", F.when(F.col("kind") == SCALAR, F.col("layer"))).alias("scalar"),
        )
        .withColumns(
            {
                "value_at": F.greatest("scalar_at", "list_at"),
                "object_at": F.greatest("empty_at", "inside_at"),
            }
        )
        # Used several times below; one row per path, so small next to the entries.
        .transform(written, "merge-paths")
    )
    wiped = at_path.filter("value_at is not null and inside_at is not null").select(
        key, F.col("path").alias("above"), F.col("value_at").alias("wiped_at")
    )
    if wiped.isEmpty():
        return at_path.withColumn("wiped_at", F.lit(None).cast(at_path.schema["scalar_at"].dataType))
    below = at_path.select(
        key, "path", F.explode(proper_prefixes(F.col("path"))).alias("above")
    ).filter(F.size("above") > 0)
    from_above = (
        join_unique(below, wiped, [key, "above"], "inner", "path")
        .groupBy(key, "path")
        .agg(F.max("wiped_at").alias("wiped_at"))
    )
    return at_path.join(from_above, [key, "path"], "left").transform(written, "merge-wiped")


def _after(layer: str, *others: str) -> Column:
    """The layer exists and comes after all others that do."""
    last = F.greatest(*others) if len(others) > 1 else F.col(others[0])
    return F.col(layer).isNotNull() & (last.isNull() | (F.col(layer) > last))


def layered_merge(entries: DataFrame, key: str, lists_concatenate: bool = True) -> DataFrame:
    """(key, layer, path, kind, value_json) -> (key, path, kind, layer, idx, value_json)."""
    folded = _fold(entries, key, lists_concatenate)
    scalar = _after("scalar_at", "list_at", "object_at", "wiped_at")
    empty = _after("empty_at", "value_at", "wiped_at") & ~F.coalesce(
        _after("inside_at", "value_at", "wiped_at"), F.lit(False)
    )
    values = folded.filter(scalar | empty).select(
        key,
        "path",
        F.when(scalar, SCALAR).otherwise(EMPTY).alias("kind"),
        F.when(scalar, F.col("scalar_at")).otherwise(F.col("empty_at")).alias("layer"),
        F.lit(None).cast("int").alias("idx"),
        F.when(scalar, F.col("scalar")).otherwise("{}").alias("value_json"),
    )
    if not lists_concatenate:
        return values
    lists = entries.filter(F.col("kind") == LIST).select(key, "path", "layer", "value_json")
    cuts = (
        folded.filter("list_at is not null")
        .withColumn("cut", F.greatest("scalar_at", "object_at", "wiped_at"))
        .filter("cut is not null")
        .select(key, "path", "cut")
    )
    if not cuts.isEmpty():
        lists = join_unique(lists, cuts, [key, "path"], "left", "layer").filter(
            "cut is null or layer > cut"
        )
    elements = lists.select(
        key, "path", "layer", F.posexplode_outer(list_elements(F.col("value_json"))).alias("idx", "e")
    ).select(
        key,
        "path",
        F.when(F.col("idx").isNull(), EMPTY_LIST).otherwise(LIST).alias("kind"),
        "layer",
        "idx",
        F.col("e").alias("value_json"),
    )
    return values.unionByName(elements)


def merged_at(merged: DataFrame, dotted: str) -> DataFrame:
    """Rows of merged records at or under a dotted path."""
    parts = dotted.split(".")
    return merged.filter(F.slice("path", 1, len(parts)) == F.array(*[F.lit(p) for p in parts]))


def metadata_merge(patches: DataFrame, seq: str = "seq") -> DataFrame:
    """Scalar metadata fields folded per source_url: the last non-null value wins.

    `processing_state` is never null in a patch (it defaults to pending), so a patch
    that does not set it resets it.
    """
    fields = [
        f for f in METADATA_FIELDS
        if f in patches.columns and f not in ("source_url", "tags", "extra_json")
    ]
    if "processing_state" in fields:
        patches = patches.withColumn(
            "processing_state", F.coalesce("processing_state", F.lit("pending"))
        )
    return patches.groupBy("source_url").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    )


def merged_tags(patches: DataFrame, seq: str = "seq") -> DataFrame:
    """Tags of all patches, one row each, in order of (seq, idx)."""
    return patches.select("source_url", seq, F.posexplode("tags").alias("idx", "tag"))


def merged_extra(patches: DataFrame, seq: str = "seq", levels: int = 8) -> DataFrame:
    """`extra` folded per source_url: objects merge, anything else is replaced."""
    entries = to_leaves(
        patches.filter("extra_json is not null"), ["source_url", seq], "extra_json", levels
    ).withColumnRenamed(seq, "layer")
    return layered_merge(entries, "source_url", lists_concatenate=False)


def as_records(merged: DataFrame, key: str, name: str = "record_json") -> DataFrame:
    """(key, record): the rows of merged records put together, one JSON object per key, names sorted.

    A record is one cell here, so this is for records that fit one; the rows are for all others.
    """
    leaf = F.struct("path", "layer", "idx", "kind", "value_json")
    rows = merged.groupBy(key).agg(F.collect_list(leaf).alias("leaves"))

    def build(batches):
        for batch in batches:
            records = [_record(leaves) for leaves in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.string())], [key, name])

    kind = merged.schema[key].dataType.simpleString()
    return rows.mapInArrow(build, f"`{key}` {kind}, `{name}` string")


def _record(leaves) -> str:
    root = {}
    for leaf in sorted(leaves, key=lambda r: (r["path"], r["layer"] is not None and r["layer"], r["idx"] or 0)):
        *above, last = leaf["path"]
        node = root
        for part in above:
            node = node.setdefault(part, {})
        if leaf["kind"] == LIST:
            node.setdefault(last, []).append(json.loads(leaf["value_json"]))
        elif leaf["kind"] == EMPTY_LIST:
            node.setdefault(last, [])
        else:
            node[last] = json.loads(leaf["value_json"])
    return json.dumps(root, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def merged_metadata(patches: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per source_url with all merged metadata, tags and extra among it, as `update_metadata` takes it."""
    by_seq = F.array_sort(F.collect_list(F.when(F.col("tags").isNotNull(), F.struct(seq, "tags"))))
    tags = patches.groupBy("source_url").agg(F.flatten(F.transform(by_seq, lambda t: t["tags"])).alias("tags"))
    # A patch without extra leaves the root as an empty object, which is no member of the record.
    extra = as_records(merged_extra(patches, seq).filter(F.size("path") > 0), "source_url", "extra_json")
    return (
        metadata_merge(patches, seq)
        .join(tags, "source_url", "left")
        .join(extra, "source_url", "left")
        .withColumn("extra_json", F.coalesce("extra_json", F.lit("{}")))
    )


def layer_order(layers: DataFrame, rank: str = "rank", name: str = "name") -> DataFrame:
    """(rank, name) pairs with their layer number: by rank, then by name.

    Repeats are folded first. The sorted pairs are cut into ranges, so that a rank with most of the names is many
    ranges; pairs are numbered inside their range and shifted by the number of pairs before it. A missing
    rank comes after all others, a missing name before the others of its rank.
    """
    order = [F.col(rank).asc_nulls_last(), F.col(name).asc_nulls_first()]
    pairs = layers.select(rank, name).distinct().repartitionByRange(*order)
    # Written, so that every pair stays in the range it was counted in.
    ranges = pairs.withColumn("__range", F.spark_partition_id()).transform(written, "layers")
    # One row for each shuffle partition.
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.selectExpr("__range", "sum(__n) over (order by __range) - __n as __offset")
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.join(F.broadcast(offsets), "__range").select(rank, name, (F.col("__offset") + nth).alias("layer"))
