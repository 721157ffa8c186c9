"""Snapshots that are compared by digests first.

A snapshot is stored by ranges of its keys' hash: a range is a folder and is parted into leaves, by which its files are
sorted. Each leaf has a digest that does not depend on the order of its rows, and so has each range, as the sum of its
leaves. Two snapshots are compared from the ranges down to the leaves, and only rows of leaves that differ are joined; of the
others at most the new side is read, without a shuffle, if unchanged rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources import commits
from .diff import UNCHANGED, snapshot_diff

RANGES, LEAVES = 64, 64
# Differing leaves up to this many are literals, which skip row groups as well as folders.
FEW = 500
# The leaf of rows with a null in their key. Such rows equal none, so they are compared anew every time.
NO_KEY = -1
_RANGE, _LEAF = "key_range", "key_leaf"


class Snapshots:
    """Snapshots of rows of `schema`, whose columns are the keys `on` and value_json, by the number of their batch. A key has one row
    in a snapshot. A batch that is stored again replaces itself in one step; one that is cut off is not seen.

    `ranges` times `leaves` is how many digests a snapshot has. They should be as many as there are row groups or more, and
    stay the same for all snapshots below one `root`.
    """

    def __init__(self, spark: SparkSession, root: str, schema, on: list[str], ranges: int = RANGES, leaves: int = LEAVES):
        self.spark, self.root, self.on = spark, root.rstrip("/"), on
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.ranges, self.leaves = ranges, leaves
        self._stored = T.StructType([*self.schema.fields, T.StructField(_LEAF, T.IntegerType()), T.StructField(_RANGE, T.IntegerType())])

    def store(self, rows: DataFrame, batch: int) -> None:
        no_key = F.lit(False)
        for c in self.on:
            no_key = no_key | F.col(c).isNull()
        leaf = F.pmod(F.xxhash64(*self.on), F.lit(self.ranges * self.leaves)).cast("int")
        placed = (
            rows.select(*self.schema.fieldNames())
            .withColumn(_LEAF, F.when(no_key, NO_KEY).otherwise(leaf))
            .withColumn(_RANGE, F.floor(F.col(_LEAF) / self.leaves).cast("int"))
        )
        # Tasks get consecutive leaves. The last column lets rows without a key be parted as well.
        sorted_ = placed.repartitionByRange(_RANGE, _LEAF, F.xxhash64(*self.schema.fieldNames())).sortWithinPartitions(_RANGE, _LEAF)
        attempt = commits.new_attempt(self.root, batch, "snapshot")
        try:
            sorted_.write.partitionBy(_RANGE).parquet(f"{attempt.path}/rows")
            self._digests(self._rows(attempt)).coalesce(1).write.parquet(f"{attempt.path}/digests")
        except BaseException:
            commits.abort(self.spark, attempt)
            raise
        commits.commit(self.spark, attempt)

    def _digests(self, rows: DataFrame) -> DataFrame:
        """Rows per leaf, and two sums over 120 bits of the rows' SHA-256."""
        sha = F.sha2(F.to_json(F.struct(*self.schema.fieldNames())), 256)

        def part(first: int) -> Column:
            return F.sum(F.conv(F.substring(sha, first, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")

        sums = (F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b"))
        return rows.filter(F.col(_LEAF) != NO_KEY).groupBy(_RANGE, _LEAF).agg(*sums)

    def _attempt(self, batch: int) -> commits.Attempt:
        for a in commits.committed(self.spark, self.root):
            if a.batch_id == int(batch):
                return a
        raise ValueError(f"there is no snapshot {batch} in {self.root}")

    def _rows(self, attempt: commits.Attempt) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(f"{attempt.path}/rows")

    def read(self, batch: int) -> DataFrame:
        return self._rows(self._attempt(batch)).drop(_RANGE, _LEAF)

    def _differing(self, old: commits.Attempt, new: commits.Attempt) -> tuple[list[int], list[int]]:
        """Ranges and leaves whose digests differ: at most `ranges` and `ranges` times `leaves` numbers."""
        kind = f"{_RANGE} int, {_LEAF} int, n long, a decimal(38,0), b decimal(38,0)"
        o, n = (self.spark.read.schema(kind).parquet(f"{x.path}/digests") for x in (old, new))

        def unlike(left, right, keys):
            pair = left.alias("o").join(right.alias("n"), keys, "full_outer")
            same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("n", "a", "b")]
            return sorted(r[0] for r in pair.filter(~(same[0] & same[1] & same[2])).select(keys[-1]).collect())

        def upper(leaves):
            return leaves.groupBy(_RANGE).agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")])

        ranges = unlike(upper(o), upper(n), [_RANGE])
        if not ranges:
            return [], []
        return ranges, unlike(o.filter(F.col(_RANGE).isin(ranges)), n.filter(F.col(_RANGE).isin(ranges)), [_RANGE, _LEAF])

    def _only(self, rows: DataFrame, ranges: list[int], leaves: list[int]) -> DataFrame:
        """Rows of these leaves, and those without a key."""
        rows = rows.filter(F.col(_RANGE).isin([NO_KEY, *ranges]))
        if len(leaves) <= FEW:
            return rows.filter(F.col(_LEAF).isin([NO_KEY, *leaves]))
        return rows.join(F.broadcast(self._table(leaves, True)), _LEAF, "left_semi")

    def _table(self, leaves: list[int], no_key: bool) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in leaves + [NO_KEY] * no_key], f"{_LEAF} int")

    def diff(self, old: int, new: int, unchanged: bool = True) -> DataFrame:
        """(*on, kind, value_json) as `snapshot_diff` gives it for the two batches; without the unchanged rows, leaves that are
        alike are not read at all."""
        before, now = self._attempt(old), self._attempt(new)
        ranges, leaves = self._differing(before, now)
        pair = [self._only(self._rows(x), ranges, leaves).drop(_RANGE, _LEAF) for x in (before, now)]
        found = snapshot_diff(*pair, self.on)
        if not unchanged:
            return found.filter(F.col("kind") != UNCHANGED)
        alike = self._rows(now).filter(F.col(_LEAF) != NO_KEY)
        if len(leaves) <= FEW:
            alike = alike.filter(~F.col(_LEAF).isin(leaves)) if leaves else alike
        else:
            alike = alike.join(F.broadcast(self._table(leaves, False)), _LEAF, "left_anti")
        return found.unionByName(alike.select(*self.on, F.lit(UNCHANGED).alias("kind"), "value_json"))
