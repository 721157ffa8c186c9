"""Joins that do not shuffle a large side for a small one, and that stay balanced when
one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A key is heavy when it holds more than 1/HEAVY_SHARE of the rows, so there are
# always fewer than HEAVY_SHARE heavy keys: that bounds what is broadcast here. A key
# with few rows is no burden, whatever its share.
HEAVY_SHARE = 1000
HEAVY_ROWS = 10_000
# What may be broadcast, after counting it.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
_HEAVY, _SALT = "__heavy", "__salt"


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 16)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + 16)
        else:
            parts.append(F.lit(16))
    return reduce(lambda a, b: a + b, parts)


def is_small(df: DataFrame) -> bool:
    """Counts the rows and their bytes; one pass over `df`."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df).cast("long"))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def light(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it is small; otherwise the join shuffles as usual.

    The optimizer's own estimate is no help for rows that come from Python or out of a
    join, and guessing wrong means shuffling the whole table on the other side.
    """
    return F.broadcast(df) if is_small(df) else df


def only_matching(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """`rows` cut down to the keys asked for, if these are few: so that what follows does
    not group or shuffle the whole table. With many keys, `rows` as they are."""
    keys = keys.select(on)
    if not is_small(keys):
        return rows
    return rows.join(F.broadcast(keys.distinct()), on, "left_semi")


def heavy_keys(df: DataFrame, on: list[str]) -> DataFrame:
    total = df.select(F.count(F.lit(1))).scalar()
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter((F.col("__n") * HEAVY_SHARE > total) & (F.col("__n") > HEAVY_ROWS))
        .select(*on)
    )


def _mark(df: DataFrame, heavy: DataFrame, on: list[str]) -> DataFrame:
    names = {k: f"__heavy_{k}" for k in on}
    keys = heavy.select(*[F.col(k).alias(names[k]) for k in on], F.lit(True).alias(_HEAVY))
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(keys[names[k]]) for k in on])
    return df.join(F.broadcast(keys), same, "left").drop(*names.values())


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: list[str] | str,
    how: str,
    spread_by: list[str] | str,
    right_is_small: bool = False,
) -> DataFrame:
    """`left.join(right, on, how)` for a right side with one row per key.

    Left rows of a heavy key are spread over all shuffle partitions by a hash of
    `spread_by` (columns that tell those rows apart), and the one right row of that
    key is repeated for each. All other rows join as usual. A right side that the
    caller found small is simply broadcast.
    """
    if right_is_small:
        return left.join(F.broadcast(right), on, how)
    on = [on] if isinstance(on, str) else list(on)
    spread_by = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(left, on)

    salt = F.when(F.col(_HEAVY), F.pmod(F.xxhash64(*spread_by), F.lit(n))).otherwise(F.lit(0))
    salted_left = _mark(left, heavy, on).withColumn(_SALT, salt.cast("int")).drop(_HEAVY)

    last = F.when(F.col(_HEAVY), F.lit(n - 1)).otherwise(F.lit(0))
    salted_right = (
        _mark(right, heavy, on)
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), last)))
        .drop(_HEAVY)
    )
    return salted_left.join(salted_right, [*on, _SALT], how).drop(_SALT)
