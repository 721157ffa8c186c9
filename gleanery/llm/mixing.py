"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source it is placed by that key, the
sizes of all documents before it are summed, and the source is cut where its budget ends.
The sums are distributed: keys are cut into ranges, ranges are summed over each source, and
only the documents of one range are put in order together. A budget above the source's
size takes whole epochs first and cuts the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 42
KEY_BITS = 60
# Documents of one source in one key range; ranges double in number as the table grows.
RANGE_ROWS = 1 << 14


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(key: Column, seed: int) -> Column:
    """60 bits of the MD5 of the key and the seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """no_source, src, source_size, target: one row per source.

    The weights go round over the sources in code point order, null last. A source gets its
    weight's part of `share` of all sizes, but not above `most` times its own size; what is
    above goes to the others by weight. That is one level L for all, with target =
    min(most * size, L * weight): the sources are taken by the L at which each one is full,
    and L is found where the next one is not full. The windows run over one row per source.
    """
    sums = sized.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("no_source", "src")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    full_at = F.col("cap") / F.col("weight")
    before = Window.orderBy("full_at", "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("nth"))).over(all_rows)
    return (
        sums.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("full_at", full_at)
        .withColumn("level", left / weight_left)
        .withColumn("nth", F.row_number().over(Window.orderBy("full_at", "no_source", "src")))
        .withColumn("target", F.least("cap", level * F.col("weight")))
        .select("no_source", "src", "source_size", "target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, seed=SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of `docs` (doc_id, source, text).

    `size` is the number of words (null text: 0), `taken` how many of them the mix takes,
    epochs counted. A source's taken words are its target rounded down, if it has words at
    all; a document has at most `most` times its size, and at most one document of a source is
    cut. Null sources are one source. Rows with the same doc_id have neighbouring places, rows
    that are the same in all columns used may swap theirs. An empty table gives no rows.
    """
    return _places(docs, [], weights, share, most, seed)


def _places(docs: DataFrame, carried: list[str], weights, share, most, seed) -> DataFrame:
    """The rows of `mix`, each with the columns `carried` of its row of `docs`."""
    sized = cut(
        docs.select(
            *carried,
            "doc_id",
            F.col("source").isNull().alias("no_source"),
            F.coalesce("source", F.lit("")).alias("src"),
            n_words(F.col("text")).alias("size"),
            random_key(F.col("doc_id"), seed).alias("key"),
        ),
        "sized",
    )
    # A power of two, so that the ranges are the leading bits of the key.
    bits = max(6, (sized.count() // RANGE_ROWS).bit_length())
    sized = sized.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    source = ["no_source", "src"]
    earlier = Window.partitionBy(*source).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        sized.groupBy(*source, "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .drop("range_size")
        .join(source_targets(sized, weights, share, most), source)
    )
    own = Window.partitionBy(*source, "range").orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    # Whole epochs, and what is left of the budget where this document begins in the last one.
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("start")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return (
        sized.join(ranges, [*source, "range"])
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
        .select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *carried)
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, seed=SEED) -> DataFrame:
    """The rows of `docs` as often as the mix takes them: a document of which the mix takes t of
    s words is there t / s times, rounded up (the document at the cut of a source stays whole).
    Documents without words are there once if their source has a target above half its size,
    so that they follow their source. Each row follows its own place in the plan of its source, also
    where doc_ids are repeated or null: rows are numbered in a table of their own, written once.
    """
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    plan = _places(numbered, ["__row"], weights, share, most, seed)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(
        F.when(F.col("target") * 2 > F.col("source_size"), 1).otherwise(0)
    )
    joined = numbered.join(plan.select("__row", copies.cast("int").alias("__copies")), "__row")
    again = F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__again")
    return joined.select(*docs.columns, again).drop("__again")
