"""Importance resampling towards a target distribution of hashed n-grams.

Texts are lower-cased, split and flattened by Arrow kernels and dictionary-encoded, so from then on a
word is a small number. Runs of several words are pairs of such numbers, shifted against each other; of
each distinct pair the CRC-32 is computed once, out of that of its first part. The CRC picks a bucket. Documents and target texts
are counted by bucket; the log ratio of the two is the gain of a feature, and a document's
weight the sum of its gains, added up segment by segment. Gumbel noise out of the document's id turns
the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, partitions

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Everything but letters, digits and what is not ASCII; capitals are lower-cased before.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, size: int = CHUNK_BYTES):
    """Cuts of a batch whose texts in `column` have about `size` bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def features(texts: pa.Array, max_run: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Words of each text, and for every length of run (the runs' texts, their numbers, the CRC-32 of each number)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_BETWEEN)
    words, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # What precedes the first separator or follows the last one may be empty.
    real = pc.not_equal(words, "")
    coded = words.filter(real).dictionary_encode()
    doc = doc.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
    found = [(doc, word, crc)]
    run = word
    for n in range(2, max_run + 1):
        # The run that begins at each place, and the word that follows it in the same text.
        inside = doc[: len(doc) - n + 1] == doc[n - 1 :] if len(doc) >= n else np.empty(0, bool)
        first = found[-1][2]
        ahead = run[: len(inside)] if n == 2 else run_at[: len(inside)]
        pairs = ahead[inside] * max(1, len(spelled)) + word[n - 1 :][inside]
        distinct, number = np.unique(pairs, return_inverse=True)
        left, right = np.divmod(distinct, max(1, len(spelled)))
        joined = (zlib.crc32(b" " + spelled[b], int(first[a])) for a, b in zip(left.tolist(), right.tolist()))
        found.append((doc[: len(inside)][inside], number, np.fromiter(joined, np.int64, len(distinct))))
        # Numbers of the runs by the place of their first word, for the next length.
        run_at = np.zeros(len(inside), np.int64)
        run_at[inside] = number
    return np.bincount(doc, minlength=len(texts)), found


def bucket_counts(texts: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often the features of all whole texts (one column) fall into each bucket that occurs."""

    def task(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for _, number, crc in features(part.column(0), max_run)[1]:
                    if len(number):
                        counts += np.bincount((crc % buckets)[number], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    # At most one row per bucket leaves a task.
    return texts.mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain, in thousandths: the logarithm of its smoothed share in the target by that in the source."""
    all_source, all_target = sum(source.values()), sum(target.values())

    def gain(b):
        s, t = source.get(b, 0), target.get(b, 0)
        return math.floor(1000 * math.log(float(t + 1) * float(all_source + buckets) / (float(s + 1) * float(all_target + buckets))))

    return np.array([gain(b) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, by_bucket: np.ndarray, max_run: int = MAX_RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row per row of `docs` (doc_id, text)."""
    buckets = len(by_bucket)

    def task(batches):
        for batch in batches:
            for part in slices(batch, 1):
                n_words, found = features(part.column(1), max_run)
                n_features = np.zeros(part.num_rows, np.int64)
                weight = np.zeros(part.num_rows, np.int64)
                for doc, number, crc in found:
                    n = np.bincount(doc, minlength=part.num_rows)
                    total = np.concatenate(([0], np.cumsum(by_bucket[crc % buckets][number])))
                    ends = np.cumsum(n)
                    n_features += n
                    weight += total[ends] - total[ends - n]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_features), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        task, "doc_id long, n_words long, n_features long, weight long"
    )


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_run: int = MAX_RUN,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per row of `docs` (doc_id, text); `target`
    has a column text.

    `rank` numbers the draw: `percent` % (rounded down) of the documents with `min_words` words, highest scores
    first, ties to the smaller doc_id (null last; among rows of the same id as they lie in the
    table); null for all others. Null and empty texts have no words and weight 0. Repeated rows
    are documents of their own. An empty target leaves all to the smoothing; empty `docs` give no rows.

    Features are counted per task, so at most `buckets` rows per task are shuffled and `buckets` rows reach
    the driver. Ranks come out of a sort by ranges and the ranges' sizes; no task sees more than a range.
    """

    def counted(df: DataFrame) -> dict[int, int]:
        return dict(map(tuple, bucket_counts(df.select(F.col("text").cast("string")), max_run, buckets).collect()))

    by_bucket = gains(counted(docs), counted(target), buckets)
    scored = cut(
        weights(docs, by_bucket, max_run)
        .withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
        .withColumn("eligible", F.col("n_words") >= min_words)
        .withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    drawn = percent * scored.filter("eligible").count() // 100
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    # The number holds the range in its upper bits and the place within it in its lower 33.
    ranged = cut(
        scored.repartitionByRange(partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),
        "ranged",
    )
    part = F.shiftright("at", 33)
    sizes = sorted(map(tuple, ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()))
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    # One row per range: as many as there are shuffle partitions.
    starts = F.broadcast(docs.sparkSession.createDataFrame(rows, "part long, before long"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return (
        ranged.withColumn("part", part)
        .join(starts, "part")
        .select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("eligible") & (place <= drawn), place).alias("rank"))
    )
