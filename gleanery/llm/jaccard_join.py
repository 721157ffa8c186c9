"""Near duplicates: sets of word shingles with a Jaccard similarity of at least 0.75.

All shingles are counted over the whole corpus. A shingle of one document alone links
nothing, so a document goes on as its size and its shared shingles, the rarest first. Two
linked documents share a shingle among the first few of each, as many as could be missing
from the intersection, plus one; and two shingles if each looks at one more. The
join is size-aware: small sets enumerate all pairs of those first shingles (subsets of fixed
size two) and meet in equal pairs, large sets meet in the inverted lists of single ones.
Where small ends is chosen from what both ways would cost. Every link found is exact: it is
checked on the shared shingles of both.

Only what is connected is asked for, so the documents of a list are first compared with one
of them. Then only those not yet connected are compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import components
from .common import cut, rows_of, with_digest
from .postings import coarse, repeated
from .words import Words, chunks, mix

SHINGLE = 5
PERCENT = 75
# A shingle that so many documents of one chunk hold counts as frequent.
OFTEN_DOCS = 32
LARGEST_BUCKET = 40


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles with their texts' places, the sets' sizes, and the sets' own hashes."""
    words = Words(texts, lower=True)
    hashes, at = words.runs(size)
    doc = words.doc[at]
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    hashes, doc = np.concatenate((hashes, words.whole(size)[few])), np.concatenate((doc, few))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    own = mix(n.astype(np.uint64) + np.uint64(size))
    edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
    if len(edge):
        own[doc[edge]] += np.add.reduceat(mix(hashes ^ own[doc]), edge)
    return hashes, doc, n, mix(own)


def needed(n, percent: int = PERCENT):
    """The least intersection of a set of n with any set it is linked to."""
    return -(-n * percent // 100)


def _sets(size):
    def task(batches):
        for doc_ids, texts in chunks(batches):
            _, _, n, own = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(n), pa.array(own.view(np.int64))], ["doc_id", "n_shingles", "key"]
            )

    return task


def _postings(size):
    def postings(batches):
        for (texts,) in chunks(batches):
            hashes, doc, n, own = shingle_sets(texts, size)
            # Equal sets are one document here.
            keys, first = np.unique(own, return_index=True)
            keep = np.isin(doc, first)
            hashes, doc = hashes[keep], doc[keep]
            yield coarse(hashes), np.searchsorted(keys, own[doc]), n[first], keys

    return postings


def _records(percent):
    """Documents with their shared shingles, frequent ones last, if those can link them at all."""

    def gather(found: np.ndarray) -> pa.Table:
        found = found[np.lexsort((found["hash"], found["count"], found["key"]))]
        edge = np.flatnonzero(np.concatenate(([True], found["key"][1:] != found["key"][:-1]))) if len(found) else np.empty(0, np.int64)
        stop = np.append(edge[1:], len(found)).astype(np.int64)
        n = found["number"][edge].astype(np.int64)
        # What no other document has cannot be in an intersection.
        may = stop - edge >= needed(n, percent)
        edge, stop, n = edge[may], stop[may], n[may]
        return pa.table(
            {
                "key": pa.array(found["key"][edge].view(np.int64), pa.int64()),
                "n": pa.array(n, pa.int64()),
                "shared": pa.array([found["hash"][a:b].tobytes() for a, b in zip(edge, stop)], pa.binary()),
                "counts": pa.array([found["count"][a:b].tobytes() for a, b in zip(edge, stop)], pa.binary()),
            }
        )

    return gather


def _firsts(n: int, shared: int, more: int, percent: int) -> int:
    """How many of the shared shingles are among those to look at, if `more` have to be met."""
    alone = n - shared
    return max(0, min(shared, n - int(needed(n, percent)) + more - alone))


def choose_boundary(records: DataFrame, percent: int = PERCENT) -> int:
    """The size up to which sets enumerate pairs: where the sum of both costs is least.

    A set's cost as a small one is its number of pairs, and as a large one the number of its
    first shingles and the documents in their lists. Both are summed by size over all records; sizes
    above LARGEST_BUCKET are one sum, as pairs grow with the square of the size.
    """

    def task(batches):
        for batch in batches:
            sizes, pairs, scans = [], [], []
            for n, shared, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "shared", "counts"))):
                held = len(shared) // 8
                two, one = _firsts(n, held, 2, percent), _firsts(n, held, 1, percent)
                met = np.minimum(np.frombuffer(counts, "<u4")[:one], 1 << 20).astype(np.int64)
                sizes.append(min(n, LARGEST_BUCKET + 1))
                pairs.append(two * (two - 1) // 2)
                scans.append(int(met.sum()) + one)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sizes, pairs, scans)], ["n", "pairs", "scans"])

    costs = records.select("n", "shared", "counts").mapInArrow(task, "n long, pairs long, scans long")
    found = {r[0]: (r[1], r[2]) for r in costs.groupBy("n").agg(F.sum("pairs"), F.sum("scans")).collect()}
    best = (None, 1)
    for x in range(1, LARGEST_BUCKET + 1):
        reach = x * 100 // percent
        cost = sum(p for n, (p, _) in found.items() if n <= reach) + sum(s for n, (_, s) in found.items() if n > x)
        if best[0] is None or cost < best[0]:
            best = (cost, x)
    return best[1]


def _probes(records: DataFrame, boundary: int, percent: int) -> DataFrame:
    """probe, key, n, after, alone: what documents meet in, how many shared shingles there are from
    there on, and how many are the document's alone.

    Sets up to the boundary meet all they are linked to in pairs, so sets as large as those can be
    linked to enumerate pairs too. Linked sets above the boundary meet in single shingles.
    """
    reach = boundary * 100 // percent

    def task(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for key, n, shared in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "shared"))):
                h = np.frombuffer(shared, "<u8")
                probes, after = [], []
                if n > boundary:
                    m = _firsts(n, len(h), 1, percent)
                    probes.append(mix(h[:m] + np.uint64(1)))
                    after.append(1 + len(h) - 1 - np.arange(m))
                if n <= reach:
                    m = _firsts(n, len(h), 2, percent)
                    i, j = np.triu_indices(m, 1)
                    probes.append(mix(mix(h[i] + np.uint64(2)) + h[j]))
                    # The pair's first one may have others before the second.
                    after.append(len(h) - i)
                probes, after = np.concatenate(probes), np.concatenate(after)
                out[0].append(probes.view(np.int64))
                out[1].append(np.full(len(probes), key, np.int64))
                out[2].append(np.full(len(probes), n, np.int64))
                out[3].append(after.astype(np.int64))
                out[4].append(np.full(len(probes), n - len(h), np.int64))
            if out[0]:
                names = ["probe", "key", "n", "after", "alone"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return records.select("key", "n", "shared").mapInArrow(task, "probe long, key long, n long, after long, alone long")


def _verified(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links, by their whole intersections."""

    def side(name):
        return records.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("shared").alias(f"s_{name}"))

    def task(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "s_a", "s_b")))
            kept_a, kept_b = [], []
            for a, b, n_a, n_b, s_a, s_b in rows:
                both = len(np.intersect1d(np.frombuffer(s_a, "<u8"), np.frombuffer(s_b, "<u8"), assume_unique=True))
                if 100 * both >= percent * (n_a + n_b - both):
                    kept_a.append(a)
                    kept_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], ["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(task, "a long, b long")


def _links(records: DataFrame, percent: int) -> DataFrame:
    """node, root: documents that are linked to others, with their component."""
    boundary = choose_boundary(records, percent)
    probes = cut(_probes(records, boundary, percent), "probes")
    # At the first shingle that two linked sets share, so many must be left in both.
    enough = lambda x, y, n, m: F.least(x, y) * (100 + percent) >= (F.col(n) + F.col(m)) * percent
    # One of each list stands for it, the one with the fewest shingles of its own: of documents with
    # the same shared shingles, whatever is linked to any of them is linked to that one.
    best = F.min(F.struct("alone", "n", "key", "after"))
    heads = probes.groupBy("probe").agg(best.alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    heads = cut(
        heads.select("probe", *[F.col(f"head.{c}").alias(h) for c, h in (("n", "head_n"), ("key", "head"), ("after", "head_after"))]),
        "heads",
    )
    fits = F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * percent
    stars = probes.join(heads, "probe").filter(
        fits & (F.col("key") != F.col("head")) & enough("after", "head_after", "n", "head_n")
    )
    stars = stars.select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    links = cut(_verified(stars, records, percent), "links")
    roots = cut(components(links), "roots")
    # What is left: documents of a list that are not connected yet.
    labelled = probes.join(heads.select("probe"), "probe").join(
        roots.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("root", F.coalesce("root", "key"))
    mixed = labelled.groupBy("probe").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("probe")
    left = cut(labelled.join(cut(mixed, "mixed"), "probe"), "unconnected")
    one = left.select("probe", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("after").alias("after_a"), F.col("root").alias("root_a"))
    two = left.select("probe", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("after").alias("after_b"), F.col("root").alias("root_b"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    rest = one.join(two, "probe").filter(
        (F.col("a") < F.col("b"))
        & (F.col("root_a") != F.col("root_b"))
        & (small * 100 >= large * percent)
        & enough("after_a", "after_b", "n_a", "n_b")
    )
    more = cut(_verified(rest.select("a", "b").distinct(), records, percent), "more-links")
    if not more.head(1):
        return roots
    return components(links.unionByName(more))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, set_hash: one row per row of `docs`.

    Words are runs of characters other than blank and \\x09-\\x0D, with A-Z in lower case; a
    document's set has its distinct runs of `shingle` words, or all its words as one if it has
    fewer. Two documents are linked if 100 * intersection >= `percent` * union. `component_id` is the
    smallest doc_id that links lead to (null ids are left out unless there is no other).
    Documents without words (null and empty texts) have no shingles and are linked with nothing.
    Rows with the same id are documents of their own. Shingles are told apart by 48-bit hashes, so
    that two sets of 1,000 shingles each appear to share one that they do not once in 280 million pairs.
    """
    table = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sets = cut(table.mapInArrow(_sets(shingle), "doc_id long, n_shingles long, key long"), "sets")
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    records = cut(
        repeated(
            table.select("text"),
            _postings(shingle),
            _records(percent),
            "key long, n long, shared binary, counts binary",
            total,
            OFTEN_DOCS,
            of_document=True,
        ),
        "records",
    )
    roots = cut(_links(records, percent), "components")
    joined = sets.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    joined = cut(joined.select("doc_id", "n_shingles", "root", "key"), "rooted")
    ids = cut(joined.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    out = ["doc_id", "n_shingles", "component_id", F.col("key").alias("set_hash")]
    linked = joined.filter("n_shingles > 0").join(ids, "root").select(*out)
    return linked.unionByName(joined.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*out))


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all their columns, less those linked, directly or over others, to
    a row with a smaller doc_id: one of each group stays, and so does all that has no words."""

    def digests(texts):
        out = []
        for (part,) in chunks([pa.record_batch({"text": pa.array(texts, pa.string())})]):
            out += shingle_sets(part, shingle)[3].view(np.int64).tolist()
        return out

    found = cut(near_duplicates(docs.select("doc_id", "text"), shingle, percent), "near")
    some = F.col("n_shingles") > 0
    # A set belongs to one component, so the component's first row is found by its id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", F.col("set_hash").alias("digest")))
    group = F.when(F.col("component_id").isNull(), F.col("set_hash"))
    winners = found.filter(some).groupBy("component_id", group).agg(first.alias("w")).select("w.doc_id", "w.digest")
    rest = found.filter(~some).select("doc_id", F.col("set_hash").alias("digest")).distinct()
    return rows_of(with_digest(docs, digests, T.LongType()), cut(winners.unionByName(rest), "winners"))
