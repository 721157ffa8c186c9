"""Nearest vectors by inner product with vantage-point trees.

Inner product is no metric, so every vector gets one more component that makes all of them
equally long; then the nearest by Euclidean distance is the one with the largest inner product.
The vectors are dealt to shards of bounded size, each with a tree of its own: a node has a
vantage point and a radius that parts its vectors into near and far ones, and by the
triangle inequality a side is left out if nothing in it can be among the best. A factor
above one leaves sides out earlier; with factor one the search is exact.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

SHARD_ROWS = 16_384
BLOCK_QUERIES = 2048
LEAF_ROWS = 1024
FACTOR = 1.0
# Rounding of distances; sides are left out only if they are farther by more than this.
SLACK = 1e-9


def _grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree over the rows of x as flat arrays: order of the rows; for each node its rows' range,
    vantage row, radius, and children (-1: leaf)."""
    order = np.arange(len(x))
    nodes = [[0, len(x), -1, 0.0, -1, -1]]
    todo = [0] if len(x) else []
    while todo:
        at = todo.pop()
        a, b = nodes[at][:2]
        if b - a <= LEAF_ROWS:
            continue
        rows = order[a:b]
        vantage = int(rows[rng.integers(b - a)])
        d = np.sqrt(((x[rows] - x[vantage]) ** 2).sum(axis=1))
        radius = float(np.median(d))
        near = d <= radius
        if near.all():
            # Many at the same distance: part the ones nearer than that, if there are any.
            near = d < radius
            if not near.any():
                continue
            radius = float(d[near].max())
        order[a:b] = np.concatenate((rows[near], rows[~near]))
        middle = a + int(near.sum())
        nodes[at][2:] = [vantage, radius, len(nodes), len(nodes) + 1]
        todo += [len(nodes), len(nodes) + 1]
        nodes += [[a, middle, -1, 0.0, -1, -1], [middle, b, -1, 0.0, -1, -1]]
    return {"order": order, "nodes": np.array(nodes)}


def build_tree(ids: np.ndarray, vectors: np.ndarray, longest: float) -> bytes:
    """A shard's tree with its vectors, as bytes. `longest`: no less than any vector's length."""
    v = vectors.astype(np.float64)
    extra = np.sqrt(np.maximum(0.0, longest**2 - (v**2).sum(axis=1)))
    x = np.column_stack((v, extra))
    tree = _grow(x, np.random.default_rng(0))
    out = io.BytesIO()
    order = tree["order"]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    nodes = tree["nodes"]
    inner = nodes[:, 2] >= 0
    nodes[inner, 2] = where[nodes[inner, 2].astype(np.int64)]
    np.savez(out, ids=ids[order], vectors=vectors[order], extra=extra[order], nodes=nodes)
    return out.getvalue()


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of v with q, added up in the order of the components, so that equal
    vectors get equal products wherever they stand."""
    return np.add.accumulate(v * q, axis=1)[:, -1] if len(v) else np.empty(0)


class Search:
    """Searches one shard for a block of queries."""

    def __init__(self, blob: bytes, factor: float):
        with np.load(io.BytesIO(blob)) as t:
            self.ids, self.v, extra = t["ids"], t["vectors"].astype(np.float64), t["extra"]
            self.nodes = t["nodes"].tolist()
        self.x = np.column_stack((self.v, extra))
        self.factor = factor

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(score, id) of the k best by score, then by smaller id."""
        q = query.astype(np.float64)
        best_scores, best_ids = np.empty(0), np.empty(0, np.int64)
        qx, q2 = np.append(q, 0.0), float(q @ q)
        longest2 = float((self.x[0] ** 2).sum()) if len(self.x) else 0.0
        worst = np.inf  # distance of the k-th best so far
        todo = [(0.0, 0)] if len(self.x) else []
        while todo:
            least, at = todo.pop()
            if least * self.factor > worst + SLACK * (1 + worst):
                continue
            a, b, vantage, radius, near, far = self.nodes[at]
            if near < 0:
                a, b = int(a), int(b)
                v, ids = self.v[a:b], self.ids[a:b]
                may = ids != query_id
                if len(best_ids) == k:
                    # A quick product first; what could be among the best is computed again.
                    may &= v @ q >= best_scores[-1] - SLACK * (1 + longest2 + q2)
                scores, ids = _products(v[may], q), ids[may]
                scores, ids = np.concatenate((best_scores, scores)), np.concatenate((best_ids, ids))
                if len(ids) > k:
                    cut_at = np.partition(scores, len(scores) - k)[len(scores) - k]
                    may = scores >= cut_at
                    scores, ids = scores[may], ids[may]
                keep = np.lexsort((ids, -scores))[:k]
                best_scores, best_ids = scores[keep], ids[keep]
                if len(best_ids) == k:
                    worst = np.sqrt(max(0.0, longest2 + q2 - 2 * best_scores[-1]))
                continue
            d = float(np.sqrt(((self.x[int(vantage)] - qx) ** 2).sum()))
            sides = [(max(least, d - radius), int(near)), (max(least, radius - d), int(far))]
            # The nearer side is searched first: it stands last.
            todo += sides[::-1] if d <= radius else sides
        return list(zip(best_scores.tolist(), best_ids.tolist()))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (double) of the vectors that take part, one row per id: id given, vector not
    null, not empty, not zero, all components finite numbers, and as many of them as most vectors
    have (ties: the larger number). Of the usable rows with one id the smallest vector, component by
    component, takes part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    nonzero = F.exists(v, lambda c: c != 0)
    found = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & nonzero, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")
    )
    sizes = found.groupBy(F.size("embedding").alias("size")).count()
    most = sizes.agg(F.max_by("size", F.struct("count", "size"))).first()[0]
    return found.filter(F.size("embedding") == F.lit(most)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n else np.empty((0, 0))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard int, tree binary: one tree per shard over all usable vectors. Ids are dealt by a
    hash, so shards are about equal whatever the data."""
    found = usable(vectors)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c * c))
    n, longest = found.agg(F.count(F.lit(1)), F.max(length)).first()
    shards = max(1, -(-n // shard_rows))
    longest = (longest or 0.0) * (1 + 1e-12)
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")])
        blob = build_tree(table.column("vec_id").to_numpy(), _matrix(table.column("embedding")), longest)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "tree": pa.array([blob], pa.large_binary() if len(blob) >> 31 else pa.binary())})

    return dealt.groupBy("shard").applyInArrow(task, "shard int, tree binary")


def search(
    index: DataFrame, vectors: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable vector whose id is divisible by `every`
    its k nearest of all other ids (all, if there are fewer), best first, ties to the smaller id.

    `score` is the inner product in double precision. Queries go to the shards in blocks; each
    shard gives its k best, and the best of those are the answer. An id asks once and is found
    once, however often it is repeated (see `usable`). Unusable vectors neither ask nor answer, nor do
    those with fewer or more components than most. With factor 1 the answer is exact.
    """
    found = usable(vectors).filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-found.count() // block_queries))
    # A block's queries as one row: a bounded number of vectors. One row per block and shard.
    asked = (
        found.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        .groupBy("block")
        .agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    )
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    spread = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def task(batches):
        for batch in batches:
            out = ([], [], [])
            for blob, queries in zip(batch.column("tree"), batch.column("queries")):
                tree = Search(blob.as_py(), factor)
                inner = queries.values
                ids, vectors = inner.field("vec_id").to_numpy(), _matrix(inner.field("embedding"))
                for query_id, vector in zip(ids.tolist(), vectors):
                    for score, vec_id in tree.nearest(query_id, vector, k):
                        for column, value in zip(out, (query_id, vec_id, score)):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["query_id", "vec_id", "score"])

    # A few large rows: each is a task's work, so they are dealt out one by one.
    work = spread.join(index, "shard").repartition(shards * blocks, "shard", "block").select("tree", "queries")
    hits = work.mapInArrow(task, "query_id long, vec_id long, score double")
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    best = hits.groupBy("query_id").agg(F.slice(order, 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score")
    )


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`search` over a fresh index, which is written to the shared folder first."""
    return search(cut(build_index(vectors, shard_rows), "vp-trees"), vectors, k, every, factor)
