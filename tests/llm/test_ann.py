"""Vector search against brute force."""

import numpy as np
import pytest

from gleanery.llm import ann


def brute(rows, k, every):
    good = []
    for i, v in rows:
        if i is None or v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        good.append((i, np.array(v, np.float32).astype(float)))
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v.tolist(), w.tolist())), i) for i, w in good if i != q)
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]], q
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], rtol=1e-12, atol=1e-15)


SCHEMA = "vec_id long, embedding array<float>, score string, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", None) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_exact(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(400)]
    got = found(ann.nearest(table(spark, rows), 20, 20, 1.0, shard_rows))
    same(got, brute(rows, 20, 20))


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]),
        (20, [0.5, 0.5]),
        (40, None),
        (60, [0.0, 0.0]),
        (80, [float("nan"), 1.0]),
        (100, [None, 1.0]),
        (120, [float("inf"), 1.0]),
        (None, [1.0, 1.0]),
        (7, [1.0, 0.0]),
        (5, [1.0, 0.0]),
        (140, []),
    ]
    got = found(ann.nearest(table(spark, rows)))
    same(got, brute(rows, 20, 20))
    assert [x[1] for x in got[0]] == [5, 7, 20]


def test_empty_and_uneven(spark):
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(1, [1.0])])).count() == 0
    # As many vectors of either length: the longer ones take part. With more short ones, those do.
    assert found(ann.nearest(table(spark, [(0, [1.0]), (20, [1.0, 2.0])]))) == {}
    rows = [(0, [1.0]), (20, [3.0, 2.0]), (1, [2.0]), (2, [0.5, 1.0]), (3, [-1.0])]
    assert found(ann.nearest(table(spark, rows))) == {0: [(1, 1, 2.0), (2, 3, -1.0)]}


def test_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    again = rows[::3] + rows[::20] + [(20, [9.0, 9.0, 9.0, 9.0]), (7, [None, 1.0, 1.0, 1.0])]
    got = found(ann.nearest(table(spark, rows + again), 20, 20, 1.0, 64))
    same(got, brute(rows, 20, 20))
    assert all(len({x[1] for x in v}) == 20 for v in got.values())


def test_factor_trades_recall(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(3000)]
    df = table(spark, rows)
    want = brute(rows, 20, 100)
    got = found(ann.search(ann.build_index(df, 1500), df, 20, 100, 1.2))
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
