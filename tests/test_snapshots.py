"""Snapshots compared by digests: the same result as the plain comparison, and what they read."""

import random

import pytest

from gleanery.operators import snapshots
from gleanery.operators.diff import snapshot_diff
from gleanery.operators.snapshots import Snapshots
from gleanery.sources import commits

SCHEMA = "part string, key string, value_json string"


def table(spark, state):
    return spark.createDataFrame([(*k, v) for k, v in state.items()], SCHEMA)


def rows(df):
    return sorted(map(str, df.select("part", "key", "kind", "value_json").collect()))


def rows_scanned(df):
    """Rows that the scans of a collected DataFrame gave out."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        return sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def changed(state, rng, share):
    out = dict(state)
    for k in rng.sample(sorted(state), int(len(state) * share)):
        what = rng.random()
        if what < 0.3:
            del out[k]
        elif what < 0.6:
            out[k] = rng.choice(["9", None, '"x"'])
        else:
            out[(k[0], k[1] + "n")] = "1"
    return out


@pytest.mark.parametrize("share,few", [(0.0, 500), (0.01, 500), (0.5, 500), (0.5, 3), (1.0, 0)])
def test_equals_the_plain_comparison(spark, tmp_path, monkeypatch, share, few):
    monkeypatch.setattr(snapshots, "FEW", few)
    rng = random.Random(share)
    old = {(rng.choice("ab"), str(i)): rng.choice(["1", "2", None, "{}", ""]) for i in range(400)}
    new = changed(old, rng, share)
    s = Snapshots(spark, str(tmp_path), SCHEMA, ["part", "key"], 4, 8)
    s.store(table(spark, old), 0)
    s.store(table(spark, new), 1)
    want = snapshot_diff(table(spark, old), table(spark, new), ["part", "key"])
    assert rows(s.diff(0, 1)) == rows(want)
    assert rows(s.diff(0, 1, unchanged=False)) == rows(want.filter("kind <> 'unchanged'"))


def test_null_keys_and_empty_snapshots(spark, tmp_path):
    with_null = spark.createDataFrame([(None, "a", "1"), ("p", None, "2"), ("p", "a", "3")] + [(None, None, "4")] * 50, SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    s = Snapshots(spark, str(tmp_path), SCHEMA, ["part", "key"], 2, 2)
    sides = [with_null, none, with_null]
    for i, side in enumerate(sides):
        s.store(side, i)
    for a, b in ((0, 1), (1, 0), (0, 2), (1, 1)):
        assert rows(s.diff(a, b)) == rows(snapshot_diff(sides[a], sides[b], ["part", "key"]))


def test_what_is_alike_is_not_read(spark, tmp_path):
    old = {("p", str(i)): str(i) for i in range(4000)}
    s = Snapshots(spark, str(tmp_path), SCHEMA, ["part", "key"], 16, 16)
    s.store(table(spark, old), 0)
    s.store(table(spark, old | {("p", "7"): "new"}), 1)
    s.store(table(spark, {k: v + "0" for k, v in old.items()}), 2)
    s.store(table(spark, old), 3)
    assert rows_scanned(s.diff(0, 3, unchanged=False)) == 0
    # One leaf of 256 differs: its folder alone is read, on both sides.
    assert 2 <= rows_scanned(s.diff(0, 1, unchanged=False)) <= 2 * 4000 / 16 * 2
    assert rows_scanned(s.diff(0, 2, unchanged=False)) == 8000


def test_a_batch_counts_from_its_commit(spark, tmp_path, monkeypatch):
    s = Snapshots(spark, str(tmp_path), SCHEMA, ["part", "key"], 2, 2)
    s.store(table(spark, {("p", "a"): "1"}), 0)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lost)
        with pytest.raises(RuntimeError):
            s.store(table(spark, {("p", "b"): "2"}), 0)
    assert [r.key for r in s.read(0).collect()] == ["a"]
    s.store(table(spark, {("p", "b"): "2"}), 0)
    assert [r.key for r in s.read(0).collect()] == ["b"]
    with pytest.raises(ValueError):
        s.read(5)
