"""Look-ups in sorted runs: what counts, what is read, what is folded."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanery.operators import runs
from gleanery.session import work_dir

SCHEMA = "p string, k string, value string, seq long"


def table(spark, **options):
    return runs.KeyRuns(spark, work_dir(spark, "runs"), SCHEMA, ["p", "k"], "seq", **({"buckets": 4} | options))


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def ask(spark, *keys):
    return spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "n int, p string, k string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_runs(spark):
    t = table(spark)
    assert rows(t.get(ask(spark, ("a", "b")))) == [(0, "a", "b", False, None, None)]
    assert t.read().count() == 0


def test_what_counts(spark):
    t = table(spark)
    t.store(frame(spark, [("a", "x", "1", 5), ("a", "x", "0", 4), ("a", None, "n", None), ("1:a", "", "e", 1), ("a", "y", "old", 2)]), 0)
    # Later by seq although in an earlier batch; the later batch if equal; null seq below all.
    t.store(frame(spark, [("a", "x", "2", 4), ("a", "y", "new", 2), ("a", None, "m", None), (None, None, "z", 0)]), 1)
    asked = ask(spark, ("a", "x"), ("a", "x"), ("a", "y"), ("a", None), (None, None), ("1:a", ""), ("1", ":a"), (None, "a"))
    want = ["1", "1", "new", "m", "z", "e", None, None]
    for few in (500, 0):
        runs.FEW, before = few, runs.FEW
        try:
            got = rows(t.get(asked), "n", "value", "found")
        finally:
            runs.FEW = before
        assert got == [(i, w, w is not None) for i, w in enumerate(want)]


@pytest.mark.parametrize("fanout", [2, 4])
def test_batches_in_any_number(spark, fanout):
    rng = random.Random(fanout)
    t, best = table(spark, fanout=fanout), {}
    for batch in range(6):
        data = [(rng.choice("ab"), str(rng.randint(0, 9)), f"{batch}.{i}", batch * 100 + i) for i in range(20)]
        t.store(frame(spark, data), batch)
        best |= {(p, k): v for p, k, v, _ in data}
    assert rows(t.read(), "p", "k", "value") == sorted((p, k, v) for (p, k), v in best.items())
    asked = [(p, str(k)) for p in "abc" for k in range(10)]
    assert rows(t.get(ask(spark, *asked)), "p", "k", "value") == sorted(((p, k, best.get((p, k))) for p, k in asked), key=repr)
    # 6 batches: 4 + 2 in binary steps, or 4 + 1 + 1.
    assert len(t._runs()) == {2: 2, 4: 3}[fanout]


def test_a_batch_again(spark):
    t = table(spark)
    t.store(frame(spark, [("a", "x", "1", 1), ("a", "y", "1", 1)]), 0)
    t.store(frame(spark, [("a", "x", "2", 1)]), 0)
    assert rows(t.read(), "k", "value") == [("x", "2")]


def test_the_table_stays_where_it_is(spark, monkeypatch):
    t = table(spark, buckets=16)
    t.store(frame(spark, [("a", str(i), f"v{i}", i) for i in range(2000)]), 0)
    # Few keys: their buckets alone are read.
    text = plan(t.get(ask(spark, ("a", "7"), ("a", "8"))))
    assert "SelectedBucketsCount: 2 out of 16" in text or "SelectedBucketsCount: 1 out of 16" in text
    # Many keys: no exchange between the table's scan and the join; the keys come to its buckets.
    monkeypatch.setattr(runs, "FEW", 0)
    many = t.get(ask(spark, *[("a", str(i)) for i in range(0, 2000, 2)]))
    lines = plan(many).splitlines()
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "LeftSemi" in line)
    scan = next(i for i in range(at, len(lines)) if "FileScan parquet" in lines[i])
    assert "Bucketed: true" in lines[scan]
    assert not any("Exchange" in line for line in lines[at:scan])
    assert many.filter("found").count() == 1000


def test_clashing_requests(spark):
    t = table(spark)
    t.store(frame(spark, [("a", "x", "1", 1)]), 0)
    with pytest.raises(ValueError):
        t.get(ask(spark, ("a", "x")).withColumn("value", F.lit(1)))
