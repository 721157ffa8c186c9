"""Batches count from their commit on, and as a whole."""

import os
import time

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleanery.functions import metadata
from gleanery.operators import items as it
from gleanery.plans.indexing import write_stores
from gleanery.plans.registry import Registry
from gleanery.session import work_dir
from gleanery.sources import commits, tables


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def failing(spark):
    """Some tasks write all of their rows, another one fails after a while."""
    n = F.col("id")
    late = F.when(n < 900_000, n).otherwise(F.raise_error(F.lit("lost")).cast("long"))
    return spark.range(0, 1_000_000, 1, 8).select(late.alias("n"))


def test_a_batch_that_fails_is_not_seen(spark):
    root = work_dir(spark, "t")
    assert tables.read_batches(spark, root, "n long").count() == 0
    with pytest.raises(PySparkException):
        tables.append_batch(failing(spark), root, 1)
    assert tables.read_batches(spark, root, "n long").count() == 0
    tables.append_batch(frame(spark, 1, 2), root, 1)
    with pytest.raises(PySparkException):
        tables.append_batch(failing(spark), root, 1)
    assert rows(tables.read_batches(spark, root), "n", "batch_id", "writer") == [(1, 1, "w-main"), (2, 1, "w-main")]
    tables.append_batch(frame(spark, 3), root, 1)
    assert rows(tables.read_batches(spark, root), "n") == [(3,)]


def test_killed_between_tasks_and_commit(spark, monkeypatch):
    root = work_dir(spark, "t")
    tables.append_batch(frame(spark, 1), root, 7)
    reader = tables.read_batches(spark, root)

    def killed(*args):
        raise KeyboardInterrupt

    # All tasks have written and nobody is left to commit, or to clear up.
    with monkeypatch.context() as m:
        m.setattr(tables, "commit", killed)
        m.setattr(tables, "abort", lambda *a: None)
        with pytest.raises(KeyboardInterrupt):
            tables.append_batch(frame(spark, 2, 3), root, 7)
    assert rows(tables.read_batches(spark, root), "n") == [(1,)]
    tables.append_batch(frame(spark, 4, 5), root, 7)
    # Who began before goes on with what was there then.
    assert rows(reader, "n") == [(1,)]
    assert rows(tables.read_batches(spark, root), "n") == [(4,), (5,)]


def test_readers_see_old_or_new(spark, monkeypatch):
    """At every step of a commit a reader finds exactly one whole batch."""
    root = work_dir(spark, "t")
    tables.append_batch(frame(spark, 1), root, 0)
    seen = []
    real = commits._folder

    def watched(s, path):
        monkeypatch.setattr(commits, "_folder", real)
        seen.append(rows(tables.read_batches(spark, root), "n"))
        monkeypatch.setattr(commits, "_folder", watched)
        return real(s, path)

    monkeypatch.setattr(commits, "_folder", watched)
    tables.append_batch(frame(spark, 2), root, 0)
    monkeypatch.setattr(commits, "_folder", real)
    assert len(seen) >= 2 and set(map(tuple, seen)) == {((1,),)}
    assert rows(tables.read_batches(spark, root), "n") == [(2,)]


def test_two_drivers_at_once(spark):
    root = work_dir(spark, "t")
    pair = [commits.new_attempt(root, 1, "main") for _ in range(2)]
    for i, a in enumerate(pair):
        frame(spark, i).write.parquet(a.path)
    # Both found no earlier commit.
    os.makedirs(f"{root}/{commits.COMMITS}")
    for a in pair:
        open(f"{root}/{commits.COMMITS}/main,1,1,{a.name}", "w").close()
    assert len(commits.committed(spark, root)) == 1
    assert tables.read_batches(spark, root).count() == 1


def test_vacuum(spark):
    root = work_dir(spark, "t")
    for n in (1, 2, 3):
        tables.append_batch(frame(spark, n), root, 0)
    tables.append_batch(frame(spark, 9), root, 0, writer="other")
    frame(spark, 5).write.parquet(commits.new_attempt(root, 4, "main").path)
    assert commits.vacuum(spark, root) == 0
    time.sleep(0.1)
    assert commits.vacuum(spark, root, 0) == 3
    assert rows(tables.read_batches(spark, root), "n") == [(3,), (9,)]
    assert len(os.listdir(f"{root}/{commits.COMMITS}")) - sum(f.endswith(".crc") for f in os.listdir(f"{root}/{commits.COMMITS}")) == 2


def test_partitioned_batches_keep_their_types(spark):
    root = work_dir(spark, "t")
    df = spark.createDataFrame([("1", 1), ("2", 2), (None, 3)], "p string, n long")
    tables.append_batch(df, root, 3, "p")
    tables.append_batch(df.filter("n > 5"), root, 4, "p")
    got = tables.read_batches(spark, root, "p string, n long")
    assert rows(got, "p", "n", "batch_id") == [("1", 1, 3), ("2", 2, 3), (None, 3, 3)]
    with pytest.raises(ValueError):
        tables.append_batch(df, root, 1, writer="a,b")


def test_items_of_a_batch_that_fails(spark):
    table = it.ItemsTable(spark, work_dir(spark, "items"))
    df = spark.createDataFrame([("i1", 1, "u", "h", "string")], "item_id string, insert_seq long, source_url string, content_hash string, content_type string")
    table.append(metadata.with_defaults(df), 1)
    broken = metadata.with_defaults(df).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException):
        table.append(broken, 1)
    assert rows(table.read(), "item_id", "title") == [("i1", None)]


class Failing:
    def __init__(self, calls):
        self.calls = calls

    def write(self, items, batch_id):
        raise RuntimeError("full")

    commit = abort = None


def test_stores_commit_together(spark):
    one, two = (commits.ParquetStore(spark, work_dir(spark, "store")) for _ in range(2))
    write_stores(frame(spark, 1), 1, {"one": one, "two": two})
    assert rows(one.read(), "n") == rows(two.read(), "n") == [(1,)]
    called = []
    with pytest.raises(RuntimeError):
        write_stores(frame(spark, 2), 1, {"one": one, "fn": lambda df, batch: called.append(batch), "bad": Failing([])})
    assert called == [1]
    # The first one wrote and aborted: nothing of it is left.
    assert rows(one.read(), "n") == [(1,)]
    assert len(commits.committed(spark, one.root)) == 1
    assert len([f for f in os.listdir(f"{one.root}/writer=w-store/batch_id=1") if f.startswith("attempt")]) == 1
    write_stores(frame(spark, 2), 1, {"one": one, "two": two})
    assert rows(one.read(), "n") == rows(two.read(), "n") == [(2,)]


def test_register_store():
    registry = Registry().register_store("fn", lambda items, batch: None).register_store("kept", Failing([]))
    with pytest.raises(TypeError):
        registry.register_store("none", object())
