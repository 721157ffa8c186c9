"""The latest value per key as keyed state: order, lateness, restarts, expiry."""

import datetime as dt
import random
import time

import pyarrow as pa
import pytest
from conftest import rows

from gleanery.operators import state as st
from gleanery.session import work_dir
from gleanery.streaming import keyed_state as ks

LOG = "partition_key string, key string, value_json string, version int, seq long, ts timestamp"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


class Feed:
    """A folder that entries arrive in, and a stream on it."""

    def __init__(self, spark, **options):
        self.spark, self.out, self.options = spark, work_dir(spark, "keyed"), options

    def arrive(self, entries):
        self.spark.createDataFrame(entries, LOG).coalesce(1).write.mode("append").parquet(f"{self.out}/in")

    def run(self):
        log = self.spark.readStream.schema(LOG).parquet(f"{self.out}/in")
        ks.changes_stream(log, f"{self.out}/changes", f"{self.out}/checkpoint", **self.options).awaitTermination()

    def changes(self):
        found = self.spark.read.parquet(f"{self.out}/changes")
        return sorted((r.batch_id, r.partition_key, r.key, r.value_json, r.change) for r in found.collect())

    def state(self):
        return rows(ks.stored_state(self.spark, f"{self.out}/checkpoint"))


def test_late_entries_over_a_restart(spark):
    feed = Feed(spark)
    feed.arrive([("p", "a", "1", 1, 10, at(10)), ("p", "b", "null", 1, 5, at(5)), ("q", "a", "7", 1, None, None)])
    feed.run()
    # Older than what is there, the same again, newer, and a key of its own.
    feed.arrive([("p", "a", "0", 9, 9, at(9)), ("p", "b", "null", 1, 5, at(5)), ("q", "a", "8", 1, 0, at(0)), ("q", "c", "1", None, 1, at(1))])
    feed.run()
    feed.arrive([("p", "a", "2", 1, 11, at(11)), ("p", "a", "3", 1, 10, at(99))])
    feed.run()
    assert feed.changes() == [
        (0, "p", "a", "1", "stored"), (0, "p", "b", "null", "stored"), (0, "q", "a", "7", "stored"),
        (1, "q", "a", "8", "stored"), (1, "q", "c", "1", "stored"),
        (2, "p", "a", "2", "stored"),
    ]
    assert feed.state() == rows(
        spark.createDataFrame(
            [("p", "a", "2", 1, 11), ("p", "b", "null", 1, 5), ("q", "a", "8", 1, 0), ("q", "c", "1", None, 1)],
            "partition_key string, key string, value_json string, version int, seq long",
        )
    )


def test_any_order_gives_the_latest(spark):
    rng = random.Random(5)
    entries = [
        (rng.choice(["p", "q", None]), rng.choice(["a", "b", "c", None]), str(i % 7), rng.choice([1, 2, None]), i, at(i)) for i in range(300)
    ]
    # A third of all rows are of one key.
    entries += [("hot", "hot", str(i), 1, i, at(i)) for i in range(150)]
    want = rows(st.state_latest(spark.createDataFrame(entries, LOG)))
    for seed in (1, 2):
        feed = Feed(spark)
        random.Random(seed).shuffle(entries)
        for part in (0, 1):
            feed.arrive(entries[part::2])
            feed.run()
        assert [r[:4] for r in feed.state()] == want


def test_idle_keys_expire(spark):
    feed = Feed(spark, idle_seconds=60, event_time="ts", lateness="10 seconds")
    feed.arrive([("p", "a", "1", 1, 1, at(0)), ("p", "b", "1", 1, 1, at(0))])
    feed.run()
    # An older entry of b changes nothing but keeps it in use.
    feed.arrive([("p", "b", "0", 1, 0, at(65)), ("p", "c", "1", 1, 1, at(71))])
    feed.run()
    assert [c[1:] for c in feed.changes() if c[4] == "expired"] == [("p", "a", "1", "expired")]
    assert [r[1] for r in feed.state()] == ["b", "c"]
    feed.arrive([("p", "a", "2", 1, 2, at(150))])
    feed.run()
    assert [r[:3] for r in feed.state()] == [("p", "a", "2")]


def test_initial_state(spark):
    seed = spark.createDataFrame([("p", "a", "5", 1, 5), ("p", "z", "9", 1, 9)], "partition_key string, key string, value_json string, version int, seq long")
    feed = Feed(spark, initial=seed)
    feed.arrive([("p", "a", "4", 1, 4, at(4)), ("p", "b", "1", 1, 1, at(1))])
    feed.run()
    assert [c[1:4] for c in feed.changes()] == [("p", "b", "1")]
    assert [r[:3] for r in feed.state()] == [("p", "a", "5"), ("p", "b", "1"), ("p", "z", "9")]


def test_options(spark):
    log = spark.createDataFrame([], LOG)
    with pytest.raises(ValueError):
        ks.keyed_changes(log, idle_seconds=1)
    with pytest.raises(ValueError):
        ks.keyed_changes(log, idle_seconds=1, ttl_seconds=1, event_time="ts")


def test_time_to_live(spark):
    feed = Feed(spark, ttl_seconds=0.001, available_now=False)
    feed.arrive([("p", "a", "5", 1, 5, at(5))])
    log = spark.readStream.schema(LOG).parquet(f"{feed.out}/in")
    query = ks.changes_stream(log, f"{feed.out}/changes", f"{feed.out}/checkpoint", **feed.options)
    try:
        # What is forgotten can be stored anew, whatever its seq.
        for value, entry in ((["5"], ("p", "a", "4", 1, 4, at(4))), (["4", "5"], None)):
            end = time.time() + 60
            while time.time() < end and seen(feed) != value:
                time.sleep(0.5)
            assert seen(feed) == value
            if entry:
                feed.arrive([entry])
    finally:
        query.stop()
    with pytest.raises(ValueError):
        ks.changes_stream(log, "x", "y", ttl_seconds=1)


def seen(feed):
    try:
        return sorted(c[3] for c in feed.changes())
    except Exception:  # noqa: BLE001  nothing is there yet, or a batch is being written
        return None


def test_fold_sends_a_row_per_key():
    names = [c.split()[0] for c in ks._ROWS.split(", ")]
    data = [("p", "a", "1", 1, 1, 5), ("p", "a", "2", 1, 3, 4), ("p", "a", "3", 1, None, 9), (None, "a", "1", 1, 1, None), (None, None, "1", 1, 1, 1)]
    data += [("p", None, "x", None, 1, 1), ("p", "a", "0", 7, 3, 1), ("p", None, "x", 2, 1, 1)]
    schema = pa.schema([(n, pa.string() if n in ("partition_key", "key", "value_json") else pa.int64()) for n in names])
    batch = pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in data], schema)
    out = [tuple(r.values()) for b in ks._fold([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert sorted(out, key=repr) == sorted(
        [("p", "a", "2", 1, 3, 9), (None, "a", "1", 1, 1, None), (None, None, "1", 1, 1, 1), ("p", None, "x", 2, 1, 1)], key=repr
    )
