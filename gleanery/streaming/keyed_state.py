"""The latest value per key, kept in the stream itself.

Each key has one value state and, if idle keys are to go, one event-time timer. A batch looks up the
keys it brings and no others, and only what changed comes out, so neither a log nor a view has to be folded.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.state import KEYS
from ..sources.tables import append_batch
from .streams import run, setting, writer_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORED, EXPIRED = "stored", "expired"
CHANGES = "partition_key string, key string, value_json string, version int, seq long, change string"
_STATE = "value_json string, version int, seq long, at long"
_ROWS = f"partition_key string, key string, {_STATE}"


def _rank(row) -> tuple:
    """What decides between two entries of a key, null being less than all else."""
    return tuple((x is not None, x if x is not None else 0) for x in (row[2], row[0], row[1]))


class Latest(StatefulProcessor):
    """Keeps the entry with the greatest (seq, value_json, version), whenever it comes. That order is total, so entries
    that are repeated, late or in any order lead to the same state."""

    def __init__(self, ttl_ms: int | None = None, idle_ms: int | None = None):
        self.ttl_ms, self.idle_ms = ttl_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("latest", _STATE, self.ttl_ms)

    def _keep(self, found: tuple) -> None:
        self.value.update(found)
        if self.idle_ms is not None and found[3] is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(found[3] + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.value.get()) if self.value.exists() else None
        best, latest_at = held, held[3] if held else None
        for r in rows:
            entry = (r.value_json, r.version, r.seq, r.at)
            if entry[3] is not None:
                latest_at = entry[3] if latest_at is None else max(latest_at, entry[3])
            if best is None or _rank(entry) > _rank(best):
                best = entry
        # An entry that changes nothing still shows that its key is in use.
        best = (*best[:3], latest_at)
        if best != held:
            self._keep(best)
        if held is None or best[:3] != held[:3]:
            yield Row(partition_key=key[0], key=key[1], value_json=best[0], version=best[1], seq=best[2], change=STORED)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep((initialState.value_json, initialState.version, initialState.seq, initialState.at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.value.get() if self.value.exists() else None
        self.value.clear()
        if held is not None:
            yield Row(partition_key=key[0], key=key[1], value_json=held[0], version=held[1], seq=held[2], change=EXPIRED)

    def close(self) -> None:
        pass


def _fold(batches):
    """The greatest entry of each key within a batch of rows, and the last time of that key: what a hot key sends is a
    row per batch of rows."""
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    order = [(c, "ascending") for c in KEYS] + [(c, "descending") for c in ("seq", "value_json", "version")]
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(columns)
        if not table.num_rows:
            continue
        last = table.group_by(KEYS).aggregate([("at", "max")])
        # Nulls come last in both directions: least when descending.
        table = table.sort_by(order).combine_chunks()
        first = None
        for c in KEYS:
            values = table.column(c)
            a, b = values.slice(1), values.slice(0, len(values) - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            first = differs if first is None else pc.or_(first, differs)
        keep = pa.concat_arrays([pa.array([True]), *pa.chunked_array(first).chunks])
        best = table.filter(keep).to_pylist()
        at = {(r[KEYS[0]], r[KEYS[1]]): r["at_max"] for r in last.to_pylist()}
        rows = [r | {"at": at[r[KEYS[0]], r[KEYS[1]]]} for r in best]
        yield pa.RecordBatch.from_pylist(rows, table.schema)


def _entries(log: DataFrame, event_time: str | None) -> DataFrame:
    at = F.unix_millis(F.col(event_time)) if event_time else F.lit(None).cast("long")
    version = F.col("version") if "version" in log.columns else F.lit(1)
    # A row without a key is a key of its own: the null one.
    return log.select(*KEYS, "value_json", version.cast("int").alias("version"), F.col("seq").cast("long").alias("seq"), at.alias("at"))


def keyed_changes(
    log: DataFrame,
    ttl_seconds: float | None = None,
    idle_seconds: float | None = None,
    event_time: str | None = None,
    lateness: str = "0 seconds",
    initial: DataFrame | None = None,
) -> DataFrame:
    """The changes (partition_key, key, value_json, version, seq, change) that a stream of log entries makes.

    The entry with the greatest seq is a key's value, so an entry that comes late changes nothing if a later one is
    there. Keys untouched for `ttl_seconds` of wall-clock time are forgotten silently; keys without an entry for
    `idle_seconds` of event time (column `event_time`, a timestamp) come out once more as expired. Then entries
    that are later than `lateness` are left out, as with every watermark. `initial` has the state to begin
    with, such as `StateTable.latest()` of a log so far, and a column seq.
    """
    if idle_seconds is not None and (event_time is None or ttl_seconds is not None):
        raise ValueError("idle_seconds needs event_time, and cannot go with ttl_seconds")
    mode = "eventTime" if idle_seconds is not None else "processingTime" if ttl_seconds is not None else "none"
    processor = Latest(_ms(ttl_seconds), _ms(idle_seconds))
    if idle_seconds is not None:
        # The watermark's column has to reach the operator as it is, so rows are not folded before it.
        rows = log.withWatermark(event_time, lateness)
        rows = rows.select(*_entries(rows, event_time).columns[:-1], F.unix_millis(event_time).alias("at"), F.col(event_time).alias("__t"))
    else:
        rows = _entries(log, event_time).mapInArrow(_fold, _ROWS)
    seeded = _entries(initial, event_time).groupBy(*KEYS) if initial is not None else None
    return rows.groupBy(*KEYS).transformWithState(processor, CHANGES, "Update", mode, seeded)


def _ms(seconds: float | None) -> int | None:
    return None if seconds is None else int(seconds * 1000)


def changes_stream(log: DataFrame, root: str, checkpoint: str, available_now: bool = True, name=None, **options) -> StreamingQuery:
    """Stores what changes, batch by batch. `options` are those of `keyed_changes`. With `ttl_seconds` the clock alone
    makes batches, so such a stream has no end and `available_now` has to be False."""
    if available_now and options.get("ttl_seconds") is not None:
        raise ValueError("a stream with ttl_seconds does not end: pass available_now=False")
    writer = writer_of(checkpoint)
    # Keyed state needs RocksDB.
    with setting(log.sparkSession, PROVIDER, ROCKSDB):
        return run(
            keyed_changes(log, **options),
            lambda df, batch: append_batch(df, root, batch, writer=writer),
            checkpoint,
            available_now,
            "update",
            name,
        )


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """partition_key, key, value_json, version, seq: the current value of every key, out of the state store of a
    checkpoint. Nothing is folded: one row per key is read."""
    with setting(spark, PROVIDER, ROCKSDB):
        found = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    return found.select("key.*", "value.value_json", "value.version", "value.seq")
