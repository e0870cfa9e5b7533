"""State of one key at a time, kept in the state store until event time has left it behind.

A processor sees the new rows of a key, changes the key's state and returns the key's row as it is now. Each key has one
event-time timer, ``ttl`` after its newest event; when the watermark passes it the key's state is removed. So the store
holds the keys of the last ``ttl`` and not the history, and a change costs what it touches. Rows carry ``us``, their
event time in microseconds, next to the watermarked ``ts``; those behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The workers get these classes along with the plan and needn't have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers_supported(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers and very many keys need; others stay as they are."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Expiring(StatefulProcessor):
    """State that is forgotten ``ttl_ms`` after the key's newest event. ``schema`` has a long ``timer``, the first field."""

    schema = columns = ""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms
        self.names = [c.split(" ")[0] for c in self.columns.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def start(self) -> tuple:
        """The state of a new key, but for its timer."""
        raise NotImplementedError

    def change(self, state: tuple, row: Row) -> tuple:
        raise NotImplementedError

    def shown(self, state: tuple) -> tuple | None:
        """The key's output columns; None if there is nothing to show."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        had = self.value.get()
        stored = None if had is None else [[tuple(x) for x in v] if isinstance(v, list) else v for v in had]
        timer, *state = stored or (None, *self.start())
        before, state = self.shown(tuple(state)) if had is not None else None, tuple(state)
        newest = 0
        for row in rows:
            newest = max(newest, row["us"])
            state = self.change(state, row)
        later = newest // 1000 + self.ttl_ms
        if timer is None or later > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(later)
            timer = later
        self.value.update((timer, *state))
        now = self.shown(state)
        if now is not None and now != before:
            yield Row(key=key[0], **dict(zip(self.names, now, strict=True)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.value.clear()
        yield from ()


class ExecutionState(Expiring):
    """Starts with the first STARTED, ends with the first outcome after it for good.

    Outcomes from before the start are kept as long as the state is: an earlier start may still arrive.
    """

    schema = "timer long, start_us long, start_id long, outcomes array<struct<us:long,id:long,status:string>>"
    columns = "status string, started_us long, completed_us long"

    def start(self) -> tuple:
        return None, None, []

    def change(self, state: tuple, row: Row) -> tuple:
        us, number, outcomes = state
        at = (row["us"], row["event_id"])
        if row["status"] == "STARTED":
            return (*(at if us is None else min(at, (us, number))), outcomes)
        outcome = (*at, row["status"])
        return us, number, outcomes if outcome in outcomes else [*outcomes, outcome]

    def shown(self, state: tuple) -> tuple | None:
        us, number, outcomes = state
        if us is None:
            return None
        after = min((o for o in outcomes if o[:2] > (us, number)), default=None)
        return ("STARTED", us, None) if after is None else (after[2], us, after[0])


def keyed(rows: DataFrame, key: str, processor: Expiring, delay: str) -> DataFrame:
    """The changed rows (key and the processor's columns) of a stream with a timestamp ``ts``, in any order within ``delay``."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    changed = timed.groupBy(key).transformWithState(processor, f"key string, {processor.columns}", "Update", "EventTime")
    return changed.withColumnRenamed("key", key)
