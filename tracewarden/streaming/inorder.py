"""Keyed folds over rows in the order of their times, as streams: rows wait in state until the watermark has passed them.

A row that comes out of order is folded where it belongs as long as the watermark hasn't passed it; later ones are dropped, as
by any operator with a watermark.  Rows with equal times are folded in the order of ``order``, equal rows as often as they came.
Streams need the state store that keeps timers; ``needs`` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds to which timers are rounded up, so that a busy key has few.
TICK = 1000


def needs(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class InOrder(StatefulProcessor):
    """Folds (us, order) of each key; subclasses say how one row changes the state, what that emits, and until when the state waits."""

    #: Schema of the state that is carried from row to row.
    STATE = "status string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, ord string", "n long")
        self.carried = handle.getValueState("carried", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ticks = set()
        for r in rows:
            at = (r["us"], r["ord"])
            n = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0
            self.waiting.updateValue(at, (n + 1,))
            ticks.add(self._tick(r["us"]))
        for t in ticks:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        state = tuple(self.carried.get()) if self.carried.exists() else None
        began = state
        for at, n in sorted((tuple(k), tuple(v)[0]) for k, v in self.waiting.iterator()):
            if at[0] > until:
                break
            for _ in range(n):
                state, out = self.step(key, state, *at)
                yield from out
            self.waiting.removeKey(at)
        state, out, wake = self.rest(key, state, until)
        yield from out
        if wake is not None:
            self.handle.registerTimer(self._tick(wake))
        if state is None:
            self.carried.clear()
        elif state != began:
            self.carried.update(state)

    @staticmethod
    def _tick(us: int) -> int:
        return -(-us // (1000 * TICK)) * TICK

    def step(self, key: Any, state: tuple | None, us: int, order: str) -> tuple[tuple | None, list[Row]]:
        """The state after one more row, and what that row emits."""
        raise NotImplementedError

    def rest(self, key: Any, state: tuple | None, until: int) -> tuple[tuple | None, list[Row], int | None]:
        """The state once all rows until ``until`` are folded, what that emits, and a later time to look again, if any."""
        return state, [], None


def folded(rows: DataFrame, key: str, late: str, order, processor: InOrder, schema: str) -> DataFrame:
    """A stream ``rows`` (key, ts, ...) folded by ``processor``; ``late`` is how far rows may come out of order."""
    r = rows.where("ts is not null").withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"), order.alias("ord"))
    return r.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
