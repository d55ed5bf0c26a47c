"""Request limits and intake as streams; every function works on bounded tables too.

Two kinds of windows: tumbling ones, which all keys share, and anchored ones, which begin with a key's first request and again with
the first one after they have ended, as a limiter does that counts in memory.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.session import ship, staged
from tracewarden.streaming.inorder import InOrder, folded

#: Fixed values: (window, most requests) for all requests and for submissions.
ALL_REQUESTS, SUBMISSIONS = ("15 minutes", 100), ("1 hour", 5)
#: Windows in a stretch of time that one task follows a key through.
STRETCH = 64


def requests_per_window(requests: DataFrame, window: str, late: str | None = None) -> DataFrame:
    """(ip, window_start, requests): tumbling windows over (ip, ts); ``late`` sets a watermark on streams."""
    rows = requests.withWatermark("ts", late) if late else requests
    n = rows.groupBy(F.window("ts", window), "ip").agg(F.count(F.lit(1)).alias("requests"))
    return n.select("ip", F.col("window.start").alias("window_start"), "requests")


def over_limit(requests: DataFrame, limit: tuple[str, int] = SUBMISSIONS, late: str | None = None) -> DataFrame:
    return requests_per_window(requests, limit[0], late).where(F.col("requests") > limit[1])


def micros(window: str) -> int:
    return int(pd.Timedelta(window) / pd.Timedelta(microseconds=1))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows that come in the order of (ip, stretch), as tables of whole groups, with the places where groups begin and the last one ends."""
    held, now = [], ()
    for batch in batches:
        begins = []
        for i, key in enumerate(zip(batch.column("ip").to_pylist(), batch.column("stretch").to_pylist(), strict=True)):
            if key != now:
                now = key
                begins.append(i)
        if not begins:
            held.append(batch)
            continue
        before, last = sum(len(b) for b in held), begins[-1]
        places = [*([0] if before else []), *(before + i for i in begins)]
        if places[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks(), places
        held = [batch.slice(last)]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, [0, len(table)]


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("ip", "stretch").sortWithinPartitions("ip", "stretch", "us")


def _passages(times: DataFrame, width: int) -> DataFrame:
    """(ip, stretch, upto, leaves): a step function for each stretch of a key: a window that is open on entry until ``upto`` at most, and more than any smaller ``upto``, leaves one open until ``leaves``."""

    stretch = width * STRETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, places in _whole(batches):
            t, at = table["us"].to_pylist(), table["stretch"].to_pylist()
            ends, kept = [0] * len(t), []
            for lo, hi in pairwise(places):
                for i in range(hi - 1, lo - 1, -1):  # each time as the first of a window: where the last window of its chain ends
                    after = bisect_left(t, t[i] + width, i + 1, hi)
                    ends[i] = ends[after] if after < hi else t[i] + width
                top = min(bisect_left(t, at[lo] * stretch + width, lo, hi) + 1, hi)  # nothing that was open on entry lasts longer
                kept += (i for i in range(lo, top) if i + 1 == top or ends[i + 1] != ends[i])
            upto = table.select(["ip", "stretch", "us"]).take(pa.array(kept, pa.int64())).combine_chunks()
            yield from upto.rename_columns(["ip", "stretch", "upto"]).append_column("leaves", pa.array([ends[i] for i in kept], pa.int64())).to_batches()

    kind = times.schema["ip"].dataType.simpleString()
    return _dealt(times).mapInArrow(run, f"ip {kind}, stretch long, upto long, leaves long")


def _entries(passages: DataFrame) -> DataFrame:
    """(ip, stretch, until): until when a window is open on entry to each stretch; rows are followed in order, with one number in memory."""

    kind = passages.schema["ip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until, entry, found = None, None, None, False
        for batch in batches:
            out = []
            for ip, stretch, upto, leaves in zip(*(batch.column(c).to_pylist() for c in ("ip", "stretch", "upto", "leaves")), strict=True):
                if now is None or ip != now[0]:
                    until = None
                if now != (ip, stretch):
                    now, entry, found = (ip, stretch), until, False
                    out.append((ip, stretch, entry))
                if not found and (entry is None or entry <= upto):
                    until, found = leaves, True
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (batch.schema.field("ip").type, pa.int64(), pa.int64()), strict=True)], ["ip", "stretch", "until"])

    rows = passages.repartition("ip").sortWithinPartitions("ip", "stretch", "upto")
    return rows.mapInArrow(run, f"ip {kind.dataType.simpleString()}, stretch long, until long")


def anchored_starts(requests: DataFrame, window: str) -> DataFrame:
    """(ip, ts, requests, window_start): for each time at which a key has requests, how many, and the begin of the window that they fall into.

    A window is [begin, begin + window).  Requests without a key are one key's; those without a time are in no window and left
    out; repeated rows count each.  A key's times are cut into stretches of STRETCH windows, so that a key with a third of all requests
    is many tasks' work: each stretch tells, for any window open on entry, which one it leaves open; these are followed in order,
    and then each stretch is gone through from the entry that it really has.  Stretches mostly hold few times, so tasks go through sorted
    rows and not through groups, which cost far more than their rows.
    """
    width = micros(window)
    ship(requests.sparkSession)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    times = requests.where("ts is not null").select("ip", us.alias("us")).groupBy("ip", "us").agg(F.count(F.lit(1)).alias("n"))
    times = staged(times.withColumn("stretch", F.floor(F.col("us") / (width * STRETCH))))
    entries = _entries(_passages(times, width)).select("ip", F.lit(None).cast("long").alias("us"), F.lit(None).cast("long").alias("n"), "stretch", "until")
    rows = times.withColumn("until", F.lit(None).cast("long")).unionByName(entries)  # the entry has no time and so comes first in its stretch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, places in _whole(batches):
            t, entered = table["us"].to_pylist(), table["until"].to_pylist()
            start = [None] * len(t)
            for lo, hi in pairwise(places):
                until, i = entered[lo], lo + 1
                if until is not None:
                    i = bisect_left(t, until, i, hi)
                    start[lo + 1 : i] = [until - width] * (i - lo - 1)
                while i < hi:
                    after = bisect_left(t, t[i] + width, i + 1, hi)
                    start[i:after] = [t[i]] * (after - i)
                    i = after
            out = table.select(["ip", "us", "n"]).append_column("start", pa.array(start, pa.int64()))
            yield from out.filter(pc.is_valid(out["us"])).to_batches()

    kind = requests.schema["ip"].dataType.simpleString()
    out = _dealt(rows).mapInArrow(run, f"ip {kind}, us long, n long, start long")
    return out.select("ip", F.timestamp_micros("us").alias("ts"), F.col("n").alias("requests"), F.timestamp_micros("start").alias("window_start"))


def anchored_windows(requests: DataFrame, window: str) -> DataFrame:
    """(ip, window_start, requests) of ``anchored_starts``."""
    return anchored_starts(requests, window).groupBy("ip", "window_start").agg(F.sum("requests").alias("requests"))


def decided(requests: DataFrame, limit: tuple[str, int] = SUBMISSIONS, order: str = "ts") -> DataFrame:
    """``requests`` with window_start, nth (its number in the window, by ts and ``order``) and allowed; those without a time are refused."""
    starts = anchored_starts(requests, limit[0]).select(F.col("ip").alias("_ip"), F.col("ts").alias("_ts"), "window_start")
    rows = requests.join(starts, F.col("ip").eqNullSafe(F.col("_ip")) & (F.col("ts").cast("timestamp") == F.col("_ts")), "left").drop("_ip", "_ts")
    nth = F.row_number().over(Window.partitionBy("ip", "window_start").orderBy("ts", order))
    rows = rows.withColumn("nth", F.when(F.col("window_start").isNotNull(), nth))
    return rows.withColumn("allowed", F.coalesce(F.col("nth") <= limit[1], F.lit(False)))


class _Anchored(InOrder):
    """The open window of a key as (start, requests); emitted when it is over."""

    STATE = "start long, n long"

    def __init__(self, width: int):
        self.width = width

    def _closed(self, key: tuple, state: tuple) -> Row:
        return Row(ip=key[0], start=state[0], requests=state[1])

    def step(self, key: tuple, state: tuple | None, us: int, order: str) -> tuple[tuple | None, list[Row]]:
        if state is not None and us < state[0] + self.width:
            return (state[0], state[1] + 1), []
        return (us, 1), [] if state is None else [self._closed(key, state)]

    def rest(self, key: tuple, state: tuple | None, until: int) -> tuple[tuple | None, list[Row], int | None]:
        if state is None:
            return None, [], None
        if state[0] + self.width <= until:
            return None, [self._closed(key, state)], None
        return state, [], state[0] + self.width


def anchored_stream(requests: DataFrame, window: str, late: str) -> DataFrame:
    """``anchored_windows`` of a stream: each window once, when the watermark has passed its end."""
    ship(requests.sparkSession)
    kind = requests.schema["ip"].dataType.simpleString()
    out = folded(requests, "ip", late, F.lit(""), _Anchored(micros(window)), f"ip {kind}, start long, requests long")
    return out.select("ip", F.timestamp_micros("start").alias("window_start"), "requests")


def intake(spark: SparkSession, drop: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Audits what has arrived in a folder of staged files since the last call; returns the finished query."""
    rows = spark.readStream.schema(schema).parquet(drop)
    q = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
