"""A sliding request limit as a stream: each request is judged by the requests of its own last window.

A keyed processor holds a user's requests of the last window and those that the watermark has not passed.
When it passes the first of these, a timer judges all up to it; they are final then, as no earlier request
can come any more. A second timer, a window after the last request, drops the state of a quiet user. So
the state is what came within a window and the watermark's delay, however long the stream runs, and a
query that starts again from its checkpoint goes on with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

JUDGED = "user_id long, event_id long, at long, requests long, allowed boolean"
MICRO = 1_000_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingLimit(StatefulProcessor):
    """Input: user_id (the key), event_id, at (microseconds), event time. Output: JUDGED."""

    def __init__(self, window_s: int, limit: int) -> None:
        self.window, self.limit = window_s * MICRO, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, event_id long, judged boolean")

    def call_at(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), int(i), False) for pdf in rows for at, i in zip(pdf["at"], pdf["event_id"])]
        if new:
            self.held.appendList(new)
            self.call_at(min(new)[0])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.held.get())
        at = np.array([h[0] for h in held], np.int64)
        now = np.array([not h[2] and h[0] <= passed for h in held], bool)
        if now.any():
            seen = np.searchsorted(at, at[now], "right") - np.searchsorted(at, at[now] - self.window, "right")
            ids = np.array([h[1] for h in held], np.int64)[now]
            yield pd.DataFrame({"user_id": key[0], "event_id": ids, "at": at[now], "requests": seen, "allowed": seen <= self.limit})
        left = [(h[0], h[1], bool(h[2] or n)) for h, n in zip(held, now) if h[0] > passed - self.window]
        if left:
            self.held.put(left)
            waiting = [h[0] for h in left if not h[2]]
            self.call_at(min(waiting) if waiting else left[-1][0] + self.window)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def timed(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", F.unix_micros("ts").alias("at"), "ts")


def judged_stream(events: DataFrame, window_s: int, limit: int, delay: str) -> DataFrame:
    """JUDGED for each request of a stream (user_id, event_id, ts), once the watermark has passed it. The
    session's state store must be STATE_STORE."""
    keyed = timed(events.where("user_id IS NOT NULL AND ts IS NOT NULL")).withWatermark("ts", delay).groupBy("user_id")
    return keyed.transformWithStateInPandas(SlidingLimit(window_s, limit), JUDGED, "append", "eventTime")


def judged(events: DataFrame, window_s: int, limit: int) -> DataFrame:
    """The same for a table: a count over a range frame that ends at the request, with all of the same time."""
    own = Window.partitionBy("user_id").orderBy("at").rangeBetween(-window_s * MICRO + 1, Window.currentRow)
    rows = timed(events.where("user_id IS NOT NULL AND ts IS NOT NULL")).withColumn("requests", F.count("*").over(own))
    return rows.select("user_id", "event_id", "at", "requests", (F.col("requests") <= limit).alias("allowed"))
