"""Streaming forms of two operators, for segments that arrive as they are recognised.

The batch operators need whole media items; these emit results as their time passes the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cuewise.functions.text import strip

RUN = "media_id string, start double, end double, text string, n int"


def collapse_duplicates(stream: DataFrame, quiet: str = "10 minutes") -> DataFrame:
    """Runs of equal texts of a media item, from a stream (media_id, ts, start, end, text) in order of start.

    A run comes out when another text follows it, or after ``quiet`` without news of the item. The state
    of an item is its last run.
    """
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = [], state.getOption
        if state.hasTimedOut:
            done.append((key[0], *held))
            state.remove()
        else:
            for r in pd.concat(list(frames)).sort_values("start").itertuples():
                if held and held[2] == r.text:
                    held = (held[0], r.end, r.text, held[3] + 1)
                else:
                    if held:
                        done.append((key[0], *held))
                    held = (r.start, r.end, r.text, 1)
            if held:
                state.update(held)
                state.setTimeoutDuration(wait)
        yield pd.DataFrame(done, columns=["media_id", "start", "end", "text", "n"])

    rows = stream.select("media_id", "start", "end", strip(F.col("text")).alias("text"))
    return rows.groupBy("media_id").applyInPandasWithState(run, RUN, "start double, end double, text string, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def recurring_words(stream: DataFrame, delay: str = "10 minutes", window: str = "60 seconds", slide: str = "10 seconds", least: int = 6) -> DataFrame:
    """(media_id, token, window, n): short texts that occur ``least`` times within a sliding window of ``ts``."""
    rows = stream.withColumn("token", strip(F.col("text"))).where(F.length("token").between(1, 3)).withWatermark("ts", delay)
    return rows.groupBy("media_id", "token", F.window("ts", window, slide)).agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Runs(StatefulProcessor):
    """Holds rows until the watermark has passed them, then joins them to runs in order of start.

    State of a media item: the rows that wait, by start, and its last run. A timer wakes it for the latest row that waits,
    and once more to end a run that nothing followed for ``quiet``.
    """

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start double, ts long", "end double, text string")
        self.last = handle.getValueState("last", RUN.removeprefix("media_id string, ") + ", ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, now = None, timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for r in frame.itertuples():
                at = int(r.ts.timestamp() * 1000)
                if at < now:
                    continue  # too late: what follows it may be out already
                self.waiting.updateValue((r.start, at), (r.end, r.text))
                latest = at if latest is None else max(latest, at)
        if latest is not None:
            self.handle.registerTimer(latest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted((place, row) for place, row in self.waiting.iterator() if place[1] <= now)
        held, done = self.last.get() if self.last.exists() else None, []
        for (start, at), (end, text) in ready:
            self.waiting.removeKey((start, at))
            if held and held[2] == text:
                held = (held[0], end, text, held[3] + 1, max(at, held[4]))
            else:
                done += [held] if held else []
                held = (start, end, text, 1, at)
        if held and held[4] + self.quiet <= now and not any(True for _ in self.waiting.keys()):
            done.append(held)
            held = None
        if held:
            self.last.update(held)
            self.handle.registerTimer(max(now + 1, held[4] + self.quiet))
        elif self.last.exists():
            self.last.clear()
        yield pd.DataFrame([(key[0], *d[:4]) for d in done], columns=["media_id", "start", "end", "text", "n"])


def collapse_in_order(stream: DataFrame, delay: str = "10 seconds", quiet: str = "10 minutes") -> DataFrame:
    """Runs of equal texts of a media item, from a stream (media_id, ts, start, end, text) in any order.

    Rows wait until the watermark, ``delay`` behind the latest ts, has passed them, and count in order of start; rows later
    than that are dropped. A run comes out when another text follows it, or when ``quiet`` has passed since its last row by the
    watermark. Rows of one media item that share start and ts are one. Sets the session's state store to RocksDB, which timers need.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = stream.withWatermark("ts", delay).select("media_id", "ts", "start", "end", strip(F.col("text")).alias("text"))
    return rows.groupBy("media_id").transformWithStateInPandas(_Runs(wait), RUN, "Append", "EventTime")
