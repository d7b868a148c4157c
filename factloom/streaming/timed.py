"""Streams whose state is kept by key, ordered by event time and dropped by timers.

Micro-batches may bring rows in any order within the watermark. Rows wait in a key's state until the watermark has passed them, a
timer takes them in order of time, and a second timer drops what can't matter any more, so state lasts no longer than the window
after a key's last row. The sessions' state store must be one with timers, as RocksDB's is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.streaming.limits import admit

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed_session(spark: SparkSession) -> None:
    """Let the session's streams keep state with timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _milliseconds(rows: pd.DataFrame) -> list[int]:
    return (rows["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()


class _Ordered(StatefulProcessor):
    """Holds rows (at, event, own) until the watermark has passed them and gives them to ``take`` in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event long, own boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            at = _milliseconds(part)
            own = part["own"].tolist()
            self.waiting.appendList([(a, int(e), bool(o)) for a, e, o in zip(at, part["event_id"].tolist(), own, strict=True)])
            for a in set(at):
                self.handle.registerTimer(a)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(r for r in held if r[0] <= now)
        rest = [r for r in held if r[0] > now]
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        yield self.take(key, due, rest, now)

    def close(self) -> None:
        pass


class RateLimit(_Ordered):
    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", "times array<double>")

    def take(self, key, due: list, rest: list, now: int) -> pd.DataFrame:
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        if not due:  # the time at which the last accepted hit ceases to count
            if recent and now / 1000 - recent[-1] > self.window:
                self.recent.clear()
            return pd.DataFrame()
        passed, recent = admit([a / 1000 for a, *_ in due], recent, self.limit, self.window)
        if recent:
            self.recent.update((recent,))
            self.handle.registerTimer(int((recent[-1] + self.window) * 1000) + 1)
        return pd.DataFrame({"event_id": [e for _, e, _ in due], "key": [key[0]] * len(due), "accepted": passed})


class Counters(_Ordered):
    """Wins and losses of a key between two pauses; told when the pause is over."""

    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getValueState("counts", "first long, last long, wins long, losses long")

    def take(self, key, due: list, rest: list, now: int) -> pd.DataFrame:
        out = []
        state = tuple(self.counts.get()) if self.counts.exists() else None
        if state and (now - state[1] > self.idle or (due and due[0][0] - state[1] > self.idle)):
            out.append(state)
            state = None
            self.counts.clear()
        for at, _, won in due:
            if state and at - state[1] > self.idle:
                out.append(state)
                state = None
            first, _, wins, losses = state or (at, at, 0, 0)
            state = (first, at, wins + won, losses + (not won))
        if due and state:
            self.counts.update(state)
            self.handle.registerTimer(state[1] + self.idle + 1)
        rows = {"key": [key[0]] * len(out), "first": pd.to_datetime([a for a, *_ in out], unit="ms"), "last": pd.to_datetime([b for _, b, *_ in out], unit="ms"), "wins": [w for *_, w, _ in out], "losses": [x for *_, x in out]}
        return pd.DataFrame(rows) if out else pd.DataFrame()


def rate_limited_in_order(hits: DataFrame, limit: int, window: float, late: str = "1 hour") -> DataFrame:
    """event_id, key, accepted of a stream of hits (event_id, key, ts): as ``rate_limited`` tells for the whole table, whatever order they come in within ``late``."""
    timed_session(hits.sparkSession)
    kind = hits.schema["key"].dataType.simpleString()
    rows = hits.selectExpr("event_id", "key", "ts", "true AS own").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(RateLimit(limit, window), f"event_id long, key {kind}, accepted boolean", "Append", "EventTime")


def outcome_sessions(outcomes: DataFrame, idle: float, late: str = "1 hour") -> DataFrame:
    """key, first, last, wins, losses of each key's outcomes (event_id, key, ts, won) between pauses longer than ``idle`` seconds, told once the watermark is past the pause."""
    timed_session(outcomes.sparkSession)
    kind = outcomes.schema["key"].dataType.simpleString()
    rows = outcomes.selectExpr("event_id", "key", "ts", "won AS own").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Counters(idle), f"key {kind}, first timestamp, last timestamp, wins long, losses long", "Append", "EventTime")
