"""Rate limits and outcome counters, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[float], recent: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which hits pass, and the accepted ones still in the window: a hit expires once it is older than the window."""
    out = []
    for t in times:
        recent = [r for r in recent if t - r <= window]
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out, recent


def rate_limited(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """event_id, key, accepted of hits (event_id, key, ts).

    After a pause longer than the window nothing accepted before it counts any more, so only hits between two such
    pauses must be taken together; a key's hits are cut at every 256th pause.
    """
    kind = hits.schema["key"].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        seconds = (rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        return rows[["event_id", "key"]].assign(accepted=admit(seconds, [], limit, window)[0])

    by = Window.partitionBy("key").orderBy("ts", "event_id")
    pause = F.col("ts").cast("double") - F.lag("ts").over(by).cast("double") > window
    nth = F.sum(F.when(pause, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = hits.withColumn("run", F.floor(nth / 256))
    return runs.groupBy("key", "run").applyInPandas(one, f"event_id long, key {kind}, accepted boolean")


def rate_limit_stream(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """The same over a stream of hits, with the accepted times of each key as state; hits of a batch are taken in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        seconds = (rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        passed, recent = admit(seconds, recent, limit, window)
        state.update((recent,))
        yield rows[["event_id", "key"]].assign(accepted=passed)

    return hits.groupBy("key").applyInPandasWithState(step, "event_id long, key long, accepted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """path_key, wins, losses of a stream or a table of outcomes."""
    return outcomes.groupBy("path_key").agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"))


def windowed_outcomes(outcomes: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, wins, losses of time windows, with a watermark for late rows."""
    w = outcomes.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"))
    return w.select(F.col("window.start").alias("start"), "wins", "losses")
