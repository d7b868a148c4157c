"""Timed streams over shuffled micro-batches against the whole table, and their state after the window."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.streaming import limits, timed

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, key long, ts timestamp, won boolean"


@pytest.fixture(scope="module")
def table():
    """Events of some keys with pauses, shuffled within half an hour; far later events of another key bring the watermark past all."""
    rng = random.Random(2)
    rows, at = [], START
    for i in range(240):
        at += timedelta(seconds=rng.choice([1, 5, 40, 400]) if i % 60 else 9000)
        rows.append((i, rng.randrange(4), at, rng.random() < 0.6))
    rows.sort(key=lambda r: r[2] + timedelta(seconds=rng.random() * 1500))
    return [rows[i : i + 60] for i in range(0, 240, 60)] + [[(1000, 99, at + timedelta(days=2), True)], [(1001, 99, at + timedelta(days=4), True)], [(1002, 99, at + timedelta(days=6), True)]]


def run(spark, tmp_path, batches, build, name):
    folder = tmp_path / name
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"part={i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(*[str(folder / "part=*")])
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None
    query.stop()
    return spark.table(name).collect(), state


def test_rate_limits_in_order(spark, tmp_path, table):
    got, state = run(spark, tmp_path, table, lambda s: timed.rate_limited_in_order(s.select("event_id", "key", "ts"), 2, 60.0), "limited")
    whole = spark.createDataFrame([r for b in table for r in b], SCHEMA).select("event_id", "key", "ts")
    want = {r.event_id: r.accepted for r in limits.rate_limited(whole.where("key <> 99"), 2, 60.0).collect()}
    assert state <= 4  # of the last key alone: all others are forgotten
    assert {r.event_id: r.accepted for r in got if r.key != 99} == want and len({*want.values()}) == 2


def test_outcome_sessions(spark, tmp_path, table):
    got, state = run(spark, tmp_path, table, lambda s: timed.outcome_sessions(s, 600.0), "sessions")
    want = []
    for key in range(4):
        rows = sorted((r[2], r[3]) for b in table for r in b if r[1] == key)
        parts = [[rows[0]]]
        for r in rows[1:]:
            if (r[0] - parts[-1][-1][0]).total_seconds() > 600:
                parts.append([])
            parts[-1].append(r)
        want += [(key, p[0][0], p[-1][0], sum(w for _, w in p), sum(not w for _, w in p)) for p in parts]
    assert state <= 4  # of the last key alone: all others are forgotten
    assert sorted((r.key, r.first, r.last, r.wins, r.losses) for r in got if r.key != 99) == sorted(want) and len(want) > 8
