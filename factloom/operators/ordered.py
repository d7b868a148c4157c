"""Ordered computations: keep-one, previous-row differences, as-of look-back, ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, key: str, *order) -> DataFrame:
    """Rows with ``decision``: keep for the first of each key by the order, skip_exact for others."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("decision", F.when(F.row_number().over(w) == 1, "keep").otherwise("skip_exact"))


def versus_previous(rows: DataFrame, group: list[str], time: str, value: str) -> DataFrame:
    """Rows with the difference to the row before; null for the first."""
    w = Window.partitionBy(*group).orderBy(time)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(w))


def look_back(rows: DataFrame, group: str, day: str, value: str, days: int) -> DataFrame:
    """Of each group the last value, the latest one at least ``days`` earlier (else the one before), and a label for the change."""
    last = rows.groupBy(group).agg(F.max(F.struct(day, value)).alias("l"), F.count("*").alias("n"))
    prior = rows.join(last, group).where(F.col(day) < F.col(f"l.{day}"))
    far = F.datediff(F.col(f"l.{day}"), F.col(day)) >= days
    picked = prior.groupBy(group).agg(F.max(F.when(far, F.struct(day, value))).alias("far"), F.max(F.struct(day, value)).alias("near"))
    out = last.join(picked, group, "left").select(group, F.col(f"l.{value}").alias("current"), F.coalesce(F.col(f"far.{value}"), F.col(f"near.{value}")).alias("prior"))
    delta = F.round(F.col("current") - F.col("prior"), 1)
    return out.withColumn("delta", delta).withColumn("label", F.when(delta.isNull(), "Need another snapshot").when(F.abs(delta) < 0.3, "Stable").when(delta < 0, "Improving").otherwise("Deteriorating"))


def learned_weight(outcomes: DataFrame, key: str, time, won: str, start: float = 1.0, up: float = 0.045, down: float = -0.04, low: float = 0.12, high: float = 2.8) -> DataFrame:
    """key, weight: outcomes folded in order of time (a timestamp first), clamped after every step (so the order matters).

    A clamped step x -> min(h, max(l, x + d)), after another, is one of the same kind. So steps are folded minute by
    minute, these day by day, and those at last: no list grows with all of a key's outcomes.
    """
    one = F.struct(F.when(F.col(won), up).otherwise(down).alias("d"), F.lit(low).alias("l"), F.lit(high).alias("h"))
    clamp = lambda s, x: F.least(s["h"], F.greatest(s["l"], x + s["d"]))
    after = lambda first, then: F.struct((first["d"] + then["d"]).alias("d"), clamp(then, first["l"]).alias("l"), clamp(then, first["h"]).alias("h"))
    nothing = F.struct(F.lit(0.0).alias("d"), F.lit(-1e300).alias("l"), F.lit(1e300).alias("h"))
    stamp, rest = F.col(time[0]).cast("timestamp"), F.struct(*time)
    steps = outcomes.select(key, F.date_trunc("day", stamp).alias("day"), F.date_trunc("minute", stamp).alias("minute"), rest.alias("at"), one.alias("step"))

    def folded(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "step"))).alias("o"))
        return listed.select(*by, F.aggregate("o", nothing, lambda s, x: after(s, x["step"])).alias("step"))

    every = folded(folded(folded(steps, [key, "day", "minute"], "at"), [key, "day"], "minute"), [key], "day")
    return every.select(key, F.round(clamp(F.col("step"), F.lit(start)), 6).alias("weight"))


def running_count(rows: DataFrame, key: str, time: list, flag: str, name: str) -> DataFrame:
    """Rows with the number of rows of their key, up to them in order of time, for which ``flag`` holds.

    Counted within days, plus the count of earlier days: no task sorts all rows of a key.
    """
    one = F.when(F.col(flag), 1).otherwise(0)
    dated = rows.withColumn("_day", F.date_trunc("day", F.col(time[0]).cast("timestamp")))
    days = dated.groupBy(key, "_day").agg(F.sum(one).alias("_n"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = days.select(key, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy(key, "_day").orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    return dated.withColumn("_own", F.sum(one).over(within)).join(earlier, [key, "_day"]).withColumn(name, F.col("_own") + F.col("_earlier")).drop("_day", "_own", "_earlier")
