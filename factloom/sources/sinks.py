"""Sinks: append, latest-wins upsert, insert if absent, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``; of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("r"))
    return last.select(*keys, "r.*")


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` and the first new row of every key that it lacks."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(old.columns))


def merged_counters(old: DataFrame, outcomes: DataFrame) -> DataFrame:
    """path_key, wins, losses: counters plus new outcomes (path_key, won)."""
    fresh = outcomes.select("path_key", F.col("won").cast("long").alias("wins"), (~F.col("won")).cast("long").alias("losses"))
    return old.select("path_key", "wins", "losses").unionByName(fresh).groupBy("path_key").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


def raw_members(props: Column) -> Column:
    """The members of a JSON object by name, each value as JSON; none where the text is null or no object."""
    members = F.try_variant_get(F.try_parse_json(props), "$", "map<string,variant>")
    return F.coalesce(F.transform_values(members, lambda k, v: F.coalesce(F.to_json(v), F.lit("null"))), F.create_map().cast("map<string,string>"))


def as_json(members: Column) -> Column:
    """A JSON object of raw members, in order of their names."""
    one = lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"), e["value"])
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(members)), one), ","), F.lit("}"))


def patched(old: DataFrame, changes: DataFrame, keys: list[str], order: list[str], columns: list[str], props: str | None = None, once: dict[str, str] | None = None) -> DataFrame:
    """``old`` with a log of changes applied: rows that it lacks aren't made, columns that aren't listed don't change.

    A null in a change leaves its column alone; else the last change by ``order`` wins. ``props``: JSON objects are
    merged by member, the last change of each member wins, members that no change names stay. ``once``: columns that
    leave the given value a single time, by the first change to another one, and then stay. Changes are folded by
    aggregation, those of props by key and member, so a row that most changes hit is no hot group. Keys of ``old``
    are unique; repeated changes change nothing; ties of ``order`` go to the greater value (``once``: to the smaller).
    """
    once, at = once or {}, F.struct(*order).alias("at")
    given = changes.select(*keys, at, *columns, *once, *([props] if props else []))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c].alias(f"_{c}")
    first = lambda c, start: F.min(F.when(F.col(c).isNotNull() & (F.col(c) != start), F.struct("at", c)))[c].alias(f"_{c}")
    new = given.groupBy(*keys).agg(F.lit(True).alias("_hit"), *map(last, columns), *(first(c, start) for c, start in once.items()))
    out = old.join(new, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    for c, start in once.items():
        out = out.withColumn(c, F.when(F.col(c) == start, F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    if props:
        each = given.select(*keys, "at", F.explode(raw_members(F.col(props))).alias("_member", "_value"))
        members = each.groupBy(*keys, "_member").agg(F.max(F.struct("at", "_value"))["_value"].alias("_value"))
        merged = members.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_member", "_value"))).alias("_new"))
        kept = lambda new_: F.map_filter(raw_members(F.col(props)), lambda k, v: ~F.map_contains_key(new_, k))
        out = out.join(merged, keys, "left").withColumn(props, F.when(F.col("_new").isNull(), F.col(props)).otherwise(as_json(F.map_concat(kept(F.col("_new")), F.col("_new")))))
    return out.select(*old.columns)
