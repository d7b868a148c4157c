"""Deterministic shards of nearly equal bytes by minimax contiguous partition, in DataFrame and SQL functions only.

Rows with equal texts are an atomic group. Groups fall, by the hash of their text, into a fixed number of units, so
the table of sizes is bounded whatever the input; a unit is never cut (with fewer groups than units it is a
group, nearly always). The units' order: those larger than an even share of what is left, each a shard by itself
since no capacity below its size is feasible, then the others by hash. Over these a binary search finds the smallest
capacity for which greedy filling needs no more than the remaining shards, and they are cut there. Filling every
shard up to the capacity would leave the last one short, so of the cuts that keep to the capacity those nearest to
even shares are taken. Slots come from row numbers within parts of a unit, as many as its rows need, plus prefix sums
over part counts, so a text that holds a third of all rows is numbered by many tasks.

Defined cases: null texts count no bytes and form one group with empty ones; repeated rows share a shard and
take slots in any order; null ids are rows like others; a very long text is one large group; an empty table
gives no rows; other columns aren't carried; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.scratch import materialize

#: Ordered units that groups are hashed into.
UNITS = 32_768
#: Rows of a part of a unit, about; parts are numbered apart. Units of 4,096 rows and more have 64 parts at least.
PART_ROWS = 65_536
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def capacity_plan(units: DataFrame, shards: int) -> DataFrame:
    """units: unit, bytes (a bounded table). Returns unit, shard, and the smallest feasible capacity."""
    fill = "aggregate(sizes, named_struct('n', 1L, 'cur', 0L), (s, x) -> if(s.cur + x <= {cap}, named_struct('n', s.n, 'cur', s.cur + x), named_struct('n', s.n + 1L, 'cur', x)))"
    middle = "((r.lo + r.hi) div 2)"
    one = units.agg(F.array_sort(F.collect_list(F.struct("unit", "bytes"))).alias("u"))
    one = one.selectExpr("u", "aggregate(u, 0L, (s, x) -> s + x.bytes) AS total", "array_sort(u, (a, b) -> case when a.bytes <> b.bytes then if(a.bytes > b.bytes, -1, 1) else if(a.unit < b.unit, -1, 1) end) AS by_size")
    one = one.selectExpr(
        "u",
        f"""aggregate(by_size, named_struct('rest', total, 'k', {shards}L, 'own', cast(array() as array<int>)),
            (s, x) -> if(s.k > 1 and x.bytes * s.k > s.rest, named_struct('rest', s.rest - x.bytes, 'k', s.k - 1, 'own', array_append(s.own, x.unit)), s)) AS alone""",
    )
    one = one.selectExpr("alone", "filter(u, x -> not array_contains(alone.own, x.unit)) AS rest").selectExpr("*", "transform(rest, x -> x.bytes) AS sizes")
    one = one.selectExpr("*", "coalesce(array_max(sizes), 0L) AS most", "cast(ceil(alone.rest / alone.k) as bigint) AS even")
    one = one.selectExpr(
        "*",
        f"""aggregate(sequence(1, 64), named_struct('lo', greatest(most, even), 'hi', most + even),
            (r, i) -> if(r.lo >= r.hi, r, if({fill.format(cap=middle)}.n <= alone.k, named_struct('lo', r.lo, 'hi', {middle}), named_struct('lo', {middle} + 1L, 'hi', r.hi)))).lo AS capacity""",
    )
    # the earliest start of each later shard from which greedy filling from the right still gets by
    one = one.selectExpr(
        "*",
        """reverse(aggregate(reverse(sizes), named_struct('i', size(sizes), 'cur', 0L, 'at', cast(array() as array<int>)),
            (s, x) -> if(s.cur + x <= capacity, named_struct('i', s.i - 1, 'cur', s.cur + x, 'at', s.at), named_struct('i', s.i - 1, 'cur', x, 'at', array_append(s.at, s.i)))).at) AS latest""",
    ).selectExpr("*", "concat(array_repeat(0, cast(alone.k as int) - 1 - size(latest)), latest) AS earliest")
    # within these bounds and the capacity, cut where a shard comes nearest to an even share of what is left
    one = one.selectExpr(
        "*",
        """aggregate(sizes, named_struct('i', 0, 'cur', 0L, 'rest', alone.rest, 'cuts', cast(array() as array<int>)),
            (s, x) -> if(s.cur + x > capacity or (size(s.cuts) < alone.k - 1 and s.i >= element_at(concat(earliest, array(0)), size(s.cuts) + 1) and s.cur > 0 and (2 * s.cur + x) * (alone.k - size(s.cuts)) > 2 * s.rest),
                named_struct('i', s.i + 1, 'cur', x, 'rest', s.rest - s.cur, 'cuts', array_append(s.cuts, s.i)),
                named_struct('i', s.i + 1, 'cur', s.cur + x, 'rest', s.rest, 'cuts', s.cuts))).cuts AS cuts""",
    )
    placed = "concat(transform(alone.own, (x, i) -> struct(x as unit, i as shard)), transform(rest, (x, i) -> struct(x.unit as unit, size(alone.own) + size(filter(cuts, c -> c <= i)) as shard)))"
    return one.selectExpr("capacity", f"explode({placed}) AS p").select("p.unit", "p.shard", "capacity")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(units)).cast("int").alias("unit"),
        F.monotonically_increasing_id().alias("mark"),
    )
    rows = materialize(rows, "sizes")
    of_unit = rows.groupBy("unit").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    plan = capacity_plan(of_unit.select("unit", "bytes"), shards)
    earlier = lambda *by: Window.partitionBy(by[0]).orderBy(by[1]).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    bases = of_unit.select("unit", F.greatest(F.ceil(F.col("n") / part_rows), F.least(F.lit(64), F.ceil(F.col("n") / 64))).alias("parts"), "n").join(plan, "unit").select("unit", "shard", "parts", F.coalesce(F.sum("n").over(earlier("shard", "unit")), none).alias("unit_base"))
    bases = materialize(bases, "units")
    dealt = rows.join(F.broadcast(bases), "unit").withColumn("part", F.pmod(F.xxhash64("mark"), F.col("parts")))  # at most ``units`` rows
    offsets = dealt.groupBy("unit", "part").agg(F.count("*").alias("n")).select("unit", "part", F.coalesce(F.sum("n").over(earlier("unit", "part")), none).alias("part_base"))
    within = Window.partitionBy("unit", "part").orderBy("doc_id", "mark")
    numbered = dealt.withColumn("nth", (F.row_number().over(within) - 1).cast("long")).join(offsets, ["unit", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("unit_base") + F.col("part_base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
