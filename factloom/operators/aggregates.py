"""Aggregations behind the knowledge reports, as functions of DataFrames and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_success(outcomes: DataFrame, key: str) -> DataFrame:
    wins, losses = F.count_if("won"), F.count_if(~F.col("won"))
    return outcomes.groupBy(key).agg(wins.alias("wins"), losses.alias("losses"), F.round(100.0 * wins / F.count("*"), 0).alias("success"))


def version_changes(old: DataFrame, new: DataFrame, least: float = 0.02) -> DataFrame:
    """id, change between two versions (id, old) and (id, new)."""
    gain = F.col("new") - F.col("old")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(gain >= least, "strengthened").when(-gain >= least, "weakened").otherwise("same")
    return old.join(new, "id", "full").select("id", change.alias("change"))


def slos(messages: DataFrame) -> DataFrame:
    """asks, refusal_rate, answer_rate, avg_trust; a missing trust counts 0."""
    share = lambda kind: F.round(F.avg(F.when(F.col("decision") == kind, 1.0).otherwise(0.0)), 4)
    return messages.agg(F.count("*").alias("asks"), share("refuse").alias("refusal_rate"), share("answer").alias("answer_rate"), F.round(F.avg(F.coalesce("trust", F.lit(0.0))), 3).alias("avg_trust"))


def coverage(pages: DataFrame) -> DataFrame:
    """section, pages, linked_pages, coverage_pct of rows (section, linked or null)."""
    return pages.groupBy("section").agg(F.count("*").alias("pages"), F.count("linked").alias("linked_pages"), F.round(100.0 * F.count("linked") / F.count("*"), 1).alias("coverage_pct"))


def health_score(ingest: Column, embed: Column, evidence: Column, connectivity: Column, dupes: Column, passages: Column) -> Column:
    return F.round(100 * (0.22 * ingest + 0.18 * embed + 0.22 * evidence + 0.18 * connectivity + 0.10 * dupes + 0.10 * passages), 1)


#: Drivers of knowledge debt.
DRIVERS = ("topics", "weak_edges", "conflicts", "unanswered", "trust", "coverage")


def debt(rows: DataFrame) -> DataFrame:
    """k, the drivers' points, score and status of rows (k, cover, trust, conflicts, weak, asserted, unanswered, gaps)."""
    c = F.col
    cap = lambda most, x: F.least(F.lit(float(most)), x.cast("double"))
    points = {
        "topics": 0.08 * cap(20, c("gaps") * 4.0),
        "weak_edges": 0.16 * cap(40, 100.0 * c("weak") / F.greatest(c("asserted"), F.lit(1))),
        "conflicts": 0.18 * cap(30, c("conflicts") * 4.0),
        "unanswered": 0.12 * cap(25, c("unanswered") * 2.5),
        "trust": 0.18 * (100 - 100 * c("trust")),
        "coverage": 0.28 * F.greatest(F.lit(0.0), 100.0 - c("cover")),
    }
    scored = rows.select("k", *(F.round(points[n], 1).alias(n) for n in DRIVERS))
    total = F.round(F.least(F.lit(100.0), sum((c(n) for n in DRIVERS[1:]), c(DRIVERS[0]))), 1)
    return scored.withColumn("score", total).withColumn("status", F.when(c("score") < 12, "healthy").when(c("score") < 28, "watch").otherwise("elevated"))


def improvement(debts: DataFrame, steps: int = 3) -> DataFrame:
    """k, driver, step, remaining: debt left after each of the largest drivers."""
    each = debts.select("k", "score", F.explode(F.array(*(F.struct(F.lit(n).alias("driver"), F.col(n).alias("v")) for n in DRIVERS))).alias("x")).select("k", "score", "x.driver", "x.v")
    w = Window.partitionBy("k").orderBy(F.desc("v"), "driver")
    ranked = each.select("*", F.row_number().over(w).alias("step"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("gone")).where(F.col("step") <= steps)
    return ranked.select("k", "driver", "step", F.round(F.greatest(F.lit(0.0), F.col("score") - F.col("gone")), 1).alias("remaining"))


def fitness(cover: Column, accept: Column, docs: Column, conflicts: Column) -> Column:
    """An acceptance of 0 counts as the default of one half."""
    raw = 0.45 * cover + 0.35 * 100 * F.coalesce(F.nullif(accept, F.lit(0.0)), F.lit(0.5)) + 0.20 * F.least(F.lit(100), 40 + docs) - F.least(F.lit(25.0), 2.5 * conflicts)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 1)))


def evidence_quality(cover: Column, trust_pct: Column, age_days: Column, conflicts: Column) -> Column:
    fresh = F.greatest(F.lit(0.0), 100 - F.least(F.lit(90.0), age_days / 4.0))
    consistent = F.greatest(F.lit(0.0), 100 - F.least(F.lit(80.0), conflicts * 8.0))
    return F.round(0.28 * cover + 0.24 * trust_pct + 0.24 * fresh + 0.24 * consistent, 1)


def sla(rows: DataFrame, cover: Column, debt_: Column, conflicts: Column, targets: tuple[float, float, int] = (90.0, 10.0, 5)) -> DataFrame:
    """Rows with passing and cta, the step against the gravest failure."""
    low, owed, torn = cover < targets[0], debt_ > targets[1], conflicts > targets[2]
    return rows.withColumn("passing", ~(low | owed | torn)).withColumn("cta", F.when(torn, "scan_conflicts").when(owed, "playbook").when(low, "connect"))


def value_conflicts(facts: DataFrame) -> DataFrame:
    """src, n, amounts of entities with two or more distinct amounts; amounts are collapsed before they are gathered."""
    distinct = facts.select("src", "amount").distinct().groupBy("src").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("amount").cast("string"))), ",").alias("amounts"))
    return distinct.where("n >= 2")


def hygiene(nodes: DataFrame, edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """what, n: counts of the graph's faults."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    seen = nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    one = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    paths = outcomes.groupBy("path_key").agg(F.count_if("won").alias("w"), F.count_if(~F.col("won")).alias("l"))
    parts = [
        one("unused_nodes", seen.where("degree = 0")),
        one("orphan_topics", seen.where("lower(type) IN ('topic', 'concept', 'section') AND degree <= 1")),
        one("duplicate_entities", nodes.where("char_length(normalized_name) >= 3").groupBy("normalized_name").count().where("count > 1")),
        one("weak_edges", edges.where("edge_class = 'asserted_fact' AND weight < 0.55")),
        one("broken_links", ends.join(nodes.select("id"), "id", "left_anti")),
        one("stale_paths", paths.where("l >= 3 AND l > w")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def trust_status(nodes: Column, conflicting: Column, asks: Column, grounded: Column, evidence: Column) -> Column:
    """building without nodes, review with conflicts or ungrounded answers, trusted with enough evidence."""
    review = conflicting | ((asks >= 3) & (grounded < 70))
    trusted = ((asks == 0) & (evidence >= 50)) | (grounded >= 70) | (evidence >= 75)
    return F.when(nodes == 0, "building").when(review, "review").when(trusted, "trusted").otherwise("review")
