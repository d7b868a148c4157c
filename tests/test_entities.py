"""Questions to entities on small graphs: the cascade, versions, codes, clear winners, and what is asked back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import questions, terms
from factloom.operators import entities

NODES = [
    ("n1", "Data Policy v1"), ("n2", "Data Policy v2"), ("n3", "Data Policy"), ("n4", "Security Level 3000"), ("n5", "SL 3000"), ("n6", "SL2000"), ("n7", "Gold Plan"), ("n8", "Gold Plans"),
    ("n9", "Gold Plan"), ("n10", "Retail Digital Hub"), ("n11", "Digital Twins"), ("n12", ""), ("n13", None), ("n14", "Vault_Service (old)"), ("n15", "Broad Catalogue"),
]
ALIASES = [("n4", "security tier"), ("n15", "sl4000 and others"), ("n15", None), ("n10", "hub")]


def run(spark, texts):
    t = F.col("t")
    asks = spark.createDataFrame(list(enumerate(texts)), "q long, t string")
    one = asks.select("q", "t", questions.is_comparison(t).alias("comparison"), questions.compare_sides(t).alias("sides"), questions.is_overview(t).alias("overview"), terms.harvested(t).alias("terms"))
    each = one.select("*", F.posexplode("terms").alias("pos", "term")).withColumn("side", F.array_contains(F.transform("sides", F.lower), F.lower("term")))
    nodes, aliases = spark.createDataFrame(NODES, "id string, name string"), spark.createDataFrame(ALIASES, "node_id string, normalized_alias string")
    found = entities.resolved(each.select("term"), nodes, aliases)
    decisions = entities.decided(each.select("q", "t", "comparison", "side", "term"), found)
    ends = entities.outcomes(one, each.select("q", "term", "pos"), decisions)
    return {(r.q, r.term): r for r in decisions.collect()}, {r.q: r for r in ends.collect()}, found


@pytest.fixture(scope="module")
def told(spark):
    return run(spark, TEXTS)


TEXTS = [
    "What does the Data Policy say?", "Data Policy v2 or Data Policy?", "Where is SL3000 used?", "Compare SL2000 and SL3000", "Is SL4000 here?", "What about Vault Service?", "What about Gold?", "Digital", "The Digital report", "nothing at all", "", "Compare Data Policy and Gold Plan", "the Hub",
]


def test_versions_are_asked_back(told):
    decisions, ends, _ = told
    r = decisions[0, "Data Policy"]
    assert (r.id, r.ambiguous, r.options) == (None, True, ["Data Policy v1", "Data Policy v2"])
    assert (ends[0].clear, ends[0].reason, ends[0].options) == (False, "ENTITY_AMBIGUOUS", ["Data Policy v1", "Data Policy v2"])


def test_a_named_version_rules_out_the_bare_name(told):
    decisions, ends, _ = told
    assert (1, "Data Policy") not in decisions and ends[1].clear
    assert {r.id for (q, _), r in decisions.items() if q == 1} == {"n2"}


def test_codes_bind_to_their_spelling_only(told):
    decisions, ends, _ = told
    assert (decisions[2, "SL3000"].id, decisions[2, "SL3000"].name) == ("n5", "SL 3000")
    assert decisions[4, "SL4000"].id in (None,) or decisions[4, "SL4000"].name != "Broad Catalogue"
    assert not ends[4].clear and ends[4].reason == "ENTITY_NOT_RESOLVED"


def test_comparisons_go_on(told):
    decisions, ends, _ = told
    assert ends[3].clear and ends[3].reason == "" and {decisions[3, "SL2000"].id, decisions[3, "SL3000"].id} == {"n5", "n6"}
    assert ends[11].clear and decisions[11, "Data Policy"].id == "n3"


def test_exact_before_near_and_equal_names_are_one(told):
    decisions, _, found = told
    assert decisions[5, "Vault Service"].id == "n14"
    rows = {(r.term, r.n): r for r in found.collect()}
    assert rows["Gold", "gold plan"].copies == 2 and rows["Gold", "gold plan"].how == "fuzzy"
    assert decisions[6, "Gold"].ambiguous and decisions[6, "Gold"].options == ["Gold Plan", "Gold Plans"]
    assert decisions[12, "Hub"].id == "n10"


def test_artifacts_are_not_asked_back(told):
    decisions, ends, _ = told
    assert decisions[7, "Digital"].ambiguous and not ends[7].clear
    assert not decisions[8, "Digital"].ambiguous and decisions[8, "Digital"].id and ends[8].clear


def test_nothing_to_resolve(told):
    _, ends, _ = told
    assert ends[9].reason == ends[10].reason == "ENTITY_NOT_RESOLVED" and ends[9].entities == 0 and ends[9].options == []


def test_empty_tables(spark):
    nodes, aliases = spark.createDataFrame([], "id string, name string"), spark.createDataFrame([], "node_id string, normalized_alias string")
    asked = spark.createDataFrame([("Gold",), (None,)], "term string")
    assert entities.resolved(asked, nodes, aliases).count() == 0


def test_questions_are_not_sent_to_all_tasks(spark):
    """Files of repeated questions are small, their rows aren't: no join of questions and names goes through the driver."""
    asks = spark.createDataFrame([(i, f"Is SL{i} used?", False, False, f"SL{i}") for i in range(9)], "q long, t string, comparison boolean, side boolean, term string")
    nodes = spark.createDataFrame([(f"n:{i}", f"SL{i}") for i in range(9)], "id string, name string")
    aliases = spark.createDataFrame([(f"n:{i}", f"level {i}") for i in range(9)], "node_id string, normalized_alias string")
    told = entities.decided(asks, entities.resolved(asks.select("term"), nodes, aliases))
    assert "BroadcastHashJoin" not in told._jdf.queryExecution().executedPlan().toString()
    assert told.where("id IS NOT NULL").count() == 9
