"""Index-backed retrieval against scoring every pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import questions
from factloom.operators import index
from factloom.plans import retrieval
from factloom.plans.datasets import Data
from factloom.plans.packs import SUITE
from factloom.plans.retrieval import entities
from tests.conftest import SF


def test_candidates_equal_all_pairs(spark):
    d = Data(spark, SF)
    stated = [*SUITE, "Which Apache License applies?", "What's new in the news about Grace Hopper?", "when did Thntion end"]
    asks = spark.createDataFrame([(i, t) for i, t in enumerate(stated)], "q long, t string").unionByName(retrieval.asked(d).where("q % 5 = 0").select((F.col("q") + 1000).alias("q"), "t"))
    own = d.passages.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit("en").alias("lang"), "title", F.col("text").alias("piece"))
    kept = own.where("id < 'p15'").unionByName(retrieval.passages(d).where("doc_id < 40").drop("doc_id"))
    got, read = retrieval.candidates(d, asks, kept, 16)
    shape = questions.evidence_shape(F.col("t"))
    every = asks.crossJoin(kept).select("q", "t", shape.alias("shape"), questions.required_terms(F.col("t")).alias("own"), entities(F.col("t")).alias("named"), "id", "title", "piece")
    want = sorted(map(tuple, retrieval.scored(every).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 80


@pytest.mark.parametrize("size", [4, 50])
def test_blocks_are_pruned_and_nothing_is_lost(spark, size):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(150)]
    table = [(f"p{i}", "xy"[i % 2], " ".join(rng.choice(words[: 75 if i % 2 else 150]) for _ in range(12)), float(rng.randrange(4)), False) for i in range(300)]
    asks = [(i, rng.sample(words, 5) + ["absent term"], [], 0.0, 0.0, False) for i in range(30)] + [(99, [], [], 0.0, 0.0, False)]
    kept = spark.createDataFrame(table, "id string, lang string, low string, plus double, special boolean")
    questions_ = spark.createDataFrame(asks, "q long, terms array<string>, more array<string>, up double, down double, special boolean")
    rate = lambda n, s, m, strong, soft, more, plus: 2.0 * soft + 3.0 * strong + plus
    built = index.build(kept, questions_.select(F.explode("terms").alias("phrase")), "lang", ["plus"], size)
    found, read = index.search(built, questions_, rate, 4)
    names = {(r.block, r.place): r.id for r in built.passages.select("block", "place", "id").collect()}
    got: dict[int, list] = {}
    for r in found.collect():
        got.setdefault(r.q, []).append((-r.low, names[r.block, r.place]))
    for q, terms, *_ in asks:
        scores = [(-(2.0 * sum(t in low for t in terms) + plus), i) for i, _, low, plus, _ in table if any(t in low for t in terms)]
        assert sorted(got.get(q, []))[:4] == sorted(scores)[:4]
    blocks = built.maxima.count()
    if size == 4:
        assert read.count() < 0.8 * blocks * 30


def test_empty_tables(spark):
    kept = spark.createDataFrame([], "id string, lang string, low string, plus double, special boolean")
    asks = spark.createDataFrame([(1, ["a"], [], 0.0, 0.0, False)], "q long, terms array<string>, more array<string>, up double, down double, special boolean")
    built = index.build(kept, asks.select(F.explode("terms").alias("phrase")), "lang", ["plus"])
    assert index.search(built, asks, lambda *a: a[3], 3)[0].count() == 0


def test_facts_come_before_the_pairs(spark):
    """The penalty of a passage is computed below the join with the questions, once for each passage."""
    from factloom.plans import catalog
    from tests.conftest import SF

    for name in ("r16_contract_fit", "r18_quote_support", "r19_graph_base"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Join ")]
        assert "newsletter" in plan and "newsletter" not in above


def test_alike_passages_are_told_k_times(spark):
    """Copies of a passage are told as often as the answer may name them, the first by id, and not as often as there are copies."""
    table = [(f"p{i:02}", "x", "red fox-trot and ed fox", 1.0, False) for i in range(40)] + [("q0", "x", "red fox", 5.0, False)]
    asks = [(1, ["red", "ed fox"], [], 0.0, 0.0, False), (2, ["red", "ed fox"], [], 0.5, 0.5, False)]
    kept = spark.createDataFrame(table, "id string, lang string, low string, plus double, special boolean")
    questions_ = spark.createDataFrame(asks, "q long, terms array<string>, more array<string>, up double, down double, special boolean")
    built = index.build(kept, questions_.select(F.explode("terms").alias("phrase")), "lang", ["plus"])
    found, _ = index.search(built, questions_, lambda n, s, m, strong, soft, more, plus: 2.0 * soft + 3.0 * strong + plus, 4)
    told = found.join(built.passages, ["block", "place"]).select("q", "id").collect()
    assert sorted(r.id for r in told if r.q == 1) == ["p00", "p01", "p02", "p03", "q0"]
    assert sum(r.q == 2 for r in told) == 41  # a margin keeps all


def test_candidates_score_pairs_by_facts_found_before(spark):
    """No pair looks for what its passage or its question tells alone; and facts are found in many parts."""
    kept = spark.createDataFrame([(f"p{i}", "en", "https://x.example/news/item", f"The Apache License {i} applies to the blue widgets of plant {i}.") for i in range(30)], "id string, lang string, title string, piece string")
    asks = spark.createDataFrame([(1, "blue widgets apply"), (2, "Which Apache License applies?"), (3, None)], "q long, t string")
    got, _ = retrieval.candidates(Data(spark, SF), asks, kept)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "newsletter" not in plan and "Agreement|License" not in plan
    assert retrieval.dealt(kept, "id").rdd.getNumPartitions() == retrieval.LEAST_PARTS
    assert {r.q for r in got.collect()} >= {1, 2}


def test_factoids_are_rated_without_a_margin(spark):
    """A factoid's candidates are no more than its best ones and those alike; and they are those of all pairs."""
    texts = [f"The plant of Lyon opened in {1990 + i % 40} with {i % 7} offices and {i},{200 + i} people" + (" for over 12,500 users." if i % 3 else ".") for i in range(60)]
    kept = spark.createDataFrame([(f"p{i:02}", "en", "handbook", t) for i, t in enumerate(texts)], "id string, lang string, title string, piece string")
    asks = spark.createDataFrame([(1, "when did the plant open"), (2, "where are plant offices located")], "q long, t string")
    got, told = None, []
    search = index.search

    def counted(*given):
        found, read = search(*given)
        told.append(found.count())
        return found, read

    try:
        index.search = counted
        got, _ = retrieval.candidates(Data(spark, SF), asks, kept)
    finally:
        index.search = search
    every = asks.crossJoin(kept).select("q", "t", questions.evidence_shape(F.col("t")).alias("shape"), questions.required_terms(F.col("t")).alias("own"), entities(F.col("t")).alias("named"), "id", "title", "piece")
    assert {r.shape for r in every.select("shape").distinct().collect()} == {"factoid"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.scored(every).collect()))
    assert told[0] < 60
