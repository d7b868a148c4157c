"""Known answers and brute-force checks of operators that SQL doesn't cover."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions import html, text, web
from factloom.operators import chunks, dedupe, graph, ordered
from factloom.plans import catalog, datasets
from factloom.streaming import limits
from tests.conftest import SF


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_known_answers(spark):
    assert one(spark, "Loan Amount = $500,000", text.amount) == 500000.0
    assert one(spark, "SL2000", text.amount) == 0.0
    assert one(spark, "https://x.com/about-us/leaders", web.section) == "identity"
    assert one(spark, "https://x.com/news/press", web.section) == "chronicle"
    assert one(spark, "https://x.com/about/leaders", web.trust_weight) > one(spark, "https://x.com/news/press", web.trust_weight)
    assert one(spark, "/a/b/c", web.ancestors) == ["/a/b", "/a", "/"]
    assert one(spark, "How are you?", text.is_greeting)
    assert one(spark, "you are a b.i.t.c.h", text.moderation) is None and one(spark, "fuck  you", text.moderation) == "INAPPROPRIATE_ABUSE"
    hours = spark.range(24).select(text.in_window(F.col("id"), 2, 3).alias("b")).collect()
    assert [i for i, r in enumerate(hours) if r.b] == [2, 3, 4]


def test_chunk_spans():
    assert list(chunks.cut("x" * 2000, 900, 120)) == [(0, 900), (780, 1680), (1560, 2000)]
    broken = "x" * 500 + "\n\n" + "y" * 700
    assert list(chunks.cut(broken, 900, 120))[:2] == [(0, 500), (380, len(broken))]
    assert list(chunks.cut("", 900, 120)) == []


def test_html():
    page = html._contents.__wrapped__ if hasattr(html._contents, "__wrapped__") else html._contents
    import pandas as pd

    r = page(pd.Series(["<title>T</title><nav>menu</nav><main><h1>Head</h1><p>Body <b>text</b></p><ul><li>item</li></ul><a href='/x'>l</a></main><script>x</script>", None])).iloc[0]
    assert r.title == "T" and r.links == ["/x"] and r.text.split("\n") == ["# Head", "Body text", "- item", "l"]


def test_weights_clamp_in_order(spark):
    rows = [("a", i, True) for i in range(60)] + [("b", i, False) for i in range(40)] + [("b", 40, True)]
    got = {r.k: r.weight for r in ordered.learned_weight(spark.createDataFrame(rows, "k string, t int, won boolean"), "k", ["t"], "won").collect()}
    assert got == {"a": 2.8, "b": 0.165}


def test_rate_limit_forgets_rejected_hits(spark):
    hits = [(i, 1, i) for i in range(61)] + [(61, 1, 61)]
    passed, _ = limits.admit([t for *_, t in hits], [], 60, 60)
    assert passed == [True] * 60 + [False, True]
    df = spark.createDataFrame([(i, k, t) for i, k, t in hits], "event_id long, key long, t long").select("event_id", "key", F.timestamp_seconds("t").alias("ts"))
    assert [r.accepted for r in limits.rate_limited(df, 60, 60).orderBy("event_id").collect()] == passed


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("won"))
    events.repartitionByRange(1, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, out, mode, want in (
        ("limited", limits.rate_limit_stream(stream.select("event_id", "key", "ts"), 2, 7200), "append", limits.rate_limited(events.select("event_id", "key", "ts"), 2, 7200)),
        ("counters", limits.outcome_counters(stream.withColumn("path_key", F.col("key") % 7)), "complete", limits.outcome_counters(events.withColumn("path_key", F.col("key") % 7))),
    ):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(spark.table(name).collect()) == sorted(want.collect())


def test_near_duplicates_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    tf = {i: Counter(re.findall(r"\b\w\w+\b", t.lower())) for i, t in rows}
    cf, df = Counter(), Counter()
    for c in tf.values():
        cf.update(c)
        df.update(c.keys())
    top = {t for t, _ in sorted(cf.items(), key=lambda x: (-x[1], x[0]))[:4096]}
    vec = {}
    for i, c in tf.items():
        v = {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if t in top}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {t: x / norm for t, x in v.items()} if norm else {}
    kept, want = [], {}
    for i in sorted(vec):
        near = any(round(sum(x * vec[j].get(t, 0.0) for t, x in vec[i].items()), 9) >= 0.85 for j in kept)
        want[i] = "skip_near" if near else "keep"
        if not near:
            kept.append(i)
    got = {r.id: r.decision for r in dedupe.near_duplicates(spark.createDataFrame(rows, "id long, text string"), 0.85).collect()}
    assert got == want


def test_near_duplicates_pairs_one_of_equal_texts(spark, monkeypatch):
    seen, pairs_of = [], dedupe.similar_pairs
    monkeypatch.setattr(dedupe, "similar_pairs", lambda *a: seen.append(pairs_of(*a)) or seen[-1])
    base, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"else{i}" for i in range(60))
    texts = [base + " tail"] + [base] * 150 + [other] * 150 + ["", "", None, None, "?", "?"]
    got = {r.id: r.decision for r in dedupe.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.85).collect()}
    assert got == {i: "keep" if i in (0, 151) or i > 300 else "skip_near" for i in range(len(texts))}
    assert [tuple(r) for r in seen[0].collect()] == [(0, 1)]


def test_ego_paths_of_a_cycle(spark):
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("4", "1")], "src string, dst string").select(F.monotonically_increasing_id().cast("string").alias("id"), "src", "dst", F.lit("R").alias("rel_type"), F.lit(1.0).alias("weight"))
    got = graph.ego_paths(spark.createDataFrame([("1",)], "seed string"), edges, 3, 24).groupBy("length").count().collect()
    assert {r.length: r["count"] for r in got} == {1: 2, 2: 2, 3: 2}


@pytest.mark.parametrize("budget", [0, 1, 5, 9, 400])
def test_weave_sample_takes_as_a_plain_loop_does(spark, budget):
    rng = random.Random(budget)
    rows = [(ws, f"{ws}{rng.randrange(docs)}", i, rng.randrange(50), rng.choice([None, 1, 5, 90, rng.randrange(100)])) for i, (ws, docs) in enumerate([("big", 3)] * 200 + [("many", 40)] * 60 + [("one", 1)])]
    want = set()
    for ws in ("big", "many", "one"):
        ranked = sorted((r for r in rows if r[0] == ws), key=lambda r: (-(r[4] or 0), r[2]))
        docs: dict = {}
        for r in ranked:
            docs.setdefault(r[1], []).append(r)
        order = [r for d in docs.values() for r in sorted(d, key=lambda r: (r[3], r[2]))[:2]] + ranked[:: max(1, len(ranked) // max(1, budget))] + ranked
        taken = list(dict.fromkeys(r[2] for r in order))[:budget]
        want |= {(ws, i, p + 1) for p, i in enumerate(taken)}
    got = dedupe.weave_sample(spark.createDataFrame(rows, "ws string, doc string, id long, ordinal int, size int"), budget)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("margin", [1e-3, 2.0])
def test_similar_pairs_of_many_blocks(spark, monkeypatch, margin):
    """One token in all vectors: blocks and their inner parts give every near pair once, by single as by double precision."""
    for name, value in (("LEAST_BLOCK", 7), ("MOST_BLOCK", 9), ("DENSE", 4), ("MARGIN", margin)):
        monkeypatch.setattr(dedupe, name, value)
    made = random.Random(8)
    x = [{"all": 1.0} | {f"t{made.randrange(9)}": made.random() * 2 for _ in range(3)} for _ in range(50)]
    x = [{t: w / math.sqrt(sum(v * v for v in r.values())) for t, w in r.items()} for r in x]
    df = Counter(t for r in x for t in r)
    rows = spark.createDataFrame([(i, t, df[t], w) for i, r in enumerate(x) for t, w in r.items()], "id long, token string, df long, w double")
    want = sorted((a, b) for b in range(50) for a in range(b) if round(sum(w * x[b].get(t, 0.0) for t, w in x[a].items()), 9) >= 0.85)
    assert sorted(map(tuple, dedupe.similar_pairs(rows, 0.85).collect())) == want and len(want) > 40


def test_reach_writes_sets_not_pairs(spark, monkeypatch):
    written, keep = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(keep(df)) or written[-1])
    spokes = [("hub", f"n{i:03}") for i in range(200)]
    edges = spark.createDataFrame(spokes, "src string, dst string").select("dst", "src", F.col("dst").alias("id"), F.lit("R").alias("rel_type"), F.lit(1.0).alias("weight"))
    got = graph.reach(spark.createDataFrame([(n,) for _, n in spokes] + [("alone",)], "seed string"), edges, 3).collect()
    want = {(a, b): 0 if a == b else 2 for _, a in spokes for _, b in spokes} | {(n, "hub"): 1 for _, n in spokes} | {("alone", "alone"): 0}
    assert {(r.seed, r.node): r.hops for r in got} == want and len(got) == len(want)
    assert max(w.count() for w in written) <= 400


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(datasets, "PART_ROWS", 1000)
    monkeypatch.setattr(datasets, "LEAST_PARTS", 1)
    d = datasets.Data(spark, SF)
    assert d.edge_parts == -(-d.table("lineitem").count() // 1000) > 4
    assert {catalog.QUERIES[q](spark, SF).rdd.getNumPartitions() for q in ("g01_adjacency", "d07_undirected", "d08_natural_key")} == {d.edge_parts}
