"""Shortest paths and ranked trails against plain walks over small graphs."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from factloom.operators import trails
from factloom.plans import catalog
from factloom.plans.datasets import Data
from tests.conftest import SF


def graph(seed: int, nodes: int, edges: int):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(nodes)]
    out = []
    for i in range(edges):
        a, b = (names[0], rng.choice(names[1:])) if i % 5 == 0 else rng.sample(names, 2)  # n0 is a hub
        out.append((f"e{i:03}", a, b, rng.choice(["OWNS", "USES", "CONFLICTS_WITH", "PROVIDES"]), rng.choice([0.5, 1.0, 1.5])))
    return names, out


def walks(names, edges, start: str, hops: int):
    """All simple walks (nodes, edges) from a node."""
    step = {n: [] for n in names}
    for i, a, b, *_ in edges:
        step[a].append((b, i))
        step[b].append((a, i))
    todo, out = [((start,), ())], []
    while todo:
        nodes, ids = todo.pop()
        if ids:
            out.append((nodes, ids))
        if len(ids) < hops:
            todo += [((*nodes, v), (*ids, i)) for v, i in step[nodes[-1]] if v not in nodes]
    return out


def shortest(names, edges, a: str, b: str, hops: int):
    found = [nodes for nodes, _ in walks(names, edges, a, hops) if nodes[-1] == b]
    return min(((len(p) - 1, p) for p in found), default=None)


@pytest.mark.parametrize("hops", [1, 3, 4])
def test_shortest_paths(spark, hops):
    names, edges = graph(hops, 25, 32)
    pairs = [(a, b) for a, b in combinations(names, 2)] + [("n1", "n1"), ("n1", "nowhere"), (None, "n1"), ("n2", "n3"), ("n2", "n3")]
    got = trails.shortest_paths(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(edges, "id string, src string, dst string, rel_type string, weight double"), hops)
    want = {(a, b): w for a, b in combinations(names, 2) if (w := shortest(names, edges, a, b, hops))} | {("n1", "n1"): (0, ("n1",))}
    rows = got.collect()
    assert {(r.a, r.b): (r.hops, tuple(r.path)) for r in rows} == want and len(rows) == len(want)


def test_ranked_trails(spark):
    names, edges = graph(9, 14, 24)
    rng = random.Random(3)
    label = {n: f"Thing {n.upper()} of house" for n in names}
    evidence = [(f"v{i}", e[0], rng.randrange(30), f"quote {i} gold", rng.choice([0.5, 0.9])) for i, e in enumerate(edges * 3) if rng.random() < 0.9]
    evidence += [(f"w{i}", edges[0][0], i, "many", 0.1) for i in range(40)]
    stats = [(e[0], rng.randrange(4), rng.randrange(4)) for e in edges] + [(f"{edges[0][0]}|{edges[1][0]}", 5, 1)]
    asks = [(1, "who owns gold of Thing N3?", ["n3", "n5", "n3"]), (2, "does anything conflict with house", ["n0"]), (3, "related", ["n7", "n8", "n9"]), (4, "nothing", [])]
    make = spark.createDataFrame
    got = trails.ranked_trails(make(asks, "q long, t string, seeds array<string>"), make([(n, label[n]) for n in names], "id string, name string"), make(edges, "id string, src string, dst string, rel_type string, weight double"), make(evidence, "id string, edge_id string, chunk_id long, quote string, confidence double"), make(stats, "key string, won long, lost long"), 3, 24, 8).collect()

    by_id, chunks, quote = {e[0]: e for e in edges}, {}, {}
    for i, e, c, t, conf in evidence:
        chunks.setdefault(e, set()).add(c)
        quote[e] = max(quote.get(e, (0, "", "")), (conf, i, t))
    wins = {k: (a, b) for k, a, b in stats}
    terms = {1: ["owns", "gold", "thing"], 2: ["anything", "conflict", "with", "house"], 3: ["related"]}
    # a house holds "use"
    asked = {1: {"OWNS": 0.25}, 2: {"CONFLICTS_WITH": 0.3, "USES": 0.15}, 3: {}}
    want = []
    for q, _, given in asks:
        seeds = list(dict.fromkeys(given))
        pool = {}
        for s in seeds:
            for nodes, ids in sorted(walks(names, edges, s, 3), key=lambda w: (len(w[1]), w[1]))[:24]:
                pool[nodes, ids] = 0.0
        for a, b in combinations(seeds, 2):
            if w := shortest(names, edges, a, b, 3):
                ids = tuple(min(e[0] for e in edges if {e[1], e[2]} == {u, v}) for u, v in zip(w[1], w[1][1:], strict=False))
                pool[w[1], ids] = 0.22
        rated = []
        for (nodes, ids), pair in pool.items():
            held = set().union(*(chunks.get(i, set()) for i in ids))
            weight = sum(by_id[i][4] for i in ids) / len(ids)
            won, lost = wins.get("|".join(ids), (0, 0))
            fit = won / (won + lost) - 0.5 if won + lost >= 2 else 0.0
            x = min(1.0, 0.72 + 0.06 * len(held) + pair - 0.1 * (len(ids) - 1) + 0.08 * (weight - 1) + 0.22 * fit)
            conflict = any(by_id[i][3] == "CONFLICTS_WITH" for i in ids)
            x *= 0.7 if conflict else 1.0
            x += max([0.0, *(v for k, v in asked[q].items() if any(by_id[i][3] == k for i in ids))])
            blob = " ".join([*(label[n] for n in nodes), *(quote[i][2] for i in ids if i in quote)]).lower()
            rel = sum(t in blob for t in terms[q]) / len(terms[q])
            x += 0.28 * rel - (0.35 if rel < 0.2 else 0.0)
            met = len({label[n] for n in nodes} & {label[s] for s in seeds})
            x += 0.12 * (met - 1) if met >= 2 else 0.0
            rated.append((-round(x, 6), "|".join(ids), len(ids), conflict, bool(held)))
        want += [(q, t, n, c, -x, k, -x >= 0.5 and h) for k, (x, t, n, c, h) in enumerate(sorted(rated)[:8], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def joined_rows(spark, since: int) -> tuple[int, int]:
    """The most rows that a join has made in executions from a number on, and the number of the next."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    most, last, all_ = 0, -1, store.executionsList()
    for e in (all_.apply(i) for i in range(all_.size())):
        last = max(last, e.executionId())
        if e.executionId() < since:
            continue
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, last + 1


def test_first_trails_dont_walk_all(spark):
    """Of a seed's paths only as many go on, and of a node's steps only as many are read, as 24 paths need."""
    edges = [(f"a{i:02}", "seed", f"h{i:02}") for i in range(20)] + [(f"b{i:02}:{j:04}", f"h{i:02}", f"p{i}:{j}") for i in range(20) for j in range(2000)] + [("a00x", "seed", "h00"), ("a01x", "seed", "h00")]
    steps = spark.createDataFrame([(i, u, v) for i, a, b in edges for u, v in ((a, b), (b, a))], "id string, u string, v string")
    _, since = joined_rows(spark, 0)
    got = trails.ego_trails(spark.createDataFrame([("seed",)], "seed string"), steps, 3, 24).collect()
    want = [((i,), ("seed", b)) for i, a, b in edges if a == "seed"] + [(("a00", f"b00:{j:04}"), ("seed", "h00", f"p0:{j}")) for j in range(2)]
    assert sorted((tuple(r.edges), tuple(r.nodes)) for r in got) == sorted(want)
    most, _ = joined_rows(spark, since)
    assert 0 < most <= 1000


@pytest.mark.parametrize("seed", range(3))
def test_first_trails_among_parallel_edges(spark, seed):
    """Steps of one pair of nodes, and steps back, take no other path's place."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(5)]
    edges = [(f"e{i:03}", *(rng.choices(names, k=2) if i % 9 == 0 else rng.sample(names[:2] if i % 3 else names, 2))) for i in range(60)]
    steps = spark.createDataFrame([(i, u, v) for i, a, b in edges for u, v in ((a, b), (b, a))], "id string, u string, v string")
    got = trails.ego_trails(spark.createDataFrame([(n,) for n in [*names, "alone"]], "seed string"), steps, 3, 30).collect()
    want = [(s, ids, nodes) for s in names for nodes, ids in sorted(walks(names, edges, s, 3), key=lambda w: (len(w[1]), w[1]))[:30]]
    assert sorted((r.seed, tuple(r.edges), tuple(r.nodes)) for r in got) == sorted(want)


@pytest.mark.parametrize("listed, entries", [(4096, 16), (4096, 10**9), (2, 10**9), (2, 16)])
def test_shortest_paths_by_every_way(spark, monkeypatch, listed, entries):
    """The last two hops by the node between, by lists and by rows tell the same."""
    monkeypatch.setattr(trails, "LISTED", listed)
    monkeypatch.setattr(trails, "ENTRIES", entries)
    test_shortest_paths(spark, 3)


def test_all_order_lines_are_asked(spark):
    """Pairs of every line of every order, not of some orders' first lines."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("b")).distinct()
    got = {(r.a, r.b) for r in catalog.QUERIES["g02_shortest_paths"](spark, SF).collect()}
    edges = Data(spark, SF).active_edges.select("src", "dst").collect()
    step = {}
    for e in edges:
        step.setdefault(e.src, set()).add(e.dst)
        step.setdefault(e.dst, set()).add(e.src)
    near = lambda n: step.get(n, set())
    want = {(r.a, r.b) for r in named.collect() if any(near(x) & near(r.b) for x in near(r.a))}
    assert got == want and len(want) > 1000
