"""Rules of questions, passages and graphs on small cases, most of them worked out by hand."""

from __future__ import annotations

import random
import tracemalloc
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions import evidence, html, questions
from factloom.operators import graph, joins, ordered, topk
from factloom.plans import catalog
from factloom.plans.governance import climb
from factloom.plans.weave import merged_entities
from factloom.streaming import limits
from tests.conftest import SF


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_compare_sides(spark):
    asked = ["Compare SL3000 and SL2000", "difference between the gold plan and a silver plan?", "alpha vs beta", "What is alpha?", "compare X1 and x1 and HDCP22 and OPL270 and AB12 and CD34", ""]
    assert column(spark, asked, questions.compare_sides) == [["SL3000", "SL2000"], ["gold plan", "silver plan"], ["alpha", "beta"], [], ["HDCP22", "OPL270", "AB12", "CD34"], []]
    assert column(spark, asked, questions.is_comparison) == [True, True, True, False, True, False]


def test_shapes(spark):
    asked = {"Who is the Chief People and Leadership Officer?": "attribute", "Leadership team?": "list_people", "weather in Rome": "open", "Who is in the team?": "list_people", "how do I renew it": "how_to", "what is Quartz": "define", "when was it": "factoid", "plain words": "open", "": "open"}
    assert column(spark, list(asked), questions.evidence_shape) == list(asked.values())


def test_terms(spark):
    assert column(spark, ["Who is the CEO of Acme Corp under ISO 27001?"], questions.required_terms)[0][:3] == ["ISO27001", "ISO 27001", "Acme Corp"]
    assert column(spark, ["Where did Grace Hopper sign 'the big form' and SL2000?"], questions.anchors)[0] == ["the big form", "Grace Hopper", "SL 2000", "SL2000"]


def test_people(spark):
    texts = ["Ada Lovelace, Chief Data Officer, met CEO Alan B. Turing and Ada Lovelace - CFO.", "Senior Director CEO, The Board Chairman", "Jean Reid-Dodick\nVice President"]
    assert column(spark, texts, evidence.people) == [["Ada Lovelace", "Alan B. Turing"], [], ["Jean Reid-Dodick"]]


def test_support_and_scores(spark):
    rows = [("What is the Data Vault?", "https://x.com/services/vault", "The Data Vault is a store that provides backups."), ("What is the Data Vault?", "handbook", "Nothing of the kind."), ("Who are the executives?", "https://x.com/about/leaders", "Ada King, CFO. Grace Hopper, CEO. Both have led the house for years.")]
    df = spark.createDataFrame(rows, "q string, title string, t string").withColumn("shape", questions.evidence_shape(F.col("q")))
    df = df.withColumn("fit", evidence.fit(F.col("shape"), F.col("q"), F.col("title"), F.col("t")))
    got = df.select("shape", evidence.support(F.col("shape"), F.col("q"), F.col("title"), F.col("t"), F.col("fit")).alias("s"), evidence.hybrid_score(F.col("shape"), F.col("q"), questions.required_terms(F.col("q")), F.col("title"), F.col("t"), F.lit(0.5)).alias("h"), evidence.entry_score(F.col("shape"), F.col("q"), questions.required_terms(F.col("q")), F.col("title"), F.col("t")).alias("e")).collect()
    assert [r.shape for r in got] == ["define", "define", "list_people"]
    assert got[0].s >= 0.65 and got[1].s == 0.0 and got[0].h > 10 > got[1].h == 0.1 and got[1].e is None and got[2].e == pytest.approx(0.8) and got[2].h > 20


def test_plain_answers(spark):
    assert column(spark, ["A [1]. B\n\nSources:\n[1] x", "[1] [2]", "One [1][2]\nTwo"], evidence.without_references) == ["A [1]. B", "", "One\nTwo"]


def test_people_cards(spark):
    page = '<a href="/profiles/leaders/ada-king"><noscript><img alt="Ada King"></noscript><p>Chief Data Officer</p></a><a href="/team/main-menu" title="Menu">x</a><a href="/people/bob-ray/"></a><a href="/news/x">y</a>'
    assert column(spark, [page, None], lambda c: html.people_lines(c)) == [["Ada King serves as Chief Data Officer.", "Bob Ray is listed among the organization's leaders."], []]


def test_page_text(spark):
    page = """<html><head><title> A  page </title><style>x{}</style></head><body><header>top</header><div class="x cookies">eat</div><main><nav>go</nav><h2>Head</h2><p>One<br>two &amp; <b>three</b></p>
        <ul><li>item</li></ul><div role="navigation"><p>deep</p></div><p>Back</p><a href="/people/bob-ray">Bob</a></main><footer>end</footer><p>outside</p></body></html>"""
    df = spark.createDataFrame([(page, "https://x.com/a"), (None, "https://x.com/b"), ("<p>plain<p>text</div>" + "y" * 90_000, "u")], "h string, u string")
    got = [r.t for r in df.select(html.page_text("h", "u").alias("t")).collect()]
    assert got[0] == "# A page\n\nSource: https://x.com/a\n\n## Head\nOne\ntwo & three\n- item\nBob\n\nBob Ray is listed among the organization's leaders."
    assert got[1] == "# https://x.com/b\n\nSource: https://x.com/b\n\n" and len(got[2]) == len("# u\n\nSource: u\n\n") + 80_000


def test_climb_stops():
    assert [w for *_, w in climb(lambda g: 96.0)] == ["reached"]
    assert [w for *_, w in climb(lambda g: 10.0)] == ["", "", "", "stalled"]
    assert climb(lambda g: float(g), most=3)[-1] == (2, 2.0, "spent")


def test_walks_by_brute_force(spark):
    rng = random.Random(3)
    edges = [(f"e{i}", f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for i in range(60)]
    df = spark.createDataFrame(edges, "id string, src string, dst string").withColumns({"rel_type": F.lit("R"), "weight": F.lit(1.0)})
    near: dict[str, set] = {}
    for _, a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seeds = ["n0", "n1", "n2"]
    want, paths = {}, []
    for s in seeds:
        level, seen = {s}, {s: 0}
        for h in (1, 2, 3):
            level = {y for x in level for y in near.get(x, ()) if y not in seen}
            seen |= dict.fromkeys(level, h)
        want |= {(s, n): h for n, h in seen.items()}
        found, step = [], [[s]]
        for h in (1, 2, 3):
            step = [[*p, y] for p in step for y in near.get(p[-1], ()) if y not in p]
            found += [(h, ">".join(p)) for p in step]
        paths += [(s, p, h) for h, p in sorted(found)[:5]]
    given = spark.createDataFrame([(s,) for s in seeds], "seed string")
    assert {(r.seed, r.node): r.hops for r in graph.reach(given, df, 3).collect()} == want
    assert sorted(map(tuple, graph.ego_paths(given, df, 3, 5).select("seed", "path", "length").collect())) == sorted(paths)


def test_merged_entities(spark):
    names = [("a", "P", "Data Vault"), ("b", "P", "data-vault"), ("c", "P", "Data Vault Pro"), ("d", "T", "Data Vault"), ("e", "T", "Quartz"), ("f", "P", "Data Vault Pro for very large enterprises"), ("g", "P", "v1")]
    got = {r.id: r.root for r in merged_entities(spark.createDataFrame(names, "id string, type string, name string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "g": "g"}


def test_what_must_stay_apart(spark):
    """Versions, a policy and its version, and codes don't become one, nor through others that are related to both."""
    names = [("a", "C", "Data Policy v1"), ("b", "C", "Data Policy v2"), ("c", "C", "Data Policy"), ("d", "C", "data-policy"), ("e", "C", "SL200"), ("f", "C", "SL2000"), ("g", "C", "Big Data Policy v1"), ("h", "C", "SL200"), ("i", "C", "Policy"), ("j", "T", "Data Policy v2")]
    got = {r.id: (r.root, r.alias) for r in merged_entities(spark.createDataFrame(names, "id string, type string, name string")).collect()}
    assert got == {"a": ("a", ""), "b": ("b", ""), "c": ("c", ""), "d": ("c", "data-policy"), "e": ("e", ""), "f": ("f", ""), "g": ("a", "big data policy v1"), "h": ("e", ""), "i": ("c", "policy"), "j": ("b", "")}


def test_merging_by_brute_force(spark):
    rng = random.Random(12)
    words = ["data", "vault", "policy", "cloud", "v1", "v2", "pro", "sl20", "sl200", "x"]
    table = [(f"i{i:03}", rng.choice("CT"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(150)]
    key = lambda n: re.sub("[^a-z0-9]", "", n)
    code = lambda k: re.fullmatch(r"[a-z]{1,8}\d{2,}", k)
    root = {i: i for i, _, _ in table}

    def one(x, y) -> bool:
        (_, s, a), (_, t, b) = x, y
        if a == b:
            return True
        if s != t or re.findall(r"\d+", a) != re.findall(r"\d+", b):
            return False
        short, long = sorted((key(a), key(b)), key=len)
        return short == long or (len(short) >= 6 and not code(short) and not code(long) and short in long and len(long) <= 2.2 * len(short))

    for x in table:
        for y in table:
            if one(x, y) and root[x[0]] != root[y[0]]:
                low, high = sorted((root[x[0]], root[y[0]]))
                root = {i: low if r == high else r for i, r in root.items()}
    got = merged_entities(spark.createDataFrame(table, "id string, type string, name string")).collect()
    assert {r.id: r.root for r in got} == root and len(set(root.values())) > 10


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from factloom.operators import components as module

    written = []
    own = module.cut
    monkeypatch.setattr(module, "cut", lambda df: written.append(1) or own(df))
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [("z", "z"), ("y1", "y2")]
    got = {r.node: r.root for r in module.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:04}": "n0000" for i in range(301)} | {"y1": "y1", "y2": "y1"} and len(written) < 20


def test_fuzzy_links_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(2, 9)))
    names, terms = [(f"n{i}", word()) for i in range(60)], sorted({word() for _ in range(40)})
    want = []
    for t in terms:
        best: dict[str, tuple] = {}
        for i, n in names:
            if len(t) < 4 or len(n) < 4:
                continue
            cls = 0 if t == n else 1 if n.startswith(t) or t.startswith(n) else 2 if (len(t) >= 5 and t in n) or (len(n) >= 5 and n in t) else None
            if cls is not None:
                best[i] = min(best.get(i, (9, 9)), (cls, abs(len(t) - len(n))))
        want += [(t, i, r + 1) for r, (_, i) in enumerate(sorted((b, i) for i, b in best.items())[:4])]
    got = joins.fuzzy_link(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(names, "id string, normalized_name string"), 4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nearest_scores_few_queries_at_a_time():
    x = np.random.default_rng(3).normal(size=(4000, 4))
    block = pa.table({"ask": np.arange(4000) % 2 == 0, "vec_id": np.arange(4000), "embedding": pa.array(list(x))})
    tracemalloc.start()
    assert topk.best_of_block(3)(block).num_rows == 6000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000  # all scores at once take 32 MB, twice


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 11)
    x = np.random.default_rng(2).normal(size=(60, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(i, r + 1, j) for i in range(0, 60, 3) for r, (_, j) in enumerate(sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in range(60) if j != i)[:4])]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in topk.nearest(v.where("vec_id % 3 = 0"), v, 4).collect()) == want


def test_learned_weights_in_pieces(spark):
    rng = random.Random(7)
    rows = [(f"k{rng.randrange(3)}", f"2024-01-0{rng.randint(1, 3)} 0{rng.randrange(3)}:{rng.randrange(10, 60)}:00", i, rng.random() < 0.8) for i in range(400)]
    want = {}
    for key in ("k0", "k1", "k2"):
        w = 1.0
        for *_, won in sorted((t, i, won) for k, t, i, won in rows if k == key):
            w = min(2.8, max(0.12, w + (0.045 if won else -0.04)))
        want[key] = round(w, 6)
    df = spark.createDataFrame(rows, "key string, ts string, id int, won boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.key: r.weight for r in ordered.learned_weight(df, "key", ["ts", "id"], "won").collect()} == pytest.approx(want)
    counted = ordered.running_count(df, "key", ["ts", "id"], "won", "n").collect()
    assert all(r.n == sum(w for k, t, i, w in rows if k == r.key and (t, i) <= (str(r.ts), r.id)) for r in counted)


def test_rate_limit_across_pauses(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(4), float(rng.randrange(40_000))) for i in range(600)]
    want = {}
    for key in range(4):
        recent = []
        for t, i in sorted((t, i) for i, k, t in rows if k == key):
            recent = [r for r in recent if t - r <= 50]
            want[i] = len(recent) < 2
            recent += [t] if want[i] else []
    df = spark.createDataFrame(rows, "event_id long, key long, s double").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    assert {r.event_id: r.accepted for r in limits.rate_limited(df, 2, 50).collect()} == want


def test_local_embedding_is_deterministic(spark):
    got = catalog.QUERIES["r29_local_embedding"](spark, SF).collect()
    again = {r.id: r.embedding for r in catalog.QUERIES["r29_local_embedding"](spark, SF).collect()}
    assert all(len(r.embedding) == 384 and abs(np.linalg.norm(r.embedding) - 1) < 1e-5 and again[r.id] == r.embedding for r in got)


def test_quarantine_alone(spark):
    """The quarantine signal alone equals that among all signals, on short, wordless and framed passages."""
    from factloom.functions import text as rules

    rows = [("t", x) for x in ("", "a b", "word " * 11, "word " * 12, "Site map | Home | Cookie policy | Sign in " * 4, "site map cookie policy all rights reserved accept all follow us subscribe newsletter " * 2, "12 34 " * 60, "éà ù " * 90, "x" * 700, "Read More About Us Home Team Menu Page Learn Here Click Info View " * 3, "one two three " + "1 " * 150, "a bc " * 200 + "word " * 11)]
    df = spark.createDataFrame(rows, "title string, body string")
    t, b = F.col("title"), F.col("body")
    got = df.withColumn("parts", rules.quarantine_parts(t, b)).withColumn("chrome", rules.quarantine_chrome(F.col("parts"), t, b)).select(rules.quarantined(F.col("parts"), F.col("chrome")).alias("q"), rules.passage_struct(t, b)["quarantine"].alias("want"))
    assert all(r.q == r.want for r in got.collect()) and len({r.q for r in got.collect()}) == 2


def test_flagship_shuffles_no_text(spark):
    """No exchange of the flagship carries texts."""
    from factloom.operators import retrieval

    docs = spark.createDataFrame([(1, "some text here", "s", 14)], "doc_id long, text string, source string, n_chars long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = retrieval.lexical_pack(docs, ["some", "text"], 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert shuffles and "SortMergeJoin" not in plan
