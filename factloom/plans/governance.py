"""Labels, roll-ups and write-side rules of workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import aggregates, graph, joins
from factloom.operators.lineage import cut
from factloom.plans.datasets import Data
from factloom.plans.registry import query
from factloom.sources import sinks
from factloom.plans.relational import _DEBT, _debt_in

#: Words of regulated domains.
REGULATED = ("health", "bank", "insur", "legal", "pharma", "financ", "bfsi", "clinic")
#: What upkeep may do: watch, mend, or only with a person.
MAINTAIN = ("conflict_edges", "metric_snapshot", "entity_summaries")
GOVERN = ("accept_drafts", "reject_drafts", "promote_versions", "rollback_versions", "policy_locks", "ingest_knowledge", "rewrite_hierarchy", "rewrite_locked_facts")
FEATURES = ("hygiene_scan", "health_flags", "drift_flags", "source_watch", *MAINTAIN, *GOVERN, "something_new")
LABELS = ("Retail", "Health Care", "the Legal desk", "Sports", "BFSI", "Museum", "clinical trials", "Banking")


@query("f22_regulated_verify", """WITH m AS (SELECT id, trust, ['Retail', 'Health Care', 'the Legal desk', 'Sports', 'BFSI', 'Museum', 'clinical trials', 'Banking'][CAST(conv_id % 8 + 1 AS BIGINT)] AS label FROM messages WHERE role = 'assistant')
    SELECT id, label, coalesce(trust, 0) < 0.55 OR regexp_matches(lower(label), 'health|bank|insur|legal|pharma|financ|bfsi|clinic') AS verify FROM m""")
def _(d: Data) -> DataFrame:
    """Answers to verify: of low trust, or of a workspace whose label names a regulated domain."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("conv_id") % len(LABELS) + 1).cast("int"))
    m = d.messages.where("role = 'assistant'").select("id", "trust", label.alias("label"))
    return m.select("id", "label", ((F.coalesce("trust", F.lit(0.0)) < 0.55) | F.lower("label").rlike("|".join(REGULATED))).alias("verify"))


@query("f23_features", """SELECT feature, CASE WHEN feature IN ('accept_drafts', 'reject_drafts', 'promote_versions', 'rollback_versions', 'policy_locks', 'ingest_knowledge', 'rewrite_hierarchy', 'rewrite_locked_facts') THEN 'govern' WHEN feature IN ('conflict_edges', 'metric_snapshot', 'entity_summaries') THEN 'maintain' ELSE 'observe' END AS bucket
    FROM (SELECT unnest(['hygiene_scan', 'health_flags', 'drift_flags', 'source_watch', 'conflict_edges', 'metric_snapshot', 'entity_summaries', 'accept_drafts', 'reject_drafts', 'promote_versions', 'rollback_versions', 'policy_locks', 'ingest_knowledge', 'rewrite_hierarchy', 'rewrite_locked_facts', 'something_new']) AS feature UNION SELECT DISTINCT event_type FROM events)""")
def _(d: Data) -> DataFrame:
    """Features by what upkeep may do with them; unknown ones are only watched."""
    stated = d.spark.range(1).select(F.explode(F.array(*map(F.lit, FEATURES))).alias("feature"))
    f = F.col("feature")
    return stated.union(d.events.select("event_type")).distinct().select("feature", F.when(f.isin(*GOVERN), "govern").when(f.isin(*MAINTAIN), "maintain").otherwise("observe").alias("bucket"))


@query("f25_agent_readiness", """WITH c AS (SELECT c_nationkey AS k, count(*) AS nodes FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS docs, max(s_acctbal) AS top FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
    SELECT n_nationkey AS agent, CASE WHEN starts_with(upper(n_name), 'I') THEN 'disabled' WHEN coalesce(top, 0) > 9000 THEN 'live' WHEN coalesce(docs, 0) > 0 OR coalesce(nodes, 0) > 0 THEN 'ready' ELSE 'draft' END AS label FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def _(d: Data) -> DataFrame:
    """Agents as disabled, live once published, ready with any content, else draft."""
    c = d.table("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("agent")).agg(F.count("*").alias("nodes"))
    s = d.table("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("agent")).agg(F.count("*").alias("docs"), F.max("s_acctbal").alias("top"))
    n = d.table("nation").select(F.col("n_nationkey").alias("agent"), F.upper("n_name").startswith("I").alias("disabled")).join(c, "agent", "left").join(s, "agent", "left")
    return n.select("agent", F.when(F.col("disabled"), "disabled").when(F.col("top") > 9000, "live").when((F.coalesce("docs", F.lit(0)) > 0) | (F.coalesce("nodes", F.lit(0)) > 0), "ready").otherwise("draft").alias("label"))


@query("s28_purged_graph", """WITH gone AS (SELECT id FROM kg_nodes WHERE id IN (SELECT 'supplier:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)), e AS MATERIALIZED (SELECT id, src, dst FROM kg_edges), keep AS MATERIALIZED (SELECT id FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone))
    SELECT 'nodes' AS what, (SELECT count(*) FROM kg_nodes) AS before, (SELECT count(*) FROM kg_nodes WHERE id NOT IN (SELECT id FROM gone)) AS after UNION ALL SELECT 'edges', (SELECT count(*) FROM e), (SELECT count(*) FROM keep) UNION ALL SELECT 'evidence', (SELECT count(*) FROM kg_evidence), (SELECT count(*) FROM kg_evidence v SEMI JOIN keep ON keep.id = v.edge_id)""")
def _(d: Data) -> DataFrame:
    """What a purge of one region's suppliers leaves: nodes, the edges between what is left, their evidence."""
    region = d.table("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    gone = d.table("supplier").join(region, "s_nationkey", "left_semi").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    keep = graph.purged(d.edges, gone)
    count = lambda name, before, after: before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).select(F.lit(name).alias("what"), "before", "after")  # noqa: E731  # one row each
    evidence = d.evidence.select(F.col("edge_id").alias("id"))
    return count("nodes", d.nodes, d.nodes.join(gone, "id", "left_anti")).union(count("edges", d.edges, keep)).union(count("evidence", evidence, evidence.join(keep.select("id"), "id", "left_semi")))


@query("s34_changed_rows", """WITH c AS (SELECT user_id % 200 AS id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 'accepted' WHEN event_type = 'error' THEN 'rejected' END AS status, CASE WHEN event_type = 'view' THEN value END AS score FROM events), l AS (SELECT id, arg_max(score, (ts, event_id)) FILTER (score IS NOT NULL) AS score, arg_min(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status FROM c GROUP BY 1)
    SELECT p_partkey AS id, coalesce(l.score, p_retailprice)::DOUBLE AS score, coalesce(l.status, 'draft') AS status FROM part LEFT JOIN l ON l.id = p_partkey""")
def _(d: Data) -> DataFrame:
    """Rows updated in place from a log of changes: the last given score wins, a status leaves draft once and then stays."""
    when, status = F.struct("ts", "event_id"), F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected")
    c = d.events.select((F.col("user_id") % 200).alias("id"), when.alias("at"), status.alias("status"), F.when(F.col("event_type") == "view", F.col("value")).alias("score"))
    latest = c.groupBy("id").agg(F.max(F.when(F.col("score").isNotNull(), F.struct("at", "score")))["score"].alias("score"), F.min(F.when(F.col("status").isNotNull(), F.struct("at", "status")))["status"].alias("status"))
    rows = d.table("part").select(F.col("p_partkey").alias("id"), "p_retailprice").join(latest, "id", "left")
    return rows.select("id", F.coalesce("score", "p_retailprice").cast("double").alias("score"), F.coalesce("status", F.lit("draft")).alias("status"))


_PATCHES = "ch AS MATERIALIZED (SELECT user_id AS id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 'accepted' WHEN event_type = 'error' THEN 'rejected' END AS status, CASE WHEN event_type = 'view' THEN value END AS balance, event_type AS member, value FROM events)"


@query("s34_patched_rows", f"""WITH {_PATCHES}, l AS (SELECT id, arg_max(balance, (ts, event_id)) FILTER (balance IS NOT NULL) AS balance, arg_min(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status FROM ch GROUP BY 1),
    m AS (SELECT id, member, arg_max(CAST(floor(value) AS BIGINT)::VARCHAR, (ts, event_id)) AS v FROM ch GROUP BY 1, 2), o AS (SELECT c_custkey AS id, unnest(['segment', 'view']) AS member, unnest(['\"' || c_mktsegment || '\"', '-1']) AS v FROM customer),
    p AS (SELECT id, '{{' || string_agg('\"' || member || '\":' || v, ',' ORDER BY member) || '}}' AS props FROM (SELECT o.id, o.member, o.v FROM o LEFT JOIN m ON m.id = o.id AND m.member = o.member WHERE m.id IS NULL UNION ALL SELECT m.id, m.member, m.v FROM m) GROUP BY 1)
    SELECT c_custkey AS id, c_name AS name, coalesce(l.balance, c_acctbal)::DOUBLE AS balance, CASE WHEN c_custkey % 7 = 0 THEN 'closed' ELSE coalesce(l.status, 'draft') END AS status, props FROM customer LEFT JOIN l ON l.id = c_custkey JOIN p ON p.id = c_custkey""")
def _(d: Data) -> DataFrame:
    """Customers updated in place from the log of events: the last balance wins, a status leaves draft once, props are merged by member; names, which no change may touch, and users without a row stay out."""
    k, e = F.col("c_custkey"), F.col("event_type")
    old = d.table("customer").select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"), F.when(k % 7 == 0, "closed").otherwise("draft").alias("status"), F.concat(F.lit('{"segment":"'), "c_mktsegment", F.lit('","view":-1}')).alias("props"))
    status = F.when(e == "purchase", "accepted").when(e == "error", "rejected")
    changes = d.events.select(F.col("user_id").alias("id"), "ts", "event_id", status.alias("status"), F.when(e == "view", F.col("value")).alias("balance"), F.concat(F.lit('{"'), e, F.lit('":'), F.floor("value").cast("string"), F.lit("}")).alias("props"), F.lit("x").alias("name"))
    return sinks.patched(old, changes, ["id"], ["ts", "event_id"], ["balance"], "props", {"status": "draft"})


@query("s26_latest_health", "SELECT user_id AS ws, arg_max(value, (ts, event_id)) AS score, arg_max(event_type, (ts, event_id)) AS state, count(*) AS writes FROM events GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Health of every workspace: the last write wins."""
    last = F.max(F.struct("ts", "event_id", "value", "event_type"))
    return d.events.groupBy(F.col("user_id").alias("ws")).agg(last.alias("l"), F.count("*").alias("writes")).select("ws", F.col("l.value").alias("score"), F.col("l.event_type").alias("state"), "writes")


@query("a30_impact_debt", rf"""WITH p AS ({_DEBT}), c AS (SELECT n_nationkey AS k, bool_or(regexp_matches(lower(p_type || ' ' || p_name || CASE WHEN p_size > 45 THEN ' policy' ELSE '' END), 'complian|regulat|policy|legal|security|privacy|mortgage|hipaa')) AS crit FROM nation LEFT JOIN part ON p_partkey % 25 = n_nationkey AND p_size > 48 GROUP BY 1)
    SELECT k, round(conflicts + trust + CASE WHEN crit THEN topics + coverage ELSE 0.0 END, 1) AS high_impact, round(weak_edges + unanswered + CASE WHEN crit THEN 0.0 ELSE topics + coverage END, 1) AS low_impact, round(conflicts + trust + topics + coverage + weak_edges + unanswered, 1) AS total FROM p JOIN c USING (k)""")
def _(d: Data) -> DataFrame:
    """Debt by impact: conflicts and trust always weigh, topics and coverage where a critical section lacks them."""
    lacking = d.table("part").where("p_size > 48").select((F.col("p_partkey") % 25).alias("k"), (text.criticality(F.concat_ws(" ", "p_type", "p_name", F.when(F.col("p_size") > 45, "policy").otherwise(""))) == "Critical").alias("crit"))
    crit = lacking.groupBy("k").agg(F.max("crit").alias("crit"))
    p = aggregates.debt(_debt_in(d)).join(crit, "k", "left")
    own, c = F.col("topics") + F.col("coverage"), F.coalesce("crit", F.lit(False))
    high, low = F.col("conflicts") + F.col("trust") + F.when(c, own).otherwise(0.0), F.col("weak_edges") + F.col("unanswered") + F.when(c, 0.0).otherwise(own)
    return p.select("k", F.round(high, 1).alias("high_impact"), F.round(low, 1).alias("low_impact"), F.round(high + low, 1).alias("total"))


@query("a36_fleet_cards", f"""WITH p AS ({_DEBT}), s AS (SELECT k, round(least(100.0, topics + weak_edges + conflicts + unanswered + trust + coverage), 1) AS debt, greatest(conflicts, weak_edges, trust) AS hot FROM p), m AS (SELECT c_nationkey AS k, count(*) AS asks, round(count(*) FILTER (decision = 'refuse') / count(*), 3) AS refusals, round(100.0 * count(*) FILTER (decision = 'answer') / count(*), 1) AS trust FROM messages JOIN customer ON c_custkey = conv_id WHERE role = 'assistant' GROUP BY 1)
    SELECT n_nationkey AS agent, n_name AS name, debt, CASE WHEN debt >= 28 OR (debt >= 18 AND hot >= 4) THEN 'High' WHEN debt >= 12 THEN 'Medium' ELSE 'Low' END AS risk, coalesce(asks, 0) AS asks, refusals AS refusal_rate, trust, coalesce(refusals, 0) <= 0.25 AS sla_ok FROM nation JOIN s ON s.k = n_nationkey LEFT JOIN m ON m.k = n_nationkey""")
def _(d: Data) -> DataFrame:
    """One card for every agent: debt, risk, asks, refusals, trust and whether its service level holds."""
    s = aggregates.debt(_debt_in(d)).select("k", F.col("score").alias("debt"), F.greatest("conflicts", "weak_edges", "trust").alias("hot"))
    of = lambda what: F.count_if(F.col("decision") == what) / F.count("*")
    m = d.messages.where("role = 'assistant'").join(d.table("customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_nationkey").alias("k")), "conv_id").groupBy("k").agg(F.count("*").alias("asks"), F.round(of("refuse"), 3).alias("refusal_rate"), F.round(100.0 * of("answer"), 1).alias("trust"))
    risk = F.when((F.col("debt") >= 28) | ((F.col("debt") >= 18) & (F.col("hot") >= 4)), "High").when(F.col("debt") >= 12, "Medium").otherwise("Low")
    n = d.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).join(s, "k").join(m, "k", "left")
    return n.select(F.col("k").alias("agent"), "name", "debt", risk.alias("risk"), F.coalesce("asks", F.lit(0)).alias("asks"), "refusal_rate", "trust", (F.coalesce("refusal_rate", F.lit(0.0)) <= 0.25).alias("sla_ok"))


@query("a08_intelligence", """WITH e AS MATERIALIZED (SELECT id, src, dst, edge_class, weight FROM kg_active), c AS MATERIALIZED (SELECT count(*) FILTER (edge_class = 'asserted_fact') AS facts, count(*) FILTER (edge_class = 'asserted_fact' AND weight < 0.5) AS weak FROM e), v AS (SELECT count(DISTINCT edge_id) AS n FROM kg_evidence SEMI JOIN e ON e.id = edge_id WHERE status = 'active'),
    m AS (SELECT 100.0 * count(*) FILTER (decision = 'answer') / count(*) AS pct FROM (SELECT decision FROM messages WHERE role = 'assistant' ORDER BY id DESC LIMIT 120)), g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e WHERE dst <> src) GROUP BY 1), t AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
    f AS (SELECT 1 AS place, 'weak facts' AS what, weak AS n FROM c WHERE weak > 0 UNION ALL SELECT 2, 'facts without evidence', facts - (SELECT n FROM v) FROM c WHERE facts > (SELECT n FROM v) UNION ALL SELECT 3, 'ungrounded answers', CAST(round(100 - pct) AS BIGINT) FROM m WHERE pct < 70)
    SELECT 'finding ' || place AS part, what AS value, n FROM f UNION ALL SELECT 'evidence_pct', CAST(round(100.0 * (SELECT n FROM v) / greatest(1, facts), 1) AS VARCHAR), facts FROM c UNION ALL SELECT 'grounded_pct', CAST(round(pct, 1) AS VARCHAR), 120 FROM m
    UNION ALL SELECT * FROM (SELECT 'most connected', id, n FROM g ORDER BY n DESC, id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'top agent', CAST(k AS VARCHAR), n FROM t ORDER BY n DESC, k DESC LIMIT 1)""")
def _(d: Data) -> DataFrame:
    """The studio's overview: findings, evidence, grounding, the most connected node and the busiest agent, of equals the later one."""
    e = d.active_edges.where("edge_class = 'asserted_fact'")
    c = e.agg(F.count("*").alias("facts"), F.count_if(F.col("weight") < 0.5).alias("weak"))
    v = d.active_edges.select("id").join(d.evidence.where("status = 'active'").select(F.col("edge_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("with"))
    last = d.messages.where("role = 'assistant'").orderBy(F.desc("id")).limit(120)
    m = last.agg((100.0 * F.count_if(F.col("decision") == "answer") / F.count("*")).alias("pct"))
    row = lambda part, value, n: F.struct(F.lit(part).alias("part"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    bare = F.col("facts") - F.col("with")
    parts = F.array(F.when(F.col("weak") > 0, row("finding 1", F.lit("weak facts"), F.col("weak"))), F.when(bare > 0, row("finding 2", F.lit("facts without evidence"), bare)), F.when(F.col("pct") < 70, row("finding 3", F.lit("ungrounded answers"), F.round(100 - F.col("pct")))), row("evidence_pct", F.round(100.0 * F.col("with") / F.greatest(F.lit(1), F.col("facts")), 1), F.col("facts")), row("grounded_pct", F.round("pct", 1), F.lit(120)))
    out = c.crossJoin(v).crossJoin(m).select(F.explode(F.array_compact(parts)).alias("p")).select("p.*")  # one row each
    top = joins.degrees(d.active_edges).orderBy(F.desc("degree"), "node").limit(1).select(F.lit("most connected"), "node", "degree")
    agent = d.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("c_nationkey")).limit(1).select(F.lit("top agent"), F.col("c_nationkey").cast("string"), "n")
    return out.union(top).union(agent)


@query("g23_versions", """WITH e AS MATERIALIZED (SELECT id, weight, status FROM kg_edges), v AS (SELECT 'v' || k AS version, id, weight * (1 + k / 10.0) AS weight, status FROM e, (SELECT unnest([0, 1, 2]) AS k) WHERE (length(id) + k) % 3 <> 0), b AS (SELECT version, count(*) AS edges, round(avg(weight), 4) AS mean_weight, count(*) FILTER (status = 'active') AS active FROM v GROUP BY 1)
    SELECT version, edges, mean_weight, active, version = (SELECT version FROM b ORDER BY mean_weight DESC, version LIMIT 1) AS promoted FROM b""")
def _(d: Data) -> DataFrame:
    """Captured versions with their size and weight; the strongest is promoted."""
    kept = d.edges.select("id", "weight", "status", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k")).where((F.char_length("id") + F.col("k")) % 3 != 0)
    b = kept.groupBy(F.concat(F.lit("v"), F.col("k").cast("string")).alias("version")).agg(F.count("*").alias("edges"), F.round(F.avg(F.col("weight") * (1 + F.col("k") / 10.0)), 4).alias("mean_weight"), F.count_if(F.col("status") == "active").alias("active"))
    best = Window.orderBy(F.desc("mean_weight"), "version")  # one row per version
    return b.withColumn("promoted", F.row_number().over(best) == 1)


def climb(run, threshold: float = 95.0, most: int = 8, stall: int = 3) -> list[tuple[int, float, str]]:
    """(generation, score, why it stopped or ''): ``run(generation)`` scores and mends until the threshold, ``most`` generations, or ``stall`` of them without a better score."""
    most, stall, out, best, since = min(40, max(1, most)), min(20, max(1, stall)), [], -1.0, 0
    for g in range(most):
        score = run(g)
        best, since = (score, 0) if score > best else (best, since + 1)
        why = "reached" if score >= threshold else "stalled" if since >= stall else "spent" if g == most - 1 else ""
        out.append((g, score, why))
        if why:
            break
    return out


@query("k08_climb", """WITH RECURSIVE c AS (SELECT item_id, string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3] AS must FROM benchmark), h AS MATERIALIZED (SELECT item_id, min(doc_id) AS doc FROM c JOIN documents ON contains(' ' || text || ' ', ' ' || must || ' ') GROUP BY 1), n AS (SELECT count(*) AS n FROM c), g(generation, score, best, since) AS (
        SELECT 0, round(100.0 * (SELECT count(*) FROM h WHERE doc % 8 = 0) / n, 1)::DOUBLE, round(100.0 * (SELECT count(*) FROM h WHERE doc % 8 = 0) / n, 1)::DOUBLE, 0 FROM n
        UNION ALL SELECT generation + 1, s, greatest(best, s), CASE WHEN s > best THEN 0 ELSE since + 1 END FROM (SELECT g.*, round(100.0 * (SELECT count(*) FROM h WHERE doc % 8 <= g.generation + 1) / n, 1)::DOUBLE AS s FROM g, n) WHERE score < 95 AND since < 3 AND generation < 7)
    SELECT CAST(generation AS INTEGER) AS generation, score, CASE WHEN score >= 95 THEN 'reached' WHEN since >= 3 THEN 'stalled' WHEN generation = 7 THEN 'spent' ELSE '' END AS why FROM g""")
def _(d: Data) -> DataFrame:
    """Evaluate, mend and evaluate again: each generation lets in one more eighth of the documents that hold two words of a case side by side."""
    w = F.split("text", " ")
    side_by_side = lambda a, b: F.concat_ws(" ", a, b)
    cases = d.table("benchmark").select("item_id", side_by_side(F.get(w, 1), F.get(w, 2)).alias("must"))
    n = cases.count()
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), side_by_side)
    held = d.documents.select("doc_id", F.explode(F.array_distinct(pairs)).alias("must"))
    found = cut(held.join(cases, "must").groupBy("item_id").agg(F.min("doc_id").alias("doc")))
    steps = climb(lambda g: round(100.0 * found.where(F.col("doc") % 8 <= g).count() / max(1, n), 1))
    return d.spark.createDataFrame(steps, "generation int, score double, why string")
