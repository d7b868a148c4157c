"""Joins, aggregations, ordered computations, top-k and set operations over the knowledge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import aggregates, cells, dedupe, graph, joins, ordered, topk
from factloom.plans.datasets import Data
from factloom.plans.registry import query


# --- joins ---------------------------------------------------------------------------------------


@query("j01_supplier_nation", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(d: Data) -> DataFrame:
    """Inner equi-join of a dimension with its workspace."""
    return d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


_ALIASES = "SELECT 'part:' || p_partkey AS node_id, lower(p_name || ' ' || p_brand) AS normalized_alias FROM part"


def _aliases(d: Data) -> DataFrame:
    return d.table("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("normalized_alias"))


def _terms(d: Data) -> DataFrame:
    """Every part's name with its brand and every supplier's name."""
    return d.table("part").select(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("term")).union(d.table("supplier").select(F.lower("s_name").alias("term"))).distinct()


_TERMS = "SELECT lower(p_name || ' ' || p_brand) AS term FROM part UNION SELECT lower(s_name) FROM supplier"


@query("j02_name_or_alias", f"""WITH al AS ({_ALIASES}), t AS ({_TERMS})
    SELECT term, id FROM t JOIN kg_nodes ON normalized_name = term UNION SELECT term, node_id FROM t JOIN al ON normalized_alias = term""")
def _(d: Data) -> DataFrame:
    """Names or aliases that equal a term (also D01: a distinct union)."""
    return joins.resolve_exact(_terms(d), d.nodes, _aliases(d))


@query("j03_fuzzy_link", f"""WITH al AS ({_ALIASES}), t AS (SELECT lower(substr(s_name, 1, 12)) AS term FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT lower(p_name) || 's' FROM part WHERE p_partkey % 20 = 0 UNION SELECT lower(p_brand) || ' x' FROM part WHERE p_partkey % 20 = 0),
    n AS (SELECT id, normalized_name AS n FROM kg_nodes UNION SELECT node_id, normalized_alias FROM al),
    c AS (SELECT term, id, CASE WHEN term = n THEN 0 WHEN starts_with(n, term) OR starts_with(term, n) THEN 1
        WHEN (length(term) >= 5 AND contains(n, term)) OR (length(n) >= 5 AND contains(term, n)) THEN 2 END AS cls, abs(length(term) - length(n)) AS gap
        FROM t JOIN n ON length(term) >= 4 AND length(n) >= 4),
    b AS (SELECT term, id, min((cls, gap)) AS best FROM c WHERE cls IS NOT NULL GROUP BY ALL)
    SELECT term, id, CAST(row_number() OVER w AS INTEGER) AS rank FROM b WINDOW w AS (PARTITION BY term ORDER BY best, id) QUALIFY row_number() OVER w <= 5""")
def _(d: Data) -> DataFrame:
    """Fuzzy entity link of every 20th name, by names and aliases: exact, prefix, containment; closest in length first."""
    part = d.table("part").where("p_partkey % 20 = 0")
    t = d.table("supplier").where("s_suppkey % 20 = 0").select(F.lower(F.substring("s_name", 1, 12)).alias("term")).union(part.select(F.concat(F.lower("p_name"), F.lit("s")))).union(part.select(F.concat(F.lower("p_brand"), F.lit(" x")))).distinct()
    return joins.fuzzy_link(t, d.nodes.select("id", "normalized_name").unionByName(_aliases(d).select(F.col("node_id").alias("id"), F.col("normalized_alias").alias("normalized_name"))), 5)


@query("j04_evidenced_count", "SELECT rel_type, count(DISTINCT v.edge_id) AS n FROM kg_evidence v JOIN kg_active e ON e.id = v.edge_id GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Active edges with evidence, counted once each."""
    return d.active_edges.join(d.evidence.select(F.col("edge_id").alias("id")), "id", "left_semi").groupBy("rel_type").agg(F.count("*").alias("n"))


@query("j05_degree", "SELECT n.id, count(e.id) AS degree FROM kg_nodes n JOIN kg_active e ON e.src = n.id OR e.dst = n.id GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Degree over an OR-join, as one pass over the ends."""
    return d.nodes.select("id").join(joins.degrees(d.active_edges).withColumnRenamed("node", "id"), "id").select("id", "degree")


@query("j06_customer_label", "SELECT n.id, coalesce(c.c_mktsegment, '') AS label FROM kg_nodes n LEFT JOIN customer c ON n.id = 'customer:' || c.c_custkey")
def _(d: Data) -> DataFrame:
    """Left join for a label with an empty default."""
    c = d.table("customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), "c_mktsegment")
    return d.nodes.select("id").join(c, "id", "left").select("id", F.coalesce("c_mktsegment", F.lit("")).alias("label"))


@query("j07_endpoint_names", "SELECT e.id, s.name AS src_name, t.name AS dst_name FROM kg_active e JOIN kg_nodes s ON s.id = e.src JOIN kg_nodes t ON t.id = e.dst")
def _(d: Data) -> DataFrame:
    return joins.with_endpoint_names(d.active_edges, d.nodes).select("id", "src_name", "dst_name")


@query("j08_evidence_titles", """SELECT v.edge_id, string_agg(DISTINCT coalesce(o.o_orderpriority, CAST(v.chunk_id AS VARCHAR)), ',' ORDER BY coalesce(o.o_orderpriority, CAST(v.chunk_id AS VARCHAR))) AS titles
    FROM kg_evidence v LEFT JOIN orders o ON o.o_orderkey = v.chunk_id GROUP BY 1""")
def _(d: Data) -> DataFrame:
    """Evidence with its chunk's document, titles gathered."""
    o = d.table("orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderpriority")
    title = F.coalesce("o_orderpriority", F.col("chunk_id").cast("string"))
    return d.evidence.join(o, "chunk_id", "left").groupBy("edge_id").agg(F.array_join(F.array_sort(F.collect_set(title)), ",").alias("titles"))


@query("j09_refused", "SELECT a.id, a.decision, q.content AS question FROM messages a LEFT JOIN messages q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.decision = 'refuse'")
def _(d: Data) -> DataFrame:
    """Refused answers with the message before."""
    q = d.messages.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("question"))
    return d.messages.where("decision = 'refuse'").join(q, ["conv_id", "turn"], "left").select("id", "decision", "question")


@query("j10_alias_fit", f"WITH al AS ({_ALIASES}) SELECT node_id, normalized_alias, starts_with(normalized_alias, normalized_name) AS fits FROM al JOIN kg_nodes ON id = node_id")
def _(d: Data) -> DataFrame:
    return _aliases(d).join(d.nodes.withColumnRenamed("id", "node_id"), "node_id").select("node_id", "normalized_alias", F.col("normalized_alias").startswith(F.col("normalized_name")).alias("fits"))


@query("j11_asserted_sources", "SELECT e.id, v.id AS evidence_id, v.chunk_id FROM kg_edges e JOIN kg_evidence v ON v.edge_id = e.id WHERE e.edge_class = 'asserted_fact' AND e.weight < 0.55")
def _(d: Data) -> DataFrame:
    e = d.edges.where("edge_class = 'asserted_fact' AND weight < 0.55").select("id")
    return e.join(d.evidence.select(F.col("edge_id").alias("id"), F.col("id").alias("evidence_id"), "chunk_id"), "id")


@query("j12_with_evidence", "SELECT id FROM kg_active WHERE edge_class = 'asserted_fact' AND EXISTS (SELECT 1 FROM kg_evidence v WHERE v.edge_id = kg_active.id AND v.status = 'active')")
def _(d: Data) -> DataFrame:
    """Edge evidence filter, as a semi-join."""
    return joins.evidenced_edges(d.edges, d.evidence).select("id")


@query("j13_best_quote", "SELECT edge_id, quote, confidence FROM kg_evidence WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY confidence DESC, id) = 1")
def _(d: Data) -> DataFrame:
    """Top-1 evidence per edge (also W04): an aggregation, no sort."""
    best = d.evidence.where("status = 'active'").groupBy("edge_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "id", "quote", "confidence")).alias("b"))
    return best.select("edge_id", "b.quote", "b.confidence")


@query("j14_missing_links", "SELECT id FROM kg_nodes WHERE type = 'Person' AND NOT EXISTS (SELECT 1 FROM kg_active e WHERE e.src = kg_nodes.id AND e.edge_class = 'asserted_fact')")
def _(d: Data) -> DataFrame:
    """Persons that no active, asserted edge leaves."""
    linked = d.active_edges.where("edge_class = 'asserted_fact'").select(F.col("src").alias("id"))
    return d.nodes.where("type = 'Person'").select("id").join(linked, "id", "left_anti")


@query("j15_chunk_titles", "SELECT v.id, coalesce(o.o_orderstatus, 'document') AS title FROM kg_evidence v LEFT JOIN orders o ON o.o_orderkey = v.chunk_id AND o.o_orderstatus <> 'P'")
def _(d: Data) -> DataFrame:
    o = d.table("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"), "o_orderstatus")
    return d.evidence.join(o, "chunk_id", "left").select("id", F.coalesce("o_orderstatus", F.lit("document")).alias("title"))


@query("j16_locked_edges", "SELECT id FROM kg_edges WHERE upper(rel_type) IN (SELECT 'PART_OF') UNION SELECT e.id FROM kg_edges e JOIN events v ON e.id = 'cn:' || v.user_id WHERE v.event_type = 'signup' AND v.value > 60")
def _(d: Data) -> DataFrame:
    """Edges that policies lock, by relation or by id."""
    by_id = d.events.where("event_type = 'signup' AND value > 60").select(F.concat(F.lit("cn:"), F.col("user_id").cast("string")).alias("id"))
    by_rel = d.spark.createDataFrame([("PART_OF",)], "r string")
    return d.edges.join(F.broadcast(by_rel), F.upper("rel_type") == F.col("r"), "left_semi").select("id").union(d.edges.join(by_id, "id", "left_semi").select("id")).distinct()


@query("j18_path_success", """WITH p AS (SELECT path_key || '|p' || (CAST(substr(path_key, 2) AS INTEGER) + 1) AS key, won FROM outcomes), e AS (SELECT DISTINCT path_key AS edge FROM outcomes)
    SELECT edge, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, round(100.0 * count(*) FILTER (WHERE won) / count(*), 0) AS success FROM e JOIN p ON list_contains(string_split(key, '|'), edge) GROUP BY 1""")
def _(d: Data) -> DataFrame:
    """Wins and losses of the paths that hold an edge (also A32): the path's edges are exploded, so the join is an equi-join."""
    p = d.outcomes.select(F.concat("path_key", F.lit("|p"), (F.substring("path_key", 2, 9).cast("int") + 1).cast("string")).alias("key"), "won")
    held = p.select(F.explode(F.split("key", r"\|")).alias("edge"), "won").join(d.outcomes.select(F.col("path_key").alias("edge")).distinct(), "edge", "left_semi")
    return aggregates.path_success(held, "edge")


@query("j21_case_outcomes", """WITH r AS (SELECT user_id, event_type, CAST(day(ts) AS INTEGER) AS g, max(value) > 25 AS ok FROM events WHERE day(ts) <= 2 GROUP BY ALL),
    a AS (SELECT * FROM r WHERE g = 1), b AS (SELECT * FROM r WHERE g = 2)
    SELECT coalesce(a.user_id, b.user_id) AS case_id, coalesce(a.event_type, b.event_type) AS kind, coalesce(CAST(a.ok AS VARCHAR), 'unknown') AS first, coalesce(CAST(b.ok AS VARCHAR), 'unknown') AS last FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def _(d: Data) -> DataFrame:
    """Cases of two generations side by side, missing ones unknown."""
    r = d.events.where("day(ts) <= 2").groupBy("user_id", "event_type", F.dayofmonth("ts").alias("g")).agg((F.max("value") > 25).alias("ok"))
    of = lambda g, name: r.where(F.col("g") == g).select(F.col("user_id").alias("case_id"), F.col("event_type").alias("kind"), F.col("ok").cast("string").alias(name))
    both = of(1, "first").join(of(2, "last"), ["case_id", "kind"], "full")
    return both.select("case_id", "kind", F.coalesce("first", F.lit("unknown")).alias("first"), F.coalesce("last", F.lit("unknown")).alias("last"))


_OLD = "SELECT id, weight FROM kg_active WHERE rel_type = 'PROVIDES' AND length(id) % 3 <> 0"
_NEW = "SELECT id, CASE length(id) % 4 WHEN 0 THEN weight + 0.1 WHEN 1 THEN weight - 0.1 ELSE weight END AS weight FROM kg_active WHERE rel_type = 'PROVIDES' AND length(id) % 5 <> 0"


@query("j22_version_diff", f"""WITH o AS ({_OLD}), n AS ({_NEW})
    SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN n.weight - o.weight >= 0.02 THEN 'strengthened' WHEN o.weight - n.weight >= 0.02 THEN 'weakened' ELSE 'same' END AS change, count(*) AS n
    FROM o FULL JOIN n ON o.id = n.id GROUP BY 1""")
def _(d: Data) -> DataFrame:
    """Changes between two versions of the graph."""
    e, n = d.active_edges.where("rel_type = 'PROVIDES'"), F.char_length("id")
    old = e.where(n % 3 != 0).select("id", F.col("weight").alias("old"))
    new = e.where(n % 5 != 0).select("id", (F.col("weight") + F.when(n % 4 == 0, 0.1).when(n % 4 == 1, -0.1).otherwise(0.0)).alias("new"))
    return aggregates.version_changes(old, new).groupBy("change").agg(F.count("*").alias("n"))


# --- aggregations --------------------------------------------------------------------------------


@query("a01_counts", """SELECT 'nodes' AS what, count(*) AS n FROM kg_nodes UNION ALL SELECT 'edges', count(*) FROM kg_edges UNION ALL SELECT 'evidence', count(*) FROM kg_evidence
    UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'asks', count(*) FROM messages WHERE role = 'user'""")
def _(d: Data) -> DataFrame:
    count = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count("nodes", d.nodes).union(count("edges", d.edges)).union(count("evidence", d.evidence)).union(count("documents", d.documents)).union(count("asks", d.messages.where("role = 'user'")))


@query("a02_census", "SELECT 'node' AS what, type AS kind, count(*) AS n FROM kg_nodes GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM kg_active GROUP BY 2")
def _(d: Data) -> DataFrame:
    nodes = d.nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("kind")).agg(F.count("*").alias("n"))
    return nodes.union(d.active_edges.groupBy(F.lit("edge").alias("what"), F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")))


@query("a03_claims", "SELECT lang, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS supported, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unsupported, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Conditional sums."""
    j = d.documents.select("doc_id", "lang").join(d.table("labels"), "doc_id")
    return j.groupBy("lang").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("supported"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("unsupported"), F.count("*").alias("total"))


@query("a04_evidence_coverage", """SELECT round(100.0 * greatest((SELECT count(*) FROM kg_active a WHERE EXISTS (SELECT 1 FROM kg_evidence v WHERE v.edge_id = a.id)), (SELECT count(*) FROM kg_active WHERE edge_class = 'documentary')) / (SELECT count(*) FROM kg_active), 2) AS coverage""")
def _(d: Data) -> DataFrame:
    has = d.evidence.select(F.col("edge_id").alias("id"), F.lit(1).alias("has")).distinct()
    e = d.active_edges.join(has, "id", "left").agg(F.count("has").alias("e"), F.sum(F.when(F.col("edge_class") == "documentary", 1).otherwise(0)).alias("doc"), F.count("*").alias("n"))
    return e.select(F.round(100.0 * F.greatest("e", "doc") / F.col("n"), 2).alias("coverage"))


@query("a05_grounded", """WITH last AS (SELECT * FROM messages WHERE role = 'assistant' ORDER BY conv_id DESC, turn DESC LIMIT 120)
    SELECT count(*) AS answers, round(100.0 * avg(CASE WHEN trust IS NOT NULL THEN 1.0 ELSE 0.0 END), 1) AS grounded FROM last WHERE decision = 'answer'""")
def _(d: Data) -> DataFrame:
    """Share of grounded answers among the last 120 replies."""
    last = d.messages.where("role = 'assistant'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(120)
    return last.where("decision = 'answer'").agg(F.count("*").alias("answers"), F.round(100.0 * F.avg(F.when(F.col("trust").isNotNull(), 1.0).otherwise(0.0)), 1).alias("grounded"))


@query("a07_health_average", "SELECT lang, round(avg(quality), 4) AS health FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id", "lang").join(d.table("labels"), "doc_id").groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("health"))


@query("a09_feedback", """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS up, count(*) FILTER (WHERE event_type = 'error') AS down,
    round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 3) AS accept_rate FROM events GROUP BY 1""")
def _(d: Data) -> DataFrame:
    """Up and down votes; no rate without votes."""
    up, down = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return d.events.groupBy("user_id").agg(up.alias("up"), down.alias("down"), F.round(up / F.nullif(up + down, F.lit(0)), 3).alias("accept_rate"))


@query("a10_frequent_questions", """WITH q AS (SELECT lower(substr(content, 1, 120)) AS question FROM (SELECT * FROM messages WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 400))
    SELECT question, count(*) AS n FROM q WHERE length(question) > 8 GROUP BY 1 ORDER BY n DESC, question LIMIT 8""")
def _(d: Data) -> DataFrame:
    q = d.messages.where("role = 'user'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(400).select(F.lower(F.substring("content", 1, 120)).alias("question"))
    return q.where(F.char_length("question") > 8).groupBy("question").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(8)


@query("a11_slos", """WITH last AS (SELECT * FROM messages WHERE role = 'assistant' ORDER BY conv_id DESC, turn DESC LIMIT 200)
    SELECT count(*) AS asks, round(avg(CASE WHEN decision = 'refuse' THEN 1.0 ELSE 0.0 END), 4) AS refusal_rate, round(avg(CASE WHEN decision = 'answer' THEN 1.0 ELSE 0.0 END), 4) AS answer_rate, round(avg(coalesce(trust, 0)), 3) AS avg_trust FROM last""")
def _(d: Data) -> DataFrame:
    return aggregates.slos(d.messages.where("role = 'assistant'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(200))


@query("a12_action_stats", "SELECT user_id % 6 AS driver, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return d.events.groupBy((F.col("user_id") % 6).alias("driver"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


_COVER = """SELECT source AS section, count(*) AS pages, count(quality) AS linked_pages, round(100.0 * count(quality) / count(*), 1) AS coverage_pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""


def _cover(d: Data) -> DataFrame:
    return aggregates.coverage(d.documents.select("doc_id", F.col("source").alias("section")).join(d.table("labels").select("doc_id", F.lit(1).alias("linked")), "doc_id", "left"))


@query("a13_coverage", _COVER)
def _(d: Data) -> DataFrame:
    """Coverage of each section."""
    return _cover(d)


@query("a13_coverage_overall", f"WITH c AS ({_COVER}) SELECT round(sum(coverage_pct * pages) / sum(pages), 1) AS overall_pct, count(*) FILTER (WHERE coverage_pct < 60) AS gap_sections FROM c")
def _(d: Data) -> DataFrame:
    c = _cover(d)
    return c.agg(F.round(F.sum(F.col("coverage_pct") * F.col("pages")) / F.sum("pages"), 1).alias("overall_pct"), F.count_if(F.col("coverage_pct") < 60).alias("gap_sections"))


@query("a15_health_score", """WITH h AS (SELECT n_nationkey AS k, count(c_custkey) AS customers, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS evidence, least(1.0, count(c_custkey) / 70.0) AS connectivity FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT k, round(100 * (0.22 * CASE WHEN customers > 0 THEN 1.0 ELSE 0.0 END + 0.18 * 1.0 + 0.22 * evidence + 0.18 * connectivity + 0.10 * 0.5 + 0.10 * 1.0), 1) AS health FROM h""")
def _(d: Data) -> DataFrame:
    h = d.table("nation").join(d.table("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("k")).agg(F.count("c_custkey").alias("customers"), F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("evidence"))
    return h.select("k", aggregates.health_score(F.when(F.col("customers") > 0, 1.0).otherwise(0.0), F.lit(1.0), F.col("evidence"), F.least(F.lit(1.0), F.col("customers") / 70.0), F.lit(0.5), F.lit(1.0)).alias("health"))


#: SQL: what each nation's debt follows from: the edges of its customers and suppliers, their evidence, and its customers' conversations.
_DEBT_IN = """SELECT n_nationkey AS k, round(100.0::DOUBLE * coalesce(covered, 0) / greatest(coalesce(asserted, 0), 1), 1) AS cover, round(coalesce(cents / nullif(evidences, 0)::DOUBLE / 100.0::DOUBLE, 0.0), 3) AS trust, coalesce(conflicts, 0) AS conflicts, coalesce(weak, 0) AS weak, coalesce(asserted, 0) AS asserted, coalesce(unanswered, 0) AS unanswered, coalesce(gaps, 0) AS gaps FROM nation
    LEFT JOIN (SELECT k, CAST(sum(asserted) AS BIGINT) AS asserted, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(weak) AS BIGINT) AS weak, CAST(sum(conflicts) AS BIGINT) AS conflicts, sum(cents) AS cents, sum(evidences) AS evidences, count(*) FILTER (100.0 * covered < 60.0 * asserted) AS gaps FROM (
        SELECT o.k, o.id, count(*) FILTER (live) AS asserted, count(*) FILTER (live AND evidences > 0) AS covered, count(*) FILTER (live AND weight < 0.55) AS weak, count(*) FILTER (status = 'superseded' AND weight >= 1.1 AND evidences > 0) AS conflicts, coalesce(sum(cents), 0) AS cents, coalesce(sum(evidences), 0) AS evidences
        FROM (SELECT *, status = 'active' AND edge_class = 'asserted_fact' AS live FROM kg_edges) e JOIN (SELECT 'customer:' || c_custkey AS id, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier) o ON o.id = e.src
        LEFT JOIN (SELECT edge_id, count(*) AS evidences, sum(CAST(round(confidence * 100) AS BIGINT)) AS cents FROM kg_evidence WHERE status = 'active' GROUP BY 1) v ON v.edge_id = e.id GROUP BY 1, 2) GROUP BY 1) g ON g.k = n_nationkey
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS unanswered FROM messages JOIN customer ON c_custkey = conv_id WHERE decision IN ('refuse', 'clarify') GROUP BY 1) m ON m.k = n_nationkey"""


def _debt_in(d: Data) -> DataFrame:
    """k, cover, trust, conflicts, weak, asserted, unanswered, gaps of every nation.

    Each of its customers and suppliers is a section: asserted edges, those with active evidence (cover, in percent) and weak ones, and
    superseded edges of weight that evidence still asserts (conflicts); sections with less than 60 percent are gaps.
    Trust is the evidence's mean confidence; refused and clarified questions of its customers' conversations are unanswered.
    """
    owner = d.table("customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("src"), F.col("c_nationkey").alias("k"))
    owner = owner.unionByName(d.table("supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"), F.col("s_nationkey").alias("k")))
    v = d.evidence.where("status = 'active'").groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("evidences"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("cents"))
    e = d.edges.join(v, "id", "left").withColumn("live", (F.col("status") == "active") & (F.col("edge_class") == "asserted_fact"))
    held = F.coalesce(F.col("evidences") > 0, F.lit(False))
    torn = (F.col("status") == "superseded") & (F.col("weight") >= 1.1) & held
    sections = e.groupBy("src").agg(F.count_if("live").alias("asserted"), F.count_if(F.col("live") & held).alias("covered"), F.count_if(F.col("live") & (F.col("weight") < 0.55)).alias("weak"), F.count_if(torn).alias("conflicts"), F.sum("cents").alias("cents"), F.sum("evidences").alias("evidences"))
    sums = ("asserted", "covered", "weak", "conflicts", "cents", "evidences")
    g = sections.join(owner, "src").groupBy("k").agg(*(F.sum(c).alias(c) for c in sums), F.count_if(100.0 * F.col("covered") < 60.0 * F.col("asserted")).alias("gaps"))
    asks = d.messages.where("decision IN ('refuse', 'clarify')").join(d.table("customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_nationkey").alias("k")), "conv_id")
    m = asks.groupBy("k").agg(F.count("*").alias("unanswered"))
    n = d.table("nation").select(F.col("n_nationkey").alias("k")).join(g, "k", "left").join(m, "k", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    cover = F.round(100.0 * F.coalesce("covered", F.lit(0)) / F.greatest(F.coalesce("asserted", F.lit(0)), F.lit(1)), 1)
    trust = F.round(F.coalesce(F.col("cents") / F.col("evidences") / 100.0, F.lit(0.0)), 3)
    return n.select("k", cover.alias("cover"), trust.alias("trust"), *map(zero, ("conflicts", "weak", "asserted", "unanswered", "gaps")))


_DEBT = f"""SELECT k, CAST(round(0.08 * least(20.0, gaps * 4.0), 1) AS DOUBLE) AS topics, CAST(round(0.16 * least(40.0, 100.0 * weak / greatest(asserted, 1)), 1) AS DOUBLE) AS weak_edges, CAST(round(0.18 * least(30.0, conflicts * 4.0), 1) AS DOUBLE) AS conflicts,
    CAST(round(0.12 * least(25.0, unanswered * 2.5), 1) AS DOUBLE) AS unanswered, CAST(round(0.18 * (100 - 100 * trust), 1) AS DOUBLE) AS trust, CAST(round(0.28 * greatest(0, 100.0 - cover), 1) AS DOUBLE) AS coverage FROM ({_DEBT_IN})"""


@query("a16_debt", f"""WITH p AS ({_DEBT}) SELECT *, round(least(100.0, topics + weak_edges + conflicts + unanswered + trust + coverage), 1) AS score,
    CASE WHEN round(topics + weak_edges + conflicts + unanswered + trust + coverage, 1) < 12 THEN 'healthy' WHEN round(topics + weak_edges + conflicts + unanswered + trust + coverage, 1) < 28 THEN 'watch' ELSE 'elevated' END AS status FROM p""")
def _(d: Data) -> DataFrame:
    """Knowledge debt: six capped drivers."""
    return aggregates.debt(_debt_in(d))


@query("a17_risk", f"""WITH p AS ({_DEBT}), s AS (SELECT k, round(topics + weak_edges + conflicts + unanswered + trust + coverage, 1) AS score, greatest(conflicts, weak_edges, trust) AS hot FROM p)
    SELECT k, CASE WHEN score >= 28 OR (score >= 18 AND hot >= 4) THEN 'High' WHEN score >= 12 THEN 'Medium' ELSE 'Low' END AS risk FROM s""")
def _(d: Data) -> DataFrame:
    s = aggregates.debt(_debt_in(d))
    hot = F.greatest("conflicts", "weak_edges", "trust")
    return s.select("k", F.when((F.col("score") >= 28) | ((F.col("score") >= 18) & (hot >= 4)), "High").when(F.col("score") >= 12, "Medium").otherwise("Low").alias("risk"))


@query("a19_improvement", f"""WITH p AS ({_DEBT}), l AS (SELECT k, round(topics + weak_edges + conflicts + unanswered + trust + coverage, 1) AS score, unnest([{{'d': 'topics', 'v': topics}}, {{'d': 'weak_edges', 'v': weak_edges}}, {{'d': 'conflicts', 'v': conflicts}}, {{'d': 'unanswered', 'v': unanswered}}, {{'d': 'trust', 'v': trust}}, {{'d': 'coverage', 'v': coverage}}]) AS x FROM p),
    r AS (SELECT k, score, x.d AS driver, x.v AS v, row_number() OVER (PARTITION BY k ORDER BY x.v DESC, x.d) AS step FROM l)
    SELECT k, driver, CAST(step AS INTEGER) AS step, round(greatest(0.0, score - sum(v) OVER (PARTITION BY k ORDER BY step)), 1) AS remaining FROM r WHERE step <= 3""")
def _(d: Data) -> DataFrame:
    """Debt that is left after the three largest drivers, one after another."""
    return aggregates.improvement(aggregates.debt(_debt_in(d)))


@query("a20_fitness", f"SELECT k, greatest(0.0, least(100.0, round(0.45 * cover + 0.35 * 100 * coalesce(nullif(trust, 0), 0.5) + 0.20 * least(100, 40 + unanswered) - least(25.0, 2.5 * conflicts), 1))) AS fitness FROM ({_DEBT_IN})")
def _(d: Data) -> DataFrame:
    return _debt_in(d).select("k", aggregates.fitness(F.col("cover"), F.col("trust"), F.col("unanswered"), F.col("conflicts")).alias("fitness"))


@query("a21_evidence_quality", f"SELECT k, round(0.28 * cover + 0.24 * 100 * trust + 0.24 * greatest(0.0, 100 - least(90.0, unanswered * 30 / 4.0)) + 0.24 * greatest(0.0, 100 - least(80.0, conflicts * 8.0)), 1) AS score FROM ({_DEBT_IN})")
def _(d: Data) -> DataFrame:
    return _debt_in(d).select("k", aggregates.evidence_quality(F.col("cover"), 100 * F.col("trust"), F.col("unanswered") * 30, F.col("conflicts")).alias("score"))


@query("a22_sla", f"""SELECT k, cover >= 90 AND unanswered <= 10 AND conflicts <= 5 AS passing, CASE WHEN conflicts > 5 THEN 'scan_conflicts' WHEN unanswered > 10 THEN 'playbook' WHEN cover < 90 THEN 'connect' END AS cta FROM ({_DEBT_IN})""")
def _(d: Data) -> DataFrame:
    """Service level with the lead failure: contradictions, then debt, then coverage."""
    return aggregates.sla(_debt_in(d), F.col("cover"), F.col("unanswered"), F.col("conflicts")).select("k", "passing", "cta")


@query("a23_value_conflicts", """WITH f AS (SELECT 'brand:' || p_brand AS src, CAST(floor(p_retailprice / 50) * 50 AS BIGINT) AS amount FROM part)
    SELECT src, count(DISTINCT amount) AS n, string_agg(DISTINCT CAST(amount AS VARCHAR), ',' ORDER BY CAST(amount AS VARCHAR)) AS amounts FROM f GROUP BY 1 HAVING count(DISTINCT amount) >= 2""")
def _(d: Data) -> DataFrame:
    """Entities whose values disagree."""
    f = d.table("part").select(F.concat(F.lit("brand:"), "p_brand").alias("src"), (F.floor(F.col("p_retailprice") / 50) * 50).cast("long").alias("amount"))
    return aggregates.value_conflicts(f)


@query("a24_most_connected", """SELECT n.id, n.name, count(*) AS degree FROM kg_nodes n JOIN kg_active e ON e.src = n.id OR e.dst = n.id WHERE n.type <> 'Section' GROUP BY ALL ORDER BY degree DESC, n.id LIMIT 20""")
def _(d: Data) -> DataFrame:
    g = joins.degrees(d.active_edges).withColumnRenamed("node", "id")
    return d.nodes.where("type <> 'Section'").join(g, "id").select("id", "name", "degree").orderBy(F.desc("degree"), "id").limit(20)


@query("a25_hygiene", """WITH g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM kg_active UNION ALL SELECT dst FROM kg_active) GROUP BY 1)
    SELECT 'unused_nodes' AS what, count(*) AS n FROM kg_nodes WHERE id NOT IN (SELECT node FROM g)
    UNION ALL SELECT 'orphan_topics', count(*) FROM kg_nodes LEFT JOIN g ON node = id WHERE lower(type) IN ('topic', 'concept', 'section') AND coalesce(degree, 0) <= 1
    UNION ALL SELECT 'duplicate_entities', count(*) FROM (SELECT normalized_name FROM kg_nodes WHERE length(normalized_name) >= 3 GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'weak_edges', count(*) FROM kg_active WHERE edge_class = 'asserted_fact' AND weight < 0.55
    UNION ALL SELECT 'broken_links', count(*) FROM (SELECT src AS x FROM kg_active UNION ALL SELECT dst FROM kg_active) WHERE x NOT IN (SELECT id FROM kg_nodes)
    UNION ALL SELECT 'stale_paths', count(*) FROM (SELECT path_key FROM outcomes GROUP BY 1 HAVING count(*) FILTER (WHERE NOT won) >= 3 AND count(*) FILTER (WHERE NOT won) > count(*) FILTER (WHERE won))""")
def _(d: Data) -> DataFrame:
    return aggregates.hygiene(d.nodes, d.active_edges, d.outcomes)


@query("a26_cleanstack", """WITH r AS (SELECT doc_id, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id DESC) = 1 AS kept FROM documents)
    SELECT count(*) AS files, count(*) FILTER (WHERE kept) AS keepers, CAST(sum(tokens) FILTER (WHERE NOT kept) AS BIGINT) AS tokens_avoided, round(100.0 * count(*) FILTER (WHERE NOT kept) / count(*), 1) AS avoided_pct FROM r""")
def _(d: Data) -> DataFrame:
    """What exact deduplication kept and avoided."""
    docs = d.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("h"), F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)).alias("tokens"))
    kept = ordered.keep_one(docs, "h", F.desc("n_chars"), F.desc("doc_id")).withColumn("k", F.col("decision") == "keep")
    return kept.agg(F.count("*").alias("files"), F.count_if("k").alias("keepers"), F.sum(F.when(~F.col("k"), F.col("tokens"))).alias("tokens_avoided"), F.round(100.0 * F.count_if(~F.col("k")) / F.count("*"), 1).alias("avoided_pct"))


@query("a27_suite_fitness", """SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS passed, round(100.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 0) / count(*), 2) AS fitness,
    count(*) FILTER (WHERE toxic = 1) AS fail_toxic, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fail_quality FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def _(d: Data) -> DataFrame:
    j = d.documents.select("doc_id", "source").join(d.table("labels"), "doc_id")
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return j.groupBy("source").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.round(100.0 * F.count_if(ok) / F.count("*"), 2).alias("fitness"), F.count_if(F.col("toxic") == 1).alias("fail_toxic"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 0)).alias("fail_quality"))


@query("a29_code_nodes", "SELECT count(*) AS entities, count(*) FILTER (WHERE regexp_full_match(name, '[A-Za-z]+[0-9]+.*')) AS code_nodes FROM kg_nodes")
def _(d: Data) -> DataFrame:
    return d.nodes.agg(F.count("*").alias("entities"), F.count_if(F.col("name").rlike("^[A-Za-z]+[0-9]+.*$")).alias("code_nodes"))


@query("a33_ops_before_after", """WITH m AS (SELECT user_id % 10 AS ws, first(value ORDER BY ts, event_id) AS before, last(value ORDER BY ts, event_id) AS after, count(*) FILTER (WHERE event_type = 'signup') AS done, count(*) AS suggested FROM events GROUP BY 1)
    SELECT ws, before, after, round(after - before, 2) AS delta, round(done / suggested, 3) AS adoption FROM m""")
def _(d: Data) -> DataFrame:
    first, last = F.min(F.struct("ts", "event_id", "value")), F.max(F.struct("ts", "event_id", "value"))
    m = d.events.groupBy((F.col("user_id") % 10).alias("ws")).agg(first["value"].alias("before"), last["value"].alias("after"), F.round(F.count_if(F.col("event_type") == "signup") / F.count("*"), 3).alias("adoption"))
    return m.select("ws", "before", "after", F.round(F.col("after") - F.col("before"), 2).alias("delta"), "adoption")


@query("a36_fleet", "SELECT s_nationkey AS agent, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance, max(s_name) AS latest FROM supplier GROUP BY 1")
def _(d: Data) -> DataFrame:
    return d.table("supplier").groupBy(F.col("s_nationkey").alias("agent")).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"), F.max("s_name").alias("latest"))


# --- ordered computations ------------------------------------------------------------------------


@query("w01_keep_one", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(trim(text)) ORDER BY n_chars DESC, doc_id DESC) = 1 THEN 'keep' ELSE 'skip_exact' END AS decision FROM documents")
def _(d: Data) -> DataFrame:
    """Exact deduplication by hash."""
    return ordered.keep_one(d.documents.select("doc_id", "n_chars", F.sha2(F.trim("text"), 256).alias("h")), "h", F.desc("n_chars"), F.desc("doc_id")).select("doc_id", "decision")


@query("w02_first_message", "SELECT conv_id, first(content ORDER BY turn) AS content FROM messages GROUP BY 1")
def _(d: Data) -> DataFrame:
    """The first chunk of each document, as an aggregation."""
    return d.messages.groupBy("conv_id").agg(F.min_by("content", "turn").alias("content"))


@query("w03_budget_sample", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS early, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS long FROM documents)
    SELECT doc_id FROM r WHERE early <= 2 OR (long - 1) % ((SELECT count(*) FROM documents) // 40) = 0""")
def _(d: Data) -> DataFrame:
    """Two early documents per source, and every n-th by length, from range-partitioned ranks."""
    return dedupe.budget_sample(d.documents.select("doc_id", "source", "n_chars"), 40)


@query("w03_weave_sample", """WITH r AS (SELECT coalesce(source, '') AS ws, coalesce(lang, '') AS doc, doc_id AS id, coalesce(n_chars, 0) AS size, row_number() OVER (PARTITION BY coalesce(source, ''), coalesce(lang, '') ORDER BY doc_id) AS early, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS rank, count(*) OVER (PARTITION BY coalesce(source, '')) AS n FROM documents), d AS (SELECT ws, doc, min(rank) AS first FROM r GROUP BY ALL),
    t AS (SELECT r.ws, id, CASE WHEN early <= 2 THEN 0 WHEN (rank - 1) % greatest(1, n // 21) = 0 THEN 1 ELSE 2 END AS part, CASE WHEN early <= 2 THEN first ELSE rank END AS a, CASE WHEN early <= 2 THEN early ELSE 0 END AS b FROM r JOIN d ON d.ws = r.ws AND d.doc = r.doc)
    SELECT ws, id, CAST(row_number() OVER (PARTITION BY ws ORDER BY part, a, b) AS INTEGER) AS place FROM t QUALIFY place <= 21""")
def _(d: Data) -> DataFrame:
    """What a weave may read of each source: two early texts of each language, then spaced by length, then the longest, 21 in all."""
    return dedupe.weave_sample(d.documents.select(F.coalesce("source", F.lit("")).alias("ws"), F.coalesce("lang", F.lit("")).alias("doc"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), F.col("n_chars").alias("size")), 21)


_DAILY = "SELECT user_id % 10 AS ws, CAST(ts AS DATE) AS day, floor(round(sum(value), 2)) AS debt FROM events GROUP BY ALL"


def _daily(d: Data) -> DataFrame:
    return d.events.groupBy((F.col("user_id") % 10).alias("ws"), F.to_date("ts").alias("day")).agg(F.floor(F.round(F.sum("value"), 2)).cast("double").alias("debt"))


@query("w05_version_lag", f"WITH m AS ({_DAILY}) SELECT ws, CAST(day AS VARCHAR) AS day, round(debt - lag(debt) OVER (PARTITION BY ws ORDER BY day), 2) AS delta FROM m")
def _(d: Data) -> DataFrame:
    return ordered.versus_previous(_daily(d), ["ws"], "day", "debt").select("ws", F.col("day").cast("string").alias("day"), F.round("delta", 2).alias("delta"))


@query("w06_debt_trend", f"""WITH m AS ({_DAILY}), l AS (SELECT ws, max(day) AS last, arg_max(debt, day) AS current FROM m GROUP BY 1),
    p AS (SELECT l.ws, current, coalesce(arg_max(debt, day) FILTER (WHERE last - day >= 20), arg_max(debt, day)) AS prior FROM l LEFT JOIN m ON m.ws = l.ws AND m.day < l.last GROUP BY ALL)
    SELECT ws, current, prior, round(current - prior, 1) AS delta, CASE WHEN prior IS NULL THEN 'Need another snapshot' WHEN abs(round(current - prior, 1)) < 0.3 THEN 'Stable' WHEN current < prior THEN 'Improving' ELSE 'Deteriorating' END AS label FROM p""")
def _(d: Data) -> DataFrame:
    return ordered.look_back(_daily(d), "ws", "day", "debt", 20)


@query("w07_drift", f"WITH m AS ({_DAILY}) SELECT ws, round(arg_max(debt, day) - arg_min(debt, day), 2) AS drift, round(arg_max(debt, day) - arg_min(debt, day), 2) >= 3 AS flagged FROM m GROUP BY 1")
def _(d: Data) -> DataFrame:
    drift = F.round(F.max_by("debt", "day") - F.min_by("debt", "day"), 2)
    return _daily(d).groupBy("ws").agg(drift.alias("drift"), (drift >= 3).alias("flagged"))


@query("w08_transitions", """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) > 25 AS ok FROM events GROUP BY ALL), t AS (SELECT *, lag(ok) OVER (PARTITION BY user_id ORDER BY day) AS was FROM r)
    SELECT user_id, count(*) FILTER (WHERE ok AND NOT was) AS newly_passed, count(*) FILTER (WHERE NOT ok AND was) AS newly_failed FROM t GROUP BY 1""")
def _(d: Data) -> DataFrame:
    r = d.events.groupBy("user_id", F.to_date("ts").alias("day")).agg((F.max("value") > 25).alias("ok"))
    t = r.withColumn("was", F.lag("ok").over(Window.partitionBy("user_id").orderBy("day")))
    return t.groupBy("user_id").agg(F.count_if(F.col("ok") & ~F.col("was")).alias("newly_passed"), F.count_if(~F.col("ok") & F.col("was")).alias("newly_failed"))


@query("w10_best_so_far", f"WITH m AS ({_DAILY}) SELECT ws, CAST(day AS VARCHAR) AS day, max(debt) OVER (PARTITION BY ws ORDER BY day) AS best FROM m")
def _(d: Data) -> DataFrame:
    return _daily(d).select("ws", F.col("day").cast("string").alias("day"), F.max("debt").over(Window.partitionBy("ws").orderBy("day")).alias("best"))


@query("w11_rank_score", "SELECT id, CAST(round(least(0.99, 0.99 - 0.04 * (row_number() OVER (PARTITION BY conv_id ORDER BY length(content) DESC, id) - 1)), 2) AS DOUBLE) AS score FROM messages")
def _(d: Data) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.char_length("content")), "id")) - 1
    return d.messages.select("id", F.round(F.least(F.lit(0.99), 0.99 - 0.04 * i), 2).alias("score"))


@query("w12_change_feed", """SELECT * FROM (SELECT 'ask' AS kind, CAST(id AS BIGINT) AS ref, conv_id AS t FROM messages WHERE role = 'user' UNION ALL SELECT 'event', event_id, user_id FROM events WHERE event_type = 'signup') ORDER BY t DESC, kind, ref LIMIT 20""")
def _(d: Data) -> DataFrame:
    """Two logs merged, newest first."""
    asks = d.messages.where("role = 'user'").select(F.lit("ask").alias("kind"), F.col("id").alias("ref"), F.col("conv_id").alias("t"))
    return asks.union(d.events.where("event_type = 'signup'").select(F.lit("event"), "event_id", "user_id")).orderBy(F.desc("t"), "kind", "ref").limit(20)


@query("w14_running_totals", "SELECT event_id, CAST(sum(CASE WHEN won THEN 1 ELSE 0 END) OVER (PARTITION BY path_key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS wins FROM outcomes")
def _(d: Data) -> DataFrame:
    """Wins of every path so far."""
    return ordered.running_count(d.outcomes, "path_key", ["ts", "event_id"], "won", "wins").select("event_id", "wins")


# --- top-k ---------------------------------------------------------------------------------------


_NEAREST = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
    SELECT query_id, vec_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 6"""


@query("t01_nearest", _NEAREST)
def _(d: Data) -> DataFrame:
    """The nearest of every 20th vector."""
    v = d.table("embeddings")
    return topk.nearest(v.where("vec_id % 20 = 0"), v, 6)


@query("t01_cell_neighbours", _NEAREST)
def _(d: Data) -> DataFrame:
    """The same through the index of cells, which opens only those that may hold one of the six."""
    v = d.table("embeddings")
    return cells.search(cells.build(v), v.where("vec_id % 20 = 0"), 6)


@query("t02_top_quotes", "SELECT edge_id, id, confidence FROM kg_evidence WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY confidence DESC, id) <= 2")
def _(d: Data) -> DataFrame:
    return topk.top_per_group(d.evidence.where("status = 'active'"), ["edge_id"], [F.desc("confidence"), "id"], 2).select("edge_id", "id", "confidence")


@query("t06_nocase_sort", "SELECT id, name, rank FROM (SELECT id, name, CAST(row_number() OVER (ORDER BY lower(name), id) AS INTEGER) AS rank FROM kg_nodes WHERE type = 'Organization') WHERE rank <= 50")
def _(d: Data) -> DataFrame:
    top = d.nodes.where("type = 'Organization'").orderBy(F.lower("name"), "id").limit(50)
    return top.select("id", "name", F.row_number().over(Window.orderBy(F.lower("name"), "id")).alias("rank"))


@query("t07_quoted_first", "SELECT id FROM (SELECT e.id, EXISTS (SELECT 1 FROM kg_evidence v WHERE v.edge_id = e.id AND v.confidence > 0.97) AS quoted FROM kg_active e) ORDER BY quoted DESC, id DESC LIMIT 30")
def _(d: Data) -> DataFrame:
    has = d.evidence.where("confidence > 0.97").select(F.col("edge_id").alias("id"), F.lit(True).alias("quoted")).distinct()
    return d.active_edges.join(has, "id", "left").orderBy(F.desc(F.coalesce("quoted", F.lit(False))), F.desc("id")).select("id").limit(30)


@query("t10_gap_recommendations", f"""WITH c AS ({_COVER}) SELECT section, round((100 - coverage_pct) * pages / (SELECT sum(pages) FROM c), 1) AS gain FROM c WHERE coverage_pct < 70 ORDER BY gain DESC, section LIMIT 8""")
def _(d: Data) -> DataFrame:
    c = _cover(d)
    total = c.agg(F.sum("pages").alias("total"))
    return c.where("coverage_pct < 70").crossJoin(F.broadcast(total)).select("section", F.round((100 - F.col("coverage_pct")) * F.col("pages") / F.col("total"), 1).alias("gain")).orderBy(F.desc("gain"), "section").limit(8)


@query("t14_hub_labels", """WITH g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM kg_active UNION ALL SELECT dst FROM kg_active) GROUP BY 1)
    SELECT node, degree FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS r FROM g) WHERE r <= least(80, greatest(24, (SELECT count(*) FROM g) * 4 // 100))""")
def _(d: Data) -> DataFrame:
    """Hubs: four per cent of the nodes, between 24 and 80."""
    g = joins.degrees(d.active_edges)
    n = g.agg(F.least(F.lit(80), F.greatest(F.lit(24), F.floor(F.count("*") * 4 / 100))).alias("k"))
    top = g.orderBy(F.desc("degree"), "node").limit(80).withColumn("r", F.row_number().over(Window.orderBy(F.desc("degree"), "node")))
    return top.crossJoin(F.broadcast(n)).where("r <= k").select("node", "degree")


@query("t16_dominant", """WITH s AS (SELECT conv_id, id, length(content) // 100 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(content) // 100 DESC, id) AS r FROM messages)
    SELECT a.conv_id, a.id FROM s a LEFT JOIN s b ON b.conv_id = a.conv_id AND b.r = 2 WHERE a.r = 1 AND a.score >= 6 AND a.score >= coalesce(b.score, 0) + 3""")
def _(d: Data) -> DataFrame:
    """A match that is clearly ahead of the second."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "id")
    s = d.messages.select("conv_id", "id", F.floor(F.char_length("content") / 100).alias("score"))
    s = s.select("*", F.row_number().over(w).alias("r"), F.lead("score").over(w).alias("second"))
    return s.where("r = 1 AND score >= 6 AND score >= coalesce(second, 0) + 3").select("conv_id", "id")


# --- set operations ------------------------------------------------------------------------------


@query("d03_near_duplicates", None)
def _(d: Data) -> DataFrame:
    """Greedy near-duplicate clustering over TF-IDF cosine."""
    return dedupe.near_duplicates(d.documents.select(F.col("doc_id").alias("id"), "text"), 0.85)


@query("d04_ordered_distinct", "SELECT name, min(id) AS first FROM (SELECT lower(p_name) AS name, p_partkey AS id FROM part) GROUP BY 1")
def _(d: Data) -> DataFrame:
    return d.table("part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("first"))


@query("d05_appeared", """(SELECT 'appeared' AS change, user_id FROM events WHERE day(ts) = 9 EXCEPT SELECT 'appeared', user_id FROM events WHERE day(ts) = 8) UNION ALL (SELECT 'disappeared', user_id FROM events WHERE day(ts) = 8 EXCEPT SELECT 'disappeared', user_id FROM events WHERE day(ts) = 9)""")
def _(d: Data) -> DataFrame:
    """Both set differences from one grouping."""
    day = F.dayofmonth("ts")
    e = d.events.where(day.isin(8, 9)).groupBy("user_id").agg(F.max((day == 8).cast("int")).alias("was"), F.max((day == 9).cast("int")).alias("now")).where("was <> now")
    return e.select(F.when(F.col("now") == 1, "appeared").otherwise("disappeared").alias("change"), "user_id")


@query("d07_undirected", """SELECT least(src, dst) AS a, greatest(src, dst) AS b, rel_type, max(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS evidenced FROM kg_edges GROUP BY 1, 2, 3""")
def _(d: Data) -> DataFrame:
    ends = d.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type", "status")
    return graph.spread(ends, d.edge_parts, "a", "b", "rel_type").groupBy("a", "b", "rel_type").agg(F.max((F.col("status") == "active").cast("int")).alias("evidenced"))


@query("d08_natural_key", "SELECT src, dst, rel_type, edge_class, min(id) AS id FROM kg_active WHERE src <> dst GROUP BY 1, 2, 3, 4")
def _(d: Data) -> DataFrame:
    keys = ["src", "dst", "rel_type", "edge_class"]
    return graph.spread(d.active_edges.where("src <> dst").select(*keys, "id"), d.edge_parts, *keys).groupBy(*keys).agg(F.min("id").alias("id"))


@query("d09_conflict_pairs", """WITH f AS (SELECT DISTINCT p_brand AS src, CAST(floor(p_retailprice / 5) * 5 AS BIGINT) AS amount FROM part)
    SELECT x.src, x.amount AS low, y.amount AS high FROM f x JOIN f y ON x.src = y.src AND x.amount < y.amount""")
def _(d: Data) -> DataFrame:
    """Pairs of distinct amounts of one entity: amounts are collapsed before they are paired."""
    f = d.table("part").select(F.col("p_brand").alias("src"), (F.floor(F.col("p_retailprice") / 5) * 5).cast("long").alias("amount")).distinct()
    return f.withColumnRenamed("amount", "low").join(f.withColumnRenamed("amount", "high"), "src").where("low < high").select("src", "low", "high")


@query("d10_alias_prune", f"WITH al AS ({_ALIASES}) SELECT node_id, normalized_alias FROM al WHERE NOT EXISTS (SELECT 1 FROM kg_nodes n WHERE n.id = al.node_id AND contains(al.normalized_alias, 'ring'))")
def _(d: Data) -> DataFrame:
    keep = _aliases(d).where(F.col("normalized_alias").contains("ring")).join(d.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return _aliases(d).join(keep, ["node_id", "normalized_alias"], "left_anti")


@query("d11_shared_tokens", r"""WITH t AS (SELECT id, conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda w: length(w) >= 5))) AS w FROM messages), p AS (SELECT id, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn, id) AS was FROM t)
    SELECT id, len(list_intersect(w, was)) > 0 AS shared, CAST(len(list_intersect(w, was)) AS INTEGER) AS n FROM p WHERE was IS NOT NULL""")
def _(d: Data) -> DataFrame:
    """Whether a turn shares a token of five characters or more with the one before it."""
    w = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.char_length(x) >= 5))
    t = d.messages.select("id", w.alias("w"), F.lag(w).over(Window.partitionBy("conv_id").orderBy("turn", "id")).alias("was")).where("was IS NOT NULL")
    return t.select("id", F.arrays_overlap("w", "was").alias("shared"), F.size(F.array_intersect("w", "was")).alias("n"))
