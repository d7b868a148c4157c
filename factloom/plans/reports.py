"""Smaller rules and report lines over the knowledge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import web
from factloom.operators import aggregates
from factloom.plans.datasets import Data
from factloom.plans.registry import query
from factloom.plans.relational import _DEBT, _debt_in
from factloom.plans.texts import _U, _urls

#: Relations that documents have with what they hold; never asserted facts.
DOCUMENTARY = ("CONTAINS", "MENTIONS", "DEFINED_IN")


@query("f18_trail_edges", "SELECT e.id FROM kg_active e WHERE edge_class = 'asserted_fact' AND weight >= 0.55 AND EXISTS (SELECT 1 FROM kg_evidence v WHERE v.edge_id = e.id AND v.status = 'active' AND v.confidence >= 0.95)")
def _(d: Data) -> DataFrame:
    sure = d.evidence.where("status = 'active' AND confidence >= 0.95").select(F.col("edge_id").alias("id"))
    return d.active_edges.where("edge_class = 'asserted_fact' AND weight >= 0.55").join(sure, "id", "left_semi").select("id")


@query("f20_relation_type", r"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'mentions ' ELSE p_type || ' -- of/' || p_name END AS raw FROM part), n AS (SELECT p_partkey, upper(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS t FROM r)
    SELECT p_partkey, CASE WHEN t = '' OR length(t) > 40 OR t IN ('CONTAINS', 'MENTIONS', 'DEFINED_IN') THEN NULL ELSE t END AS rel FROM n""")
def _(d: Data) -> DataFrame:
    """Relation names in upper snake case; documentary ones, empty ones and long ones are rejected."""
    raw = F.when(F.col("p_partkey") % 7 == 0, "mentions ").otherwise(F.concat("p_type", F.lit(" -- of/"), "p_name"))
    t = F.upper(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return d.table("part").select("p_partkey", t.alias("t")).select("p_partkey", F.when(~((F.col("t") == "") | (F.char_length("t") > 40) | F.col("t").isin(*DOCUMENTARY)), F.col("t")).alias("rel"))


@query("f22_verify_needed", "SELECT id, coalesce(trust, 0) < 0.55 OR conv_id % 9 = 0 AS verify FROM messages WHERE role = 'assistant'")
def _(d: Data) -> DataFrame:
    """Low trust, or a regulated domain."""
    return d.messages.where("role = 'assistant'").select("id", ((F.coalesce("trust", F.lit(0.0)) < 0.55) | (F.col("conv_id") % 9 == 0)).alias("verify"))


@query("f23_buckets", "SELECT event_id, CASE WHEN event_type IN ('signup', 'error') THEN 'govern' WHEN event_type = 'purchase' THEN 'maintain' ELSE 'observe' END AS bucket FROM events")
def _(d: Data) -> DataFrame:
    e = F.col("event_type")
    return d.events.select("event_id", F.when(e.isin("signup", "error"), "govern").when(e == "purchase", "maintain").otherwise("observe").alias("bucket"))


@query("f25_readiness", "SELECT n.n_nationkey AS agent, CASE WHEN n_nationkey % 11 = 0 THEN 'disabled' WHEN n_nationkey % 3 = 0 THEN 'live' WHEN count(s_suppkey) > 3 THEN 'ready' ELSE 'draft' END AS label FROM nation n LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(d: Data) -> DataFrame:
    k = F.col("n_nationkey")
    held = d.table("nation").join(d.table("supplier"), F.col("s_nationkey") == k, "left").groupBy(k.alias("agent")).agg(F.count("s_suppkey").alias("n"))
    a = F.col("agent")
    return held.select("agent", F.when(a % 11 == 0, "disabled").when(a % 3 == 0, "live").when(F.col("n") > 3, "ready").otherwise("draft").alias("label"))


@query("a08_top_agent", """WITH g AS (SELECT c_nationkey AS agent, count(*) AS n FROM customer GROUP BY 1) SELECT agent, n FROM g ORDER BY n DESC, agent DESC LIMIT 1""")
def _(d: Data) -> DataFrame:
    """The busiest agent; of equals the later one."""
    g = d.table("customer").groupBy(F.col("c_nationkey").alias("agent")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), F.desc("agent")).limit(1)


@query("a28_ask_readiness", """SELECT source, count(*) AS docs, round(100.0 * count(*) FILTER (WHERE n_chars < 400) / count(*), 1) AS thin_pct, count(*) >= 40 AND count(*) FILTER (WHERE lang <> 'en') / count(*) >= 0.35 AS skewed FROM documents GROUP BY 1""")
def _(d: Data) -> DataFrame:
    n, other = F.count("*"), F.count_if(F.col("lang") != "en")
    return d.documents.groupBy("source").agg(n.alias("docs"), F.round(100.0 * F.count_if(F.col("n_chars") < 400) / n, 1).alias("thin_pct"), ((n >= 40) & (other / n >= 0.35)).alias("skewed"))


@query("a30_debt_split", f"WITH p AS ({_DEBT}) SELECT k, round(conflicts + trust + CASE WHEN k % 4 = 0 THEN topics + coverage ELSE 0.0 END, 1) AS high_impact, round(weak_edges + unanswered + CASE WHEN k % 4 = 0 THEN 0.0 ELSE topics + coverage END, 1) AS low_impact FROM p")
def _(d: Data) -> DataFrame:
    """Debt by impact: topics and coverage weigh where a critical section lacks them."""
    c, p = F.col("k") % 4 == 0, F.col("topics") + F.col("coverage")
    debt = aggregates.debt(_debt_in(d))
    return debt.select("k", F.round(F.col("conflicts") + F.col("trust") + F.when(c, p).otherwise(0.0), 1).alias("high_impact"), F.round(F.col("weak_edges") + F.col("unanswered") + F.when(c, 0.0).otherwise(p), 1).alias("low_impact"))


@query("a35_impact", "SELECT source, CAST(least(40, count(*) * CASE WHEN contains(source, '1') THEN 3 ELSE 1 END) AS BIGINT) AS apis, CAST(least(12, greatest(1, count(*) // 3)) AS BIGINT) AS applications, CAST(least(8, greatest(1, 1 + count(*) // 8)) AS BIGINT) AS teams FROM documents GROUP BY 1")
def _(d: Data) -> DataFrame:
    g = d.documents.groupBy("source").agg(F.count("*").alias("n"))
    n, cap = F.col("n"), lambda most, x: F.least(F.lit(most).cast("long"), x.cast("long"))
    return g.select("source", cap(40, n * F.when(F.col("source").contains("1"), 3).otherwise(1)).alias("apis"), cap(12, F.greatest(F.lit(1), F.floor(n / 3))).alias("applications"), cap(8, F.greatest(F.lit(1), 1 + F.floor(n / 8))).alias("teams"))


@query("t05_overview_documents", "SELECT doc_id, quality + toxic AS score FROM documents JOIN labels USING (doc_id) ORDER BY score DESC, doc_id DESC LIMIT 12")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id").join(d.table("labels"), "doc_id").select("doc_id", (F.col("quality") + F.col("toxic")).alias("score")).orderBy(F.desc("score"), F.desc("doc_id")).limit(12)


@query("t08_quote_rerank", """SELECT id, round(confidence + 0.08 * length(quote) + CASE WHEN confidence >= 0.35 THEN 0.12 ELSE 0.0 END - CASE WHEN status <> 'active' THEN 0.25 ELSE 0.0 END, 4) AS score FROM kg_evidence ORDER BY score DESC, id LIMIT 40""")
def _(d: Data) -> DataFrame:
    c = F.col("confidence")
    score = c + 0.08 * F.char_length("quote") + F.when(c >= 0.35, 0.12).otherwise(0.0) - F.when(F.col("status") != "active", 0.25).otherwise(0.0)
    return d.evidence.select("id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(40)


@query("t09_prune_quotes", "SELECT edge_id, id FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY confidence DESC, id) AS r, count(*) FILTER (WHERE confidence >= 0.96) OVER (PARTITION BY edge_id) AS good FROM kg_evidence) WHERE (confidence >= 0.96 AND r <= 5) OR (good = 0 AND r = 1)")
def _(d: Data) -> DataFrame:
    """Well supported quotes, five at most; the best one where none is."""
    by = Window.partitionBy("edge_id")
    ranked = d.evidence.select("edge_id", "id", "confidence", F.row_number().over(by.orderBy(F.desc("confidence"), "id")).alias("r"), F.count_if(F.col("confidence") >= 0.96).over(by).alias("good"))
    return ranked.where("(confidence >= 0.96 AND r <= 5) OR (good = 0 AND r = 1)").select("edge_id", "id")


@query("t11_source_rows", f"""WITH {_U}, s AS (SELECT page_id, page_id % 300 > 180 AS stale, CASE WHEN people THEN 0.92 WHEN core THEN 0.88 WHEN chronicle THEN 0.42 ELSE 0.62 END::DOUBLE AS trust FROM x) SELECT page_id, stale, trust FROM s ORDER BY stale DESC, trust, page_id LIMIT 20""")
def _(d: Data) -> DataFrame:
    """Stale sources first, then the least trusted."""
    s = _urls(d).select("page_id", (F.col("page_id") % 300 > 180).alias("stale"), web.trust_weight(F.col("url")).alias("trust"))
    return s.orderBy(F.desc("stale"), "trust", "page_id").limit(20)


@query("s36_ratings", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'up' ELSE 'down' END AS rating, substr(props, 1, 500) AS note FROM events")
def _(d: Data) -> DataFrame:
    return d.events.select("event_id", F.when(F.col("event_type") == "purchase", "up").otherwise("down").alias("rating"), F.substring("props", 1, 500).alias("note"))


@query("k03_progress", "SELECT event_id, least(0.99, greatest(0.1, round(0.1 + (value / 100.0) * 0.8, 3))) AS progress FROM events")
def _(d: Data) -> DataFrame:
    return d.events.select("event_id", F.least(F.lit(0.99), F.greatest(F.lit(0.1), F.round(0.1 + (F.col("value") / 100.0) * 0.8, 3))).alias("progress"))


@query("k07_one_active_job", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(d: Data) -> DataFrame:
    """The job of each workspace that may run: the latest."""
    return d.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("r33_draft_cases", "SELECT id, CASE WHEN len(m) > 0 THEN 'answer' ELSE 'either' END AS expect, CAST(len(m) AS INTEGER) AS n FROM (SELECT id, list_filter(string_split(CASE WHEN id % 3 = 0 THEN '' ELSE replace(substr(content, 1, 60), ' ', '|') END, '|'), lambda x: x <> '') AS m FROM messages WHERE role = 'user')")
def _(d: Data) -> DataFrame:
    """Drafts as golden cases: phrases are parted by bars."""
    joined = F.when(F.col("id") % 3 == 0, "").otherwise(F.replace(F.substring("content", 1, 60), F.lit(" "), F.lit("|")))
    n = F.size(F.filter(F.split(joined, r"\|"), lambda x: x != ""))
    return d.messages.where("role = 'user'").select("id", F.when(n > 0, "answer").otherwise("either").alias("expect"), n.alias("n"))


@query("r34_keywords", r"SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 4 AND t NOT IN ('what', 'when', 'this', 'that', 'with', 'from')))), ' ') AS words FROM messages WHERE role = 'user'")
def _(d: Data) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace(F.lower("content"), "[^a-z0-9]+", " "), " "), lambda t: (F.char_length(t) >= 4) & ~t.isin("what", "when", "this", "that", "with", "from"))
    return d.messages.where("role = 'user'").select("id", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("words"))


@query("s16_topic_tokens", f"""WITH {_U} SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(p, '[^a-z0-9]+', '-', 'g'), '-'), lambda t: length(t) >= 3 AND t NOT IN ('index', 'home', 'www', 'the', 'and', 'for', 'our', 'com'))[:6], ' ') AS tokens FROM x""")
def _(d: Data) -> DataFrame:
    """Words of a path that its page should hold."""
    words = F.filter(F.split(F.regexp_replace(web.url_path(F.col("url")), "[^a-z0-9]+", "-"), "-"), lambda t: (F.char_length(t) >= 3) & ~t.isin("index", "home", "www", "the", "and", "for", "our", "com"))
    return _urls(d).select("page_id", F.array_join(F.slice(words, 1, 6), " ").alias("tokens"))


@query("g10_emails", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))) AS email FROM documents")
def _(d: Data) -> DataFrame:
    """Addresses as rule-based entities."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))
    return d.documents.select("doc_id", F.explode(F.array_distinct(found)).alias("email"))


@query("g11_key_values", r"SELECT event_id, CAST(regexp_extract(props, '\x22k\x22: *([0-9]+)', 1) AS INTEGER) AS v, instr(props, regexp_extract(props, '\x22k\x22: *([0-9]+)', 1)) AS start FROM events")
def _(d: Data) -> DataFrame:
    """Key-value facts with the place of their value."""
    v = F.get_json_object("props", "$.k")
    return d.events.select("event_id", v.cast("int").alias("v"), F.instr("props", v).cast("long").alias("start"))
