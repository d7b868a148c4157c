"""Whether a workspace can be asked: its cases, its passages, its upkeep, and what it says when it can't answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.plans.datasets import Data
from factloom.plans.registry import query
from factloom.plans.texts import _SIGNALS

#: What is said for each reason not to answer, and for any other.
REFUSALS = {
    "CONTRACT_LIST_PEOPLE_UNMET": "Connected sources mention leadership in general terms but do not name the people on that team. Try asking about a specific role (for example, CEO), or connect a page that lists officers.",
    "CONTRACT_COMPARE_UNMET": "I couldn’t find sources that cover both sides of that comparison. Connect documents that mention each item, or ask about one side.",
    "CONTRACT_HOW_TO_UNMET": "I couldn’t find a process or steps for that in the connected knowledge base.",
}
UNMET = ("CONTRACT_ATTRIBUTE_UNMET", "CONTRACT_DEFINE_UNMET", "CONTRACT_FACTOID_UNMET", "CONTRACT_OPEN_UNMET")
NOT_FOUND = "I couldn’t find that in the connected knowledge base. Ask about topics covered by your uploaded or crawled sources."
NO_PASSAGES = "I couldn’t find knowledge-base passages for that question. Connect more sources, or ask with terms that appear in your documents."
REASONS = (*REFUSALS, *UNMET, "NO_QUOTE_EVIDENCE")


@query("r31_refusals", "SELECT id, CASE id % 8 WHEN 0 THEN 'Connected sources mention leadership in general terms but do not name the people on that team. Try asking about a specific role (for example, CEO), or connect a page that lists officers.' WHEN 1 THEN 'I couldn’t find sources that cover both sides of that comparison. Connect documents that mention each item, or ask about one side.' WHEN 2 THEN 'I couldn’t find a process or steps for that in the connected knowledge base.' WHEN 7 THEN 'I couldn’t find knowledge-base passages for that question. Connect more sources, or ask with terms that appear in your documents.' ELSE 'I couldn’t find that in the connected knowledge base. Ask about topics covered by your uploaded or crawled sources.' END AS message FROM messages WHERE decision = 'refuse'")
def _(d: Data) -> DataFrame:
    """What refused askers are told, by reason: a lookup."""
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("id") % len(REASONS) + 1).cast("int"))
    told = F.create_map(*(F.lit(x) for pair in (*REFUSALS.items(), *((r, NOT_FOUND) for r in UNMET)) for x in pair))
    return d.messages.where("decision = 'refuse'").select("id", F.coalesce(F.try_element_at(told, reason), F.lit(NO_PASSAGES)).alias("message"))


@query("a28_readiness_status", rf"""WITH {_SIGNALS}, p AS (SELECT s2.doc_id, source, size, chrome, prose, s2.kind AS doc_kind FROM s2 JOIN documents USING (doc_id)), g AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE size >= 20) AS scored, round(100.0 * count(*) FILTER (WHERE size >= 20 AND chrome >= 0.55) / greatest(1, count(*) FILTER (WHERE size >= 20)), 1) AS chrome_pct, count(*) FILTER (WHERE doc_id % 3 = 0) AS client, count(*) FILTER (WHERE doc_id % 50 = 1) AS corporate FROM p GROUP BY 1),
    r AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE prose_ok) AS passed FROM (SELECT source, prose >= 0.5 AND doc_kind <> 'nav' AS prose_ok FROM p WHERE doc_id % 5 = 0) GROUP BY 1), j AS (SELECT g.*, coalesce(total, 0) AS total, round(coalesce(passed, 0) / greatest(1, coalesce(total, 0)), 3) AS pass_rate, docs >= 40 AND client / docs >= 0.35 AND corporate = 0 AS skewed FROM g LEFT JOIN r USING (source))
    SELECT source, docs, pass_rate, skewed, CASE WHEN docs = 0 THEN 'unknown' WHEN pass_rate >= 0.99 AND (chrome_pct < 70 OR scored < 5) AND NOT skewed THEN 'ready' ELSE 'needs_attention' END AS status FROM j""")
def _(d: Data) -> DataFrame:
    """Readiness of every source: its cases pass, its passages aren't page frames, and it isn't made of clients' pages alone."""
    s = text.passage_struct(F.col("source"), F.col("text")).alias("s")
    p = d.documents.select("doc_id", "source", F.char_length(text.stripped(F.col("text"))).alias("size"), s).select("doc_id", "source", "size", F.col("s.chrome_score").alias("chrome"), F.col("s.prose_score").alias("prose"), F.col("s.doc_kind").alias("kind"))
    case, ok = F.col("doc_id") % 5 == 0, (F.col("prose") >= 0.5) & (F.col("kind") != "nav")
    shown = F.col("size") >= 20
    g = p.groupBy("source").agg(
        F.count("*").alias("docs"), F.count_if(shown).alias("scored"), F.round(100.0 * F.count_if(shown & (F.col("chrome") >= 0.55)) / F.greatest(F.lit(1), F.count_if(shown)), 1).alias("chrome_pct"),
        F.count_if(F.col("doc_id") % 3 == 0).alias("client"), F.count_if(F.col("doc_id") % 50 == 1).alias("corporate"), F.round(F.count_if(case & ok) / F.greatest(F.lit(1), F.count_if(case)), 3).alias("pass_rate"),
    )
    skewed = (F.col("docs") >= 40) & (F.col("client") / F.col("docs") >= 0.35) & (F.col("corporate") == 0)
    ready = (F.col("pass_rate") >= 0.99) & ((F.col("chrome_pct") < 70) | (F.col("scored") < 5)) & ~skewed
    return g.select("source", "docs", "pass_rate", skewed.alias("skewed"), F.when(F.col("docs") == 0, "unknown").when(ready, "ready").otherwise("needs_attention").alias("status"))


@query("r33_case_order", """WITH d AS (SELECT id, trim(x) AS must FROM (SELECT id, unnest(string_split(replace(substr(content, 1, 40), ' ', '|'), '|')) AS x FROM messages WHERE role = 'user' AND id % 2 = 0) WHERE trim(x) <> ''), a AS (SELECT 'draft:' || m.id AS case_id, 0 AS suite, count(must) AS n FROM (SELECT id FROM messages WHERE role = 'user' AND id % 2 = 0) m LEFT JOIN d ON d.id = m.id GROUP BY m.id), s AS (SELECT 'case:' || item_id AS case_id, 1 AS suite, 1 AS n FROM benchmark)
    SELECT case_id, CASE WHEN n > 0 THEN 'answer' ELSE 'either' END AS expect, CAST(n AS BIGINT) AS phrases, CAST(row_number() OVER (ORDER BY suite, case_id) AS BIGINT) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM s)""")
def _(d: Data) -> DataFrame:
    """Accepted drafts as golden cases, run before those of the suite; a case without phrases may end either way."""
    from factloom.operators.dedupe import global_rank

    phrases = F.filter(F.split(F.replace(F.substring("content", 1, 40), F.lit(" "), F.lit("|")), r"\|"), lambda x: F.trim(x) != "")
    drafts = d.messages.where("role = 'user' AND id % 2 = 0").select(F.concat(F.lit("draft:"), F.col("id").cast("string")).alias("case_id"), F.lit(0).alias("suite"), F.size(phrases).cast("long").alias("phrases"))
    suite = d.table("benchmark").select(F.concat(F.lit("case:"), F.col("item_id").cast("string")).alias("case_id"), F.lit(1).alias("suite"), F.lit(1).cast("long").alias("phrases"))
    ranked = global_rank(drafts.unionByName(suite), [F.col("suite"), F.col("case_id")], "place")
    return ranked.select("case_id", F.when(F.col("phrases") > 0, "answer").otherwise("either").alias("expect"), "phrases", F.col("place").cast("long").alias("place"))


@query("k02_care_ticks", """WITH e AS (SELECT user_id % 5 AS ws, time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP)) AS tick, event_type FROM events), t AS (SELECT ws, tick, count(*) AS n, bool_or(event_type = 'purchase') AS busy FROM e GROUP BY ALL)
    SELECT ws, CAST(tick AS VARCHAR) AS tick, CASE WHEN busy THEN 'busy' WHEN (hour(tick) - 22 + 24) % 24 >= 5 THEN 'day' WHEN tick - coalesce(lag(tick) OVER (PARTITION BY ws, NOT busy AND (hour(tick) - 22 + 24) % 24 < 5 ORDER BY tick), tick - INTERVAL 1 DAY) < INTERVAL 20 MINUTE THEN 'observe' ELSE 'care' END AS action FROM t""")
def _(d: Data) -> DataFrame:
    """Care of every workspace by ticks of ten minutes: none while it ingests or by day, no second round within twenty minutes of the last tick that could care."""
    from pyspark.sql import Window

    tick = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600) * 600)
    t = d.events.groupBy((F.col("user_id") % 5).alias("ws"), tick.alias("tick")).agg(F.max(F.col("event_type") == "purchase").alias("busy"))
    may = ~F.col("busy") & text.in_window(F.hour("tick"), 22, 5)
    last = F.lag("tick").over(Window.partitionBy("ws", "may").orderBy("tick"))
    t = t.withColumn("may", may).withColumn("since", F.unix_timestamp("tick") - F.unix_timestamp(last))
    action = F.when(F.col("busy"), "busy").when(~F.col("may"), "day").when(F.col("since") < 1200, "observe").otherwise("care")
    return t.select("ws", F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"), action.alias("action"))
