"""The knowledge tables, derived from the star schema, and their twins in SQL for the oracle.

Customers, suppliers, parts, nations and regions are nodes; foreign keys are edges; order lines are the
evidence of supplier-part edges; conversations are the ask log; events are outcomes and feedback.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FIRST = ("Ada", "Grace", "Alan", "Edsger", "Barbara", "Donald", "Mary")
LAST = ("Hopper", "Turing", "Liskov", "Knuth", "Reid-Dodick")
ROLES = ("Chief Executive Officer", "CFO", "Vice President", "Chief People and Culture Officer", "engineer", "former CTO")
PLACES = ("https://x.example/about/leaders", "https://x.example/news/item", "https://x.example/services/cloud", "handbook", "https://x.example/learning-path", "https://x.example/insights/renew")


#: Order lines, and the edges that come of them, of one task, about; and parts at least.
PART_ROWS, LEAST_PARTS = 250_000, 16


class Data:
    """Lazily built DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        """id, name, normalized_name, type"""
        kinds = (("region", "r_regionkey", "r_name", "Section"), ("nation", "n_nationkey", "n_name", "Topic"), ("customer", "c_custkey", "c_name", "Person"), ("supplier", "s_suppkey", "s_name", "Organization"), ("part", "p_partkey", "p_name", "Product"))
        parts = [self.table(t).select(F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("id"), F.col(n).alias("name"), F.lower(n).alias("normalized_name"), F.lit(kind).alias("type")) for t, k, n, kind in kinds]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def edge_parts(self) -> int:
        """Parts that the edges are dealt into, by the number of order lines, so that a task's memory doesn't grow with the tables."""
        return max(LEAST_PARTS, -(-self.table("lineitem").count() // PART_ROWS))

    @cached_property
    def edges(self) -> DataFrame:
        """id, src, dst, rel_type, edge_class, status, weight"""
        ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
        one = lambda v: F.lit(v)
        nation = self.table("nation").select(ref("nr", "n_nationkey").alias("id"), ref("nation", "n_nationkey").alias("src"), ref("region", "n_regionkey").alias("dst"), one("PART_OF").alias("rel_type"), one("asserted_fact").alias("edge_class"), one("active").alias("status"), one(1.0).alias("weight"))
        k = F.col("c_custkey")
        customer = self.table("customer").select(ref("cn", "c_custkey").alias("id"), ref("customer", "c_custkey").alias("src"), ref("nation", "c_nationkey").alias("dst"), one("BELONGS_TO").alias("rel_type"), F.when(k % 5 == 0, "documentary").otherwise("asserted_fact").alias("edge_class"), F.when(k % 17 == 0, "superseded").otherwise("active").alias("status"), F.round(0.3 + (k % 20) * 0.05, 2).alias("weight"))
        supplier = self.table("supplier").select(ref("sn", "s_suppkey").alias("id"), ref("supplier", "s_suppkey").alias("src"), ref("nation", "s_nationkey").alias("dst"), one("BELONGS_TO").alias("rel_type"), one("asserted_fact").alias("edge_class"), one("active").alias("status"), one(1.0).alias("weight"))
        s, p = F.col("l_suppkey"), F.col("l_partkey")
        provides = self.table("lineitem").select("l_suppkey", "l_partkey").repartition(self.edge_parts, "l_suppkey", "l_partkey").distinct().select(
            F.concat_ws(":", F.lit("sp"), s.cast("string"), p.cast("string")).alias("id"), ref("supplier", "l_suppkey").alias("src"), ref("part", "l_partkey").alias("dst"), one("PROVIDES").alias("rel_type"), one("asserted_fact").alias("edge_class"), F.when((s + p) % 13 == 0, "superseded").otherwise("active").alias("status"), F.round(0.4 + (p % 15) * 0.06, 2).alias("weight")
        )
        return nation.unionByName(customer).unionByName(supplier).unionByName(provides)

    @cached_property
    def active_edges(self) -> DataFrame:
        return self.edges.where("status = 'active'")

    @cached_property
    def evidence(self) -> DataFrame:
        """id, edge_id, chunk_id, quote, confidence, status"""
        return self.table("lineitem").select(
            F.concat_ws(":", F.lit("ev"), *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"),
            F.concat_ws(":", F.lit("sp"), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("edge_id"),
            F.col("l_orderkey").alias("chunk_id"),
            F.concat("l_returnflag", "l_linestatus").alias("quote"),
            F.round(1 - F.col("l_discount"), 2).alias("confidence"),
            F.when(F.col("l_returnflag") == "R", "superseded").otherwise("active").alias("status"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        """id, conv_id, turn, role, content, decision, trust: decision and trust of assistant messages only"""
        n = F.char_length("text")
        spoken = F.col("role") == "assistant"
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", F.col("text").alias("content"),
            F.when(spoken, F.when(n % 7 == 0, "refuse").when(n % 7 == 1, "clarify").otherwise("answer")).alias("decision"),
            F.when(spoken & (n % 11 != 0), (n % 101) / 100.0).alias("trust"),
        )

    @cached_property
    def passages(self) -> DataFrame:
        """id, title, text: passages about people, procedures, accounts, menus and plans, one for each customer"""
        k = F.col("c_custkey")
        pick = lambda listed, n: F.element_at(F.array(*map(F.lit, listed)), (n % len(listed) + 1).cast("int"))
        n = lambda by: F.floor(k / by)
        person = F.concat_ws(" ", pick(FIRST, k), pick(LAST, n(7)))
        spoken = F.concat(person, F.lit(", "), pick(ROLES, n(5)), F.lit(", leads the "), F.col("c_mktsegment"), F.lit(" group since "), (2008 + k % 17).cast("string"), F.lit(". "), pick(LAST, n(3)), F.lit(" signed for it."))
        accounts = F.concat(F.lit("# Cloud Data Services\nA "), F.col("c_mktsegment"), F.lit(" account is a record that provides credit. Over 12,000 employees in "), (k % 40).cast("string"), F.lit(" offices and 30+ years of experience. Retail Banking Platform and Digital Product Experience are our services."))
        texts = F.when(k % 5 == 0, spoken).when(k % 5 == 1, F.concat(F.lit("To renew a licence, first select the form and then submit it. Step 2 must follow within "), (k % 30).cast("string"), F.lit(" days.")))
        texts = texts.when(k % 5 == 2, accounts).when(k % 5 == 3, F.concat(F.lit("Home | About Us | Contact Us | Site Map | Skip to content. All rights reserved by "), F.col("c_name")))
        texts = texts.otherwise(F.concat(F.lit("The SL"), (1000 * (k % 4)).cast("string"), F.lit(" gold plan differs from the silver plan. Imagine. Design. Deliver. That is our transformation pathway.")))
        return self.table("customer").select(k.alias("id"), F.concat(pick(PLACES, n(2)), F.lit("/"), k.cast("string")).alias("title"), texts.alias("text"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def outcomes(self) -> DataFrame:
        """event_id, ts, path_key, won: purchases win, errors lose"""
        return self.events.where(F.col("event_type").isin("purchase", "error")).select("event_id", "ts", F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("path_key"), (F.col("event_type") == "purchase").alias("won"))


#: The same tables for DuckDB.
SQL = {
    "kg_nodes": """SELECT 'region:' || r_regionkey AS id, r_name AS name, lower(r_name) AS normalized_name, 'Section' AS type FROM region
        UNION ALL SELECT 'nation:' || n_nationkey, n_name, lower(n_name), 'Topic' FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, c_name, lower(c_name), 'Person' FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, s_name, lower(s_name), 'Organization' FROM supplier
        UNION ALL SELECT 'part:' || p_partkey, p_name, lower(p_name), 'Product' FROM part""",
    "kg_edges": """SELECT 'nr:' || n_nationkey AS id, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'PART_OF' AS rel_type, 'asserted_fact' AS edge_class, 'active' AS status, 1.0::DOUBLE AS weight FROM nation
        UNION ALL SELECT 'cn:' || c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'BELONGS_TO', CASE WHEN c_custkey % 5 = 0 THEN 'documentary' ELSE 'asserted_fact' END, CASE WHEN c_custkey % 17 = 0 THEN 'superseded' ELSE 'active' END, round(0.3::DOUBLE + (c_custkey % 20) * 0.05::DOUBLE, 2) FROM customer
        UNION ALL SELECT 'sn:' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BELONGS_TO', 'asserted_fact', 'active', 1.0 FROM supplier
        UNION ALL SELECT 'sp:' || l_suppkey || ':' || l_partkey, 'supplier:' || l_suppkey, 'part:' || l_partkey, 'PROVIDES', 'asserted_fact', CASE WHEN (l_suppkey + l_partkey) % 13 = 0 THEN 'superseded' ELSE 'active' END, round(0.4::DOUBLE + (l_partkey % 15) * 0.06::DOUBLE, 2) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""",
    "kg_active": "SELECT * FROM kg_edges WHERE status = 'active'",
    "kg_evidence": """SELECT 'ev:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, 'sp:' || l_suppkey || ':' || l_partkey AS edge_id, l_orderkey AS chunk_id, l_returnflag || l_linestatus AS quote, round(1 - l_discount, 2) AS confidence, CASE WHEN l_returnflag = 'R' THEN 'superseded' ELSE 'active' END AS status FROM lineitem""",
    "messages": """SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text AS content, CASE WHEN role = 'assistant' THEN CASE length(text) % 7 WHEN 0 THEN 'refuse' WHEN 1 THEN 'clarify' ELSE 'answer' END END AS decision, CASE WHEN role = 'assistant' AND length(text) % 11 <> 0 THEN (length(text) % 101) / 100.0::DOUBLE END AS trust FROM conversations""",
    "passages": """SELECT k AS id, places[CAST((k // 2) % 6 + 1 AS BIGINT)] || '/' || k AS title, CASE k % 5
        WHEN 0 THEN first[CAST(k % 7 + 1 AS BIGINT)] || ' ' || last[CAST((k // 7) % 5 + 1 AS BIGINT)] || ', ' || roles[CAST((k // 5) % 6 + 1 AS BIGINT)] || ', leads the ' || seg || ' group since ' || (2008 + k % 17) || '. ' || last[CAST((k // 3) % 5 + 1 AS BIGINT)] || ' signed for it.'
        WHEN 1 THEN 'To renew a licence, first select the form and then submit it. Step 2 must follow within ' || (k % 30) || ' days.'
        WHEN 2 THEN '# Cloud Data Services' || chr(10) || 'A ' || seg || ' account is a record that provides credit. Over 12,000 employees in ' || (k % 40) || ' offices and 30+ years of experience. Retail Banking Platform and Digital Product Experience are our services.'
        WHEN 3 THEN 'Home | About Us | Contact Us | Site Map | Skip to content. All rights reserved by ' || name ELSE 'The SL' || (1000 * (k % 4)) || ' gold plan differs from the silver plan. Imagine. Design. Deliver. That is our transformation pathway.' END AS text
        FROM (SELECT c_custkey AS k, c_mktsegment AS seg, c_name AS name, ['Ada', 'Grace', 'Alan', 'Edsger', 'Barbara', 'Donald', 'Mary'] AS first, ['Hopper', 'Turing', 'Liskov', 'Knuth', 'Reid-Dodick'] AS last, ['Chief Executive Officer', 'CFO', 'Vice President', 'Chief People and Culture Officer', 'engineer', 'former CTO'] AS roles,
            ['https://x.example/about/leaders', 'https://x.example/news/item', 'https://x.example/services/cloud', 'handbook', 'https://x.example/learning-path', 'https://x.example/insights/renew'] AS places FROM customer)""",
    "outcomes": "SELECT event_id, ts, 'p' || (user_id % 40) AS path_key, event_type = 'purchase' AS won FROM events WHERE event_type IN ('purchase', 'error')",
}


def with_tables(sql: str) -> str:
    """``sql`` with the definitions of the knowledge tables that it names in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(body)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{heads}, {body.removeprefix(head)}"
    return f"WITH {heads} {body}"
