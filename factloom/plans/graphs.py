"""Graph queries and batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import graph, joins, ordered
from factloom.plans.datasets import Data
from factloom.plans.registry import query
from factloom.streaming import limits

_TWO = "kg_two AS (SELECT src AS u, dst AS v FROM kg_active UNION ALL SELECT dst, src FROM kg_active)"


@query("g01_adjacency", f"WITH {_TWO} SELECT u AS node, count(*) AS n, min(v) AS first FROM kg_two GROUP BY 1")
def _(d: Data) -> DataFrame:
    ends = graph.spread(graph.undirected(d.active_edges).select(F.col("u").alias("node"), "v"), d.edge_parts, "node")
    return ends.groupBy("node").agg(F.count("*").alias("n"), F.min("v").alias("first"))


_STEPS = "kg_steps AS MATERIALIZED (SELECT src AS u, dst AS v FROM kg_active UNION SELECT dst, src FROM kg_active)"


@query("g02_reach", f"""WITH RECURSIVE {_STEPS}, w(seed, node, hops) AS (SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT seed, v, hops + 1 FROM w JOIN kg_steps ON u = node WHERE hops < 3)
    SELECT seed, node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1, 2""")
def _(d: Data) -> DataFrame:
    """Shortest distances within three hops of every 20th supplier, over all active edges."""
    seeds = d.table("supplier").where("s_suppkey % 20 = 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("seed"))
    return graph.reach(seeds, d.active_edges, 3, d.edge_parts)


@query("g03_ego_paths", f"""WITH RECURSIVE {_STEPS}, w(seed, path, length) AS (SELECT id, [id], 0 FROM kg_nodes WHERE type IN ('Section', 'Topic') UNION ALL SELECT seed, list_append(path, v), length + 1 FROM w JOIN kg_steps ON u = path[-1] WHERE length < 3 AND NOT list_contains(path, v))
    SELECT seed, array_to_string(path, '>') AS path, CAST(length AS INTEGER) AS length FROM w WHERE length > 0 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY length, array_to_string(path, '>')) <= 24""")
def _(d: Data) -> DataFrame:
    """The first 24 simple paths of up to three hops from every section and topic, over all active edges."""
    seeds = d.nodes.where("type IN ('Section', 'Topic')").select(F.col("id").alias("seed"))
    return graph.ego_paths(seeds, d.active_edges, 3, 24, d.edge_parts)


@query("g04_trail_strength", """WITH c AS MATERIALIZED (SELECT edge_id, count(DISTINCT chunk_id) AS chunks FROM kg_evidence WHERE status = 'active' GROUP BY 1), a AS MATERIALIZED (SELECT id, src, rel_type, weight FROM kg_active),
    p AS MATERIALIZED (SELECT a.*, chunks FROM a JOIN c ON c.edge_id = a.id WHERE rel_type = 'PROVIDES'), b AS MATERIALIZED (SELECT * FROM a WHERE rel_type = 'BELONGS_TO')
    SELECT p.id AS first, b.id AS second, round(least(1.0, 0.72 + 0.06 * chunks - 0.1 + 0.08 * ((p.weight + b.weight) / 2 - 1.0)), 6) AS strength FROM p JOIN b ON b.src = p.src""")
def _(d: Data) -> DataFrame:
    """Two-hop trails part - supplier - nation."""
    c = d.evidence.where("status = 'active'").groupBy(F.col("edge_id").alias("first")).agg(F.countDistinct("chunk_id").alias("chunks"))
    p = d.active_edges.where("rel_type = 'PROVIDES'").select(F.col("id").alias("first"), "src", F.col("weight").alias("w1"))
    b = d.active_edges.where("rel_type = 'BELONGS_TO'").select(F.col("id").alias("second"), "src", F.col("weight").alias("w2"))
    zero, none = F.lit(0.0), F.lit(False)
    return p.join(b, "src").join(c, "first").select("first", "second", F.round(graph.trail_strength(F.col("chunks"), F.lit(2), (F.col("w1") + F.col("w2")) / 2, zero, none, zero), 6).alias("strength"))


@query("g13_documentary", "SELECT 'DEFINED_IN' AS rel, e.dst AS src, v.chunk_id AS dst, count(*) AS n FROM kg_active e JOIN kg_evidence v ON v.edge_id = e.id WHERE v.status = 'active' AND e.weight > 1.1 GROUP BY ALL")
def _(d: Data) -> DataFrame:
    """Links from entities to the chunks that evidence them."""
    e = d.active_edges.where("weight > 1.1").select(F.col("id").alias("edge_id"), "dst")
    j = e.join(d.evidence.where("status = 'active'"), "edge_id")
    return j.groupBy(F.lit("DEFINED_IN").alias("rel"), F.col("dst").alias("src"), F.col("chunk_id").alias("dst")).agg(F.count("*").alias("n"))


@query("g18_retype", "SELECT id, CASE WHEN type = 'Person' AND NOT contains(name, '@') AND len(regexp_extract_all(name, '\\b[A-Z][a-z]+')) < 2 THEN 'Concept' ELSE type END AS type FROM kg_nodes")
def _(d: Data) -> DataFrame:
    """Persons without an address or two capitalised words are concepts."""
    words = F.size(F.regexp_extract_all("name", F.lit(r"\b[A-Z][a-z]+"), F.lit(0)))
    return d.nodes.select("id", F.when((F.col("type") == "Person") & ~F.col("name").contains("@") & (words < 2), "Concept").otherwise(F.col("type")).alias("type"))


@query("g20_lenses", """SELECT 'asserted' AS lens, count(*) AS n FROM kg_active WHERE edge_class = 'asserted_fact' UNION ALL SELECT 'structure', count(*) FROM kg_active WHERE edge_class = 'asserted_fact' OR rel_type = 'BELONGS_TO' UNION ALL SELECT 'conflict', count(*) FROM kg_active WHERE rel_type = 'CONFLICTS_WITH'""")
def _(d: Data) -> DataFrame:
    """Edges of each map lens, counted in one pass."""
    asserted = F.col("edge_class") == "asserted_fact"
    one = d.active_edges.agg(F.count_if(asserted).alias("asserted"), F.count_if(asserted | (F.col("rel_type") == "BELONGS_TO")).alias("structure"), F.count_if(F.col("rel_type") == "CONFLICTS_WITH").alias("conflict"))
    return one.unpivot([], ["asserted", "structure", "conflict"], "lens", "n")


@query("g21_neighbourhood", f"WITH {_TWO}, m AS (SELECT id FROM kg_nodes WHERE contains(normalized_name, 'ring')) SELECT id FROM m UNION SELECT v FROM kg_two JOIN m ON u = id")
def _(d: Data) -> DataFrame:
    m = d.nodes.where(F.col("normalized_name").contains("ring")).select("id")
    return m.union(graph.undirected(d.active_edges).select("u", "v").join(m.withColumnRenamed("id", "u"), "u", "left_semi").select("v")).distinct()


@query("g22_learned_weights", "SELECT path_key, round(list_reduce(list_prepend(1.0::DOUBLE, list(CASE WHEN won THEN 0.045 ELSE -0.04 END::DOUBLE ORDER BY ts, event_id)), lambda w, x: least(2.8, greatest(0.12, w + x))), 6) AS weight FROM outcomes GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Edge weights learned from outcomes in order of time."""
    return ordered.learned_weight(d.outcomes, "path_key", ["ts", "event_id"], "won")


@query("g23_restore", "WITH e AS MATERIALIZED (SELECT id, weight, status FROM kg_edges), old AS MATERIALIZED (SELECT id, weight FROM e WHERE length(id) % 2 = 0), now AS MATERIALIZED (SELECT id, weight * 0.5 AS weight FROM e WHERE status = 'active') SELECT now.id, coalesce(old.weight, now.weight) AS weight FROM now LEFT JOIN old ON old.id = now.id")
def _(d: Data) -> DataFrame:
    version = d.edges.where(F.char_length("id") % 2 == 0).select("id", "weight")
    return graph.restored(d.active_edges.select("id", (F.col("weight") * 0.5).alias("weight")), version)


@query("s31_graph_export", "SELECT e.id, e.src, e.dst, count(v.id) > 0 AS has_evidence FROM kg_active e LEFT JOIN kg_evidence v ON v.edge_id = e.id AND v.status = 'active' GROUP BY 1, 2, 3")
def _(d: Data) -> DataFrame:
    has = d.evidence.where("status = 'active'").groupBy(F.col("edge_id").alias("id")).agg(F.lit(True).alias("has"))
    return d.active_edges.join(has, "id", "left").select("id", "src", "dst", F.coalesce("has", F.lit(False)).alias("has_evidence"))


@query("s24_upsert_document", "SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Latest row per key."""
    return d.documents.groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by("n_chars", "doc_id").alias("n_chars"))


@query("s25_path_counters", "SELECT path_key, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses FROM outcomes GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Win and loss counters."""
    return d.outcomes.groupBy("path_key").agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"))


@query("s27_draft_goldens", "SELECT lower(substr(content, 1, 400)) AS question, min(id) AS id FROM messages WHERE role = 'user' AND length(content) >= 12 GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Insert if absent: the first draft of each question stays."""
    return d.messages.where("role = 'user'").where(F.char_length("content") >= 12).groupBy(F.lower(F.substring("content", 1, 400)).alias("question")).agg(F.min("id").alias("id"))


@query("s28_purge", "SELECT count(*) FILTER (WHERE NOT starts_with(id, 'customer:')) AS after, count(*) AS before FROM kg_nodes")
def _(d: Data) -> DataFrame:
    return d.nodes.agg(F.count_if(~F.col("id").startswith("customer:")).alias("after"), F.count("*").alias("before"))


@query("s29_active_scan", "SELECT id, src, dst FROM kg_edges WHERE status = 'active' AND src IN ('supplier:1', 'supplier:2', 'customer:3')")
def _(d: Data) -> DataFrame:
    return d.edges.where("status = 'active'").where(F.col("src").isin("supplier:1", "supplier:2", "customer:3")).select("id", "src", "dst")


@query("k01_rate_limit", """WITH h AS (SELECT event_id, user_id AS key, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS t FROM events), l AS (SELECT key, list({'t': t, 'recent': [t], 'out': [true], 'ids': [event_id]} ORDER BY t, event_id) AS hits FROM h GROUP BY 1),
    f AS (SELECT key, list_reduce(hits, lambda a, x: {'t': x.t, 'recent': CASE WHEN len(list_filter(a.recent, lambda r: x.t - r <= 7200)) < 2 THEN list_append(list_filter(a.recent, lambda r: x.t - r <= 7200), x.t) ELSE list_filter(a.recent, lambda r: x.t - r <= 7200) END, 'out': list_append(a.out, len(list_filter(a.recent, lambda r: x.t - r <= 7200)) < 2), 'ids': list_concat(a.ids, x.ids)}) AS s FROM l)
    SELECT key, unnest(s.ids) AS event_id, unnest(s.out) AS accepted FROM f""")
def _(d: Data) -> DataFrame:
    """Sliding-window rate limit: hits that are rejected don't count."""
    return limits.rate_limited(d.events.select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")), 2, 7200)


@query("k02_care_window", "SELECT CAST(time_bucket(INTERVAL 10 MINUTE, ts) AS VARCHAR) AS tick, count(*) AS n FROM events WHERE (hour(ts) - 22 + 24) % 24 < 5 GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Ticks of ten minutes inside the nightly window."""
    busy = d.events.where("(hour(ts) - 22 + 24) % 24 < 5")
    tick = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600) * 600)
    return busy.groupBy(F.date_format(tick, "yyyy-MM-dd HH:mm:ss").alias("tick")).agg(F.count("*").alias("n"))


@query("k06_last_snapshots", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 14")
def _(d: Data) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return d.events.select("user_id", "event_id", "ts", F.row_number().over(w).alias("r")).where("r <= 14").drop("r")


@query("a18_debt_drilldown", """SELECT e.id, s.name AS from_name, t.name AS to_name, e.weight FROM kg_active e JOIN kg_nodes s ON s.id = e.src JOIN kg_nodes t ON t.id = e.dst WHERE edge_class = 'asserted_fact' AND weight < 0.55 ORDER BY weight, e.id LIMIT 20""")
def _(d: Data) -> DataFrame:
    weak = d.active_edges.where("edge_class = 'asserted_fact' AND weight < 0.55").orderBy("weight", "id").limit(20)
    return joins.with_endpoint_names(weak, d.nodes).select("id", F.col("src_name").alias("from_name"), F.col("dst_name").alias("to_name"), "weight")


@query("mean_weight_by_type", "SELECT n.type, count(*) AS edges, round(avg(e.weight), 4) AS mean_weight FROM kg_active e JOIN kg_nodes n ON n.id = e.src GROUP BY 1")
def _(d: Data) -> DataFrame:
    n = d.nodes.select(F.col("id").alias("src"), "type")
    return d.active_edges.join(n, "src").groupBy("type").agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 4).alias("mean_weight"))
