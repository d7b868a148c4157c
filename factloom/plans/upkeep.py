"""Upkeep of the graph and its reports: status, trends, hints, pins, hierarchies, aliases and vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text, web
from factloom.operators import aggregates, cells, graph, topk
from factloom.plans.datasets import Data
from factloom.plans.registry import query
from factloom.plans.relational import _COVER, _DAILY, _cover, _daily
from factloom.plans.texts import _U, _urls
from factloom.sources import sinks

_ORIGINS = "o AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS origin, CASE page_id % 5 WHEN 0 THEN '*' WHEN 1 THEN '' WHEN 2 THEN regexp_extract(url, '^https?://[^/?#]*') || '/, https://other.example' WHEN 3 THEN ' https://a.example ,https://b.example/' ELSE 'https://b.example' END AS allowed FROM pages)"


@query("f19_origin", f"WITH {_ORIGINS} SELECT page_id, trim(allowed) IN ('', '*') OR list_contains(list_transform(string_split(allowed, ','), lambda x: rtrim(trim(x), '/')), rtrim(origin, '/')) AS ok, trim(allowed) IN ('', '*') AS ok_without FROM o")
def _(d: Data) -> DataFrame:
    """Whether an origin is allowed: a star or nothing allows all; trailing slashes don't count; ok_without: a caller that must name an origin and doesn't."""
    origin, k = F.regexp_extract("url", "^https?://[^/?#]*", 0), F.col("page_id") % 5
    allowed = F.when(k == 0, "*").when(k == 1, "").when(k == 2, F.concat(origin, F.lit("/, https://other.example"))).when(k == 3, " https://a.example ,https://b.example/").otherwise("https://b.example")
    open_ = F.trim(allowed).isin("", "*")
    bare = lambda x: F.regexp_replace(F.trim(x), "/+$", "")
    return d.pages.select("page_id", (open_ | F.array_contains(F.transform(F.split(allowed, ","), bare), bare(origin))).alias("ok"), open_.alias("ok_without"))


_SLUG = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '')"


@query("j19_source_documents", f"""WITH t AS (SELECT page_id AS doc, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1) || '_' || replace(trim({_SLUG}, '/'), '/', '_'), '[^a-zA-Z0-9._-]+', '_', 'g')) || '.md' AS title FROM pages),
    u AS (SELECT page_id AS source, lower(list_last(list_filter(string_split({_SLUG}, '/'), lambda x: length(x) >= 3))) AS last FROM pages WHERE page_id % 20 = 0)
    SELECT source, min(doc) AS doc, count(*) AS candidates FROM u JOIN t ON contains(replace(replace(title, '-', ' '), '_', ' '), replace(replace(last, '-', ' '), '_', ' ')) GROUP BY 1""")
def _(d: Data) -> DataFrame:
    """The first document whose title holds the last path segment of a source: looked up by the segment's words, then checked."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^https?://[^/]*", "")
    spaced = lambda c: F.translate(c, "-_", "  ")
    slug = F.concat_ws("_", F.regexp_extract("url", r"^https?://([^/?#]*)", 1), F.replace(F.regexp_replace(path, "^/+|/+$", ""), F.lit("/"), F.lit("_")))
    titles = d.pages.select(F.col("page_id").alias("doc"), spaced(F.concat(F.lower(F.regexp_replace(slug, "[^a-zA-Z0-9._-]+", "_")), F.lit(".md"))).alias("title"))
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda x: F.char_length(x) >= 3), F.lit(-1))
    asks = d.pages.where("page_id % 20 = 0").select(F.col("page_id").alias("source"), spaced(F.lower(last)).alias("last")).where("last IS NOT NULL")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - 2), lambda i: F.substring(c, i, 3)))
    held = titles.select("doc", "title", F.explode(grams(F.col("title"))).alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    rare = asks.select("source", "last", F.explode(grams(F.col("last"))).alias("g")).join(often, "g", "left").groupBy("source", "last").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))["g"].alias("g"))
    return rare.join(held, "g").where(F.col("title").contains(F.col("last"))).groupBy("source").agg(F.min("doc").alias("doc"), F.count("*").alias("candidates"))


@query("j20_filtered_neighbours", """WITH k AS (SELECT doc_id AS vec_id FROM documents WHERE n_chars >= 400), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN (SELECT * FROM embeddings SEMI JOIN k USING (vec_id)) v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
    SELECT query_id, vec_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 6""")
def _(d: Data) -> DataFrame:
    """Nearest vectors among those whose document isn't thin: the index is filtered before its cells are opened."""
    v = d.table("embeddings")
    some = d.documents.where("n_chars >= 400").select(F.col("doc_id").alias("vec_id"))
    return cells.search(cells.kept(cells.build(v), some), v.where("vec_id % 20 = 0"), 6)


@query("s30_vectors", """SELECT 'ws' || (doc_id % 3) || ':' || doc_id AS key, doc_id AS chunk_id, source, CAST(len(embedding) AS INTEGER) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM documents JOIN embeddings ON vec_id = doc_id WHERE trim(text) <> ''""")
def _(d: Data) -> DataFrame:
    """Chunks with their vectors, keyed by workspace and chunk; blank chunks have none."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = d.documents.where(F.trim("text") != "").join(d.table("embeddings"), F.col("vec_id") == F.col("doc_id"))
    return rows.select(F.concat(F.lit("ws"), (F.col("doc_id") % 3).cast("string"), F.lit(":"), F.col("doc_id").cast("string")).alias("key"), F.col("doc_id").alias("chunk_id"), "source", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"))


@query("s30_vector_upsert", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT source || ':' || doc_id AS key, doc_id AS chunk_id, text, n_chars, e FROM documents JOIN v ON vec_id = doc_id), n AS (SELECT key, chunk_id, list_transform(e, lambda x: x / greatest(1e-12, sqrt(list_sum(list_transform(e, lambda y: y * y))))) AS e FROM c WHERE trim(text) <> '' AND n_chars >= 400)
    SELECT key, chunk_id, batch, CAST(len(e) AS INTEGER) AS dims, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS norm FROM (SELECT key, chunk_id, 2 AS batch, e FROM n UNION ALL SELECT key, chunk_id, 1, e FROM c WHERE n_chars % 2 = 0 AND key NOT IN (SELECT key FROM n))""")
def _(d: Data) -> DataFrame:
    """A store of vectors by source and chunk after a second batch, of unit vectors of the longer texts: its keys are replaced, others stay, blank texts bring none."""
    length = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    v = d.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("e"))
    c = d.documents.withColumnRenamed("doc_id", "chunk_id").join(v, "chunk_id").select(F.concat_ws(":", "source", F.col("chunk_id").cast("string")).alias("key"), "chunk_id", "text", "n_chars", "e")
    old = c.where("n_chars % 2 = 0").select("key", "chunk_id", F.lit(1).alias("batch"), "e")
    unit = c.where((F.trim("text") != "") & (F.col("n_chars") >= 400)).withColumn("l", F.greatest(F.lit(1e-12), length(F.col("e"))))
    new = unit.select("key", "chunk_id", F.lit(2).alias("batch"), F.transform("e", lambda x: x / F.col("l")).alias("e"))
    return sinks.upserted(old, new, ["key"], "batch").select("key", "chunk_id", "batch", F.size("e").alias("dims"), F.round(length(F.col("e")), 4).alias("norm"))


@query("s35_latest", """WITH a AS (SELECT 'asks' AS list, id AS ref, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY id DESC) AS r, 80 AS most, conv_id % 10 AS ws FROM messages WHERE role = 'user' UNION ALL SELECT 'runs', event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC), 30, user_id % 10 FROM events WHERE event_type = 'signup'
    UNION ALL SELECT 'versions', doc_id, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id DESC), 20, doc_id % 10 FROM documents) SELECT list, ws, ref FROM a WHERE r <= most""")
def _(d: Data) -> DataFrame:
    """The latest entries of each workspace's lists: 80 asks, 30 runs, 20 versions."""
    latest = lambda rows, name, ws, keys, k: topk.top_per_group(rows.withColumn("ws", ws % 10), ["ws"], [F.desc(c) for c in keys], k).select(F.lit(name).alias("list"), "ws", F.col(keys[-1]).alias("ref"))
    asks = latest(d.messages.where("role = 'user'"), "asks", F.col("conv_id"), ["id"], 80)
    runs = latest(d.events.where("event_type = 'signup'"), "runs", F.col("user_id"), ["ts", "event_id"], 30)
    return asks.unionByName(runs).unionByName(latest(d.documents, "versions", F.col("doc_id"), ["doc_id"], 20))


@query("a06_trust_status", """WITH e AS (SELECT src, count(*) AS edges, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM kg_evidence v WHERE v.edge_id = e.id AND v.status = 'active' AND v.confidence >= 0.95)) AS evidenced, count(*) FILTER (WHERE weight < 0.5) AS unsupported FROM kg_active e WHERE edge_class = 'asserted_fact' GROUP BY 1),
    m AS (SELECT conv_id % 100 AS k, count(*) AS asks, 100.0 * count(*) FILTER (WHERE decision = 'answer') / count(*) AS grounded FROM messages WHERE role = 'assistant' GROUP BY 1),
    j AS (SELECT s_suppkey AS agent, coalesce(edges, 0) AS nodes, 100.0 * coalesce(evidenced, 0) / greatest(1, coalesce(edges, 0)) AS evidence, coalesce(unsupported, 0) AS unsupported, coalesce(asks, 0) AS asks, coalesce(grounded, 0.0) AS grounded FROM supplier LEFT JOIN e ON e.src = 'supplier:' || s_suppkey LEFT JOIN m ON m.k = s_suppkey)
    SELECT agent, CASE WHEN nodes = 0 THEN 'building' WHEN unsupported > 8 OR (asks >= 3 AND grounded < 70) THEN 'review' WHEN asks = 0 AND evidence >= 50 THEN 'trusted' WHEN grounded >= 70 OR evidence >= 75 THEN 'trusted' ELSE 'review' END AS status FROM j""")
def _(d: Data) -> DataFrame:
    """Trust status of every supplier's graph: building, review or trusted."""
    sure = d.evidence.where("status = 'active' AND confidence >= 0.95").select(F.col("edge_id").alias("id")).distinct().withColumn("sure", F.lit(True))
    e = d.active_edges.where("edge_class = 'asserted_fact'").join(sure, "id", "left").groupBy("src").agg(F.count("*").alias("edges"), F.count_if("sure").alias("evidenced"), F.count_if(F.col("weight") < 0.5).alias("unsupported"))
    m = d.messages.where("role = 'assistant'").groupBy((F.col("conv_id") % 100).alias("k")).agg(F.count("*").alias("asks"), (100.0 * F.count_if(F.col("decision") == "answer") / F.count("*")).alias("grounded"))
    s = d.table("supplier").select(F.col("s_suppkey").alias("agent"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"))
    j = s.join(e, "src", "left").join(m, F.col("k") == F.col("agent"), "left").fillna(0, ["edges", "evidenced", "unsupported", "asks", "grounded"])
    evidence = 100.0 * F.col("evidenced") / F.greatest(F.lit(1), F.col("edges"))
    return j.select("agent", aggregates.trust_status(F.col("edges"), F.col("unsupported") > 8, F.col("asks"), F.col("grounded"), evidence).alias("status"))


@query("a31_domain_confidence", """WITH g AS (SELECT p_brand AS domain, count(*) AS pages, round(100.0 * count(*) FILTER (WHERE p_size >= 10) / count(*), 1) AS confidence, string_agg(DISTINCT lower(p_type), ' ') AS types FROM part GROUP BY 1)
    SELECT domain, pages, confidence, CASE WHEN regexp_matches(lower(domain), 'complian|regulat|policy|legal|security|privacy|mortgage|hipaa') THEN 'Critical' WHEN regexp_matches(lower(domain), 'product|api|architect|service|auth|payment') THEN 'Important' ELSE 'Informational' END AS criticality FROM g
    UNION ALL SELECT 'Security and privacy', (SELECT count(*) FROM kg_nodes), CAST((SELECT count(*) FROM kg_edges) AS DOUBLE), 'Critical'""")
def _(d: Data) -> DataFrame:
    """Coverage of each domain as confidence, with its criticality; the last row is the scale of the graph."""
    g = d.table("part").groupBy(F.col("p_brand").alias("domain")).agg(F.count("*").alias("pages"), F.round(100.0 * F.count_if(F.col("p_size") >= 10) / F.count("*"), 1).alias("confidence"))
    scale = d.nodes.agg(F.count("*").alias("pages")).crossJoin(d.edges.agg(F.count("*").cast("double").alias("confidence"))).select(F.lit("Security and privacy").alias("domain"), "pages", "confidence")  # one row each
    return g.unionByName(scale).withColumn("criticality", text.criticality(F.col("domain")))


@query("a31_section_confidence", f"""WITH c AS ({_COVER}) SELECT section, pages, coverage_pct AS confidence, CASE WHEN regexp_matches(lower(section), 'complian|regulat|policy|legal|security|privacy|mortgage|hipaa') THEN 'Critical' WHEN regexp_matches(lower(section), 'product|api|architect|service|auth|payment') THEN 'Important' ELSE 'Informational' END AS criticality FROM c""")
def _(d: Data) -> DataFrame:
    """The coverage report of sections, told as confidence with its criticality."""
    return _cover(d).select("section", "pages", F.col("coverage_pct").alias("confidence"), text.criticality(F.col("section")).alias("criticality"))


@query("a31_scale_card", "SELECT 'nodes' AS what, count(*) AS n FROM kg_nodes UNION ALL SELECT 'edges', count(*) FROM kg_edges UNION ALL SELECT 'evidence', count(*) FROM kg_evidence UNION ALL SELECT 'documents', count(*) FROM documents")
def _(d: Data) -> DataFrame:
    """The size of the graph and of its corpus."""
    one = lambda what, rows: rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one("nodes", d.nodes).unionByName(one("edges", d.edges)).unionByName(one("evidence", d.evidence)).unionByName(one("documents", d.documents))


@query("a34_map_histogram", """WITH l AS (SELECT id, src, dst, unnest(CASE WHEN edge_class = 'asserted_fact' THEN ['asserted', 'structure'] WHEN rel_type = 'BELONGS_TO' THEN ['structure'] ELSE [] END) AS lens FROM kg_active), n AS (SELECT lens, src AS id FROM l UNION ALL SELECT lens, dst FROM l), g AS (SELECT lens, id, count(*) AS degree FROM n GROUP BY ALL)
    SELECT lens, type, count(*) AS nodes, max(degree) AS max_degree, CAST(sum(degree) AS BIGINT) AS ends FROM g JOIN kg_nodes USING (id) GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    """Node types and degrees of each map lens."""
    asserted, structure = F.col("edge_class") == "asserted_fact", F.col("rel_type") == "BELONGS_TO"
    lens = F.when(asserted, F.array(F.lit("asserted"), F.lit("structure"))).when(structure, F.array(F.lit("structure"))).otherwise(F.array().cast("array<string>"))
    ends = d.active_edges.select(F.explode(lens).alias("lens"), F.array("src", "dst").alias("both")).select("lens", F.explode("both").alias("id"))
    degree = ends.groupBy("lens", "id").agg(F.count("*").alias("degree"))
    return degree.join(d.nodes.select("id", "type"), "id").groupBy("lens", "type").agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"), F.sum("degree").alias("ends"))


_POINTS = f"d AS ({_DAILY}), p AS (SELECT ws, arg_min(debt, day) AS debt0, arg_max(debt, day) AS debt, arg_min(100 - debt, day) AS cov0, arg_max(100 - debt, day) AS cov, CAST(floor(arg_min(debt, day)) AS BIGINT) % 7 AS con0, CAST(floor(arg_max(debt, day)) AS BIGINT) % 7 AS con FROM d GROUP BY 1)"


@query("w13_weekly_summary", f"""WITH {_POINTS}, l AS (SELECT ws, list_filter([CASE WHEN round(cov - cov0, 1) <> 0 THEN 'Coverage: ' || CASE WHEN cov > cov0 THEN '+' ELSE '' END || CAST(round(cov - cov0, 1) AS DOUBLE) || '%' END, CASE WHEN round(debt - debt0, 1) <> 0 THEN 'Debt: ' || CASE WHEN debt > debt0 THEN '+' ELSE '' END || CAST(round(debt - debt0, 1) AS DOUBLE) || '%' END,
    CASE WHEN con < con0 THEN (con0 - con) || ' contradictions resolved' WHEN con > con0 THEN '+' || (con - con0) || ' contradictions' END], lambda x: x IS NOT NULL) AS lines, debt FROM p)
    SELECT ws, array_to_string(lines, ' · ') || ' · Risk: ' || CASE WHEN debt >= 50 THEN 'High' ELSE 'Low' END AS summary FROM l WHERE len(lines) > 0""")
def _(d: Data) -> DataFrame:
    """What changed since the oldest snapshot, in a line; workspaces without a change have none."""
    oldest, latest = F.min_by("debt", "day"), F.max_by("debt", "day")
    p = _daily(d).groupBy("ws").agg(oldest.alias("debt0"), latest.alias("debt"))
    change = lambda name, now, was: F.when(F.round(now - was, 1) != 0, F.concat(F.lit(f"{name}: "), F.when(now > was, "+").otherwise(""), F.round(now - was, 1).cast("double").cast("string"), F.lit("%")))
    con0, con = F.floor("debt0") % 7, F.floor("debt") % 7
    contra = F.when(con < con0, F.concat((con0 - con).cast("string"), F.lit(" contradictions resolved"))).when(con > con0, F.concat(F.lit("+"), (con - con0).cast("string"), F.lit(" contradictions")))
    lines = F.array_compact(F.array(change("Coverage", 100 - F.col("debt"), 100 - F.col("debt0")), change("Debt", F.col("debt"), F.col("debt0")), contra))
    out = p.select("ws", lines.alias("lines"), F.when(F.col("debt") >= 50, "High").otherwise("Low").alias("risk")).where(F.size("lines") > 0)
    return out.select("ws", F.concat(F.array_join("lines", " · "), F.lit(" · Risk: "), F.col("risk")).alias("summary"))


@query("t12_recommended", """WITH a AS (SELECT p_brand AS ws, 'Fix ' || p_type AS title, sum(p_size) AS pts FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY pts DESC, title) AS i, sum(pts) OVER (PARTITION BY ws) AS total FROM a),
    p AS (SELECT ws, title, CAST(i AS INTEGER) AS i, CAST(-pts AS DOUBLE) AS delta, NULL::DOUBLE AS gain FROM r WHERE i <= 4), c AS (SELECT p_brand AS ws, 'Link ' || p_name AS title, round(min(p_retailprice), 1)::DOUBLE AS gain FROM part GROUP BY ALL), k AS (SELECT ws, title, CAST(4 + row_number() OVER (PARTITION BY ws ORDER BY gain DESC, title) AS INTEGER) AS i, NULL::DOUBLE AS delta, gain FROM c),
    u AS (SELECT * FROM p UNION ALL SELECT * FROM k WHERE i <= 6) SELECT ws, title, delta, gain, CAST(row_number() OVER (PARTITION BY ws ORDER BY i) AS INTEGER) AS place FROM u QUALIFY row_number() OVER (PARTITION BY ws ORDER BY i) <= 5""")
def _(d: Data) -> DataFrame:
    """Per workspace the playbook's actions, then two links that would cover most: five in all, titles distinct."""
    part, ws = d.table("part"), Window.partitionBy("ws")
    acts = part.groupBy(F.col("p_brand").alias("ws"), F.concat(F.lit("Fix "), "p_type").alias("title")).agg(F.sum("p_size").alias("pts"))
    acts = acts.withColumn("i", F.row_number().over(ws.orderBy(F.desc("pts"), "title"))).where("i <= 4").select("ws", "title", "i", (-F.col("pts")).cast("double").alias("delta"), F.lit(None).cast("double").alias("gain"))
    links = part.groupBy(F.col("p_brand").alias("ws"), F.concat(F.lit("Link "), "p_name").alias("title")).agg(F.round(F.min("p_retailprice"), 1).cast("double").alias("gain"))
    links = links.withColumn("i", 4 + F.row_number().over(ws.orderBy(F.desc("gain"), "title"))).where("i <= 6").select("ws", "title", "i", F.lit(None).cast("double").alias("delta"), "gain")
    both = acts.unionByName(links).groupBy("ws", "title").agg(F.min("i").alias("i"), F.first("delta", True).alias("delta"), F.first("gain", True).alias("gain"))
    return both.withColumn("place", F.row_number().over(ws.orderBy("i"))).where("place <= 5").select("ws", "title", "delta", "gain", "place")


@query("t13_missing_hints", """WITH q AS (SELECT id, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]{4,}')) AS w FROM messages WHERE role = 'user'), t AS (SELECT id, unnest(w) AS w FROM q), b AS (SELECT DISTINCT p_partkey AS doc, unnest(string_split(lower(p_name), ' ')) AS w FROM part UNION SELECT 1000000 + item_id, unnest(regexp_extract_all(lower(substr(text, 1, 60)), '[a-z0-9]{4,}')) FROM benchmark),
    h AS (SELECT DISTINCT id, doc FROM t JOIN b USING (w)), k AS (SELECT id, CAST(doc AS VARCHAR) AS hint FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc) <= 4)
    SELECT id, hint FROM k UNION ALL SELECT id, w FROM t WHERE id NOT IN (SELECT id FROM k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(w) DESC, w) = 1""")
def _(d: Data) -> DataFrame:
    """Up to four documents, in order, whose title shares a word with a question; else its longest word (of equals the first)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]{4,}"), F.lit(0)))
    t = d.messages.where("role = 'user'").select("id", F.explode(words).alias("w"))
    parts = d.table("part").select(F.col("p_partkey").alias("doc"), F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    items = d.table("benchmark").select((1000000 + F.col("item_id")).alias("doc"), F.explode(F.regexp_extract_all(F.lower(F.substring("text", 1, 60)), F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("w"))
    hits = topk.top_per_group(t.join(parts.unionByName(items).distinct(), "w").select("id", "doc").distinct(), ["id"], ["doc"], 4).select("id", F.col("doc").cast("string").alias("hint"))
    longest = t.join(hits, "id", "left_anti").groupBy("id").agg(F.min(F.struct((-F.char_length("w")).alias("n"), "w"))["w"].alias("hint"))
    return hits.unionByName(longest)


@query("d06_distinct_paths", """WITH two AS (SELECT id, src AS u, dst AS v FROM kg_active WHERE rel_type <> 'PROVIDES' UNION ALL SELECT id, dst, src FROM kg_active WHERE rel_type <> 'PROVIDES'), w AS (SELECT a.u || '>' || a.id || '>' || a.v || '|' || b.u || '>' || b.id || '>' || b.v AS key, a.u AS seed FROM two a JOIN two b ON b.u = a.v AND b.id <> a.id WHERE a.u LIKE 'region:%'),
    twice AS (SELECT * FROM w UNION ALL SELECT * FROM w) SELECT DISTINCT key, seed FROM twice""")
def _(d: Data) -> DataFrame:
    """Walks of two hops from sections, found twice over, each kept once by the key of its oriented hops."""
    two = graph.undirected(d.active_edges.where("rel_type <> 'PROVIDES'")).select("id", "u", "v")
    a, b = two.where("u LIKE 'region:%'").select(F.col("id").alias("i"), F.col("u").alias("seed"), F.col("v").alias("m")), two.select(F.col("id").alias("j"), F.col("u").alias("m"), F.col("v").alias("end"))
    hop = lambda x, i, y: F.concat_ws(">", x, i, y)
    walks = a.join(b, "m").where("i <> j").select(F.concat_ws("|", hop("seed", "i", "m"), hop("m", "j", "end")).alias("key"), "seed")
    return walks.unionByName(walks).dropDuplicates(["key"])


@query("g05_trail_adjust", r"""WITH a AS MATERIALIZED (SELECT id, src, dst, rel_type, weight FROM kg_active), t AS (SELECT x.id AS first, y.id AS second, 0.7 + 0.08 * ((x.weight + y.weight) / 2 - 1.0) AS strength, [s.name, m.name, e.name] AS names, lower(x.rel_type || ' ' || y.rel_type) AS rels FROM a x JOIN a y ON y.src = x.dst JOIN kg_nodes s ON s.id = x.src JOIN kg_nodes m ON m.id = x.dst JOIN kg_nodes e ON e.id = y.dst WHERE x.rel_type = 'BELONGS_TO'),
    r AS (SELECT *, (CAST(contains(array_to_string(names, ' '), 'EUROPE') AS INTEGER) + CAST(contains(array_to_string(names, ' '), 'FRANCE') AS INTEGER)) / 2.0 AS rel, len(list_intersect(list_distinct(names), ['EUROPE', 'FRANCE'])) AS seeds FROM t)
    SELECT first, second, round(strength + CASE WHEN contains(rels, 'part_of') THEN 0.2 ELSE 0.0 END + 0.28 * rel - CASE WHEN rel < 0.2 THEN 0.35 ELSE 0.0 END + CASE WHEN seeds >= 2 THEN 0.12 * (seeds - 1) ELSE 0.0 END, 4)::DOUBLE AS strength FROM r""")
def _(d: Data) -> DataFrame:
    """Trails adjusted to the question what is part of FRANCE or EUROPE: by relation, by the share of its terms, and by its entities."""
    n = d.nodes.select("id", "name")
    name = lambda key, to: n.withColumnsRenamed({"id": key, "name": to})
    x = d.active_edges.where("rel_type = 'BELONGS_TO'").select(F.col("id").alias("first"), "src", F.col("dst").alias("mid"), F.col("rel_type").alias("r1"), F.col("weight").alias("w1"))
    y = d.active_edges.select(F.col("id").alias("second"), F.col("src").alias("mid"), "dst", F.col("rel_type").alias("r2"), F.col("weight").alias("w2"))
    t = x.join(y, "mid").join(name("src", "a"), "src").join(name("mid", "b"), "mid").join(name("dst", "c"), "dst")
    asks, names = F.lit("what is part of france or europe"), F.array("a", "b", "c")
    strength = 0.7 + 0.08 * ((F.col("w1") + F.col("w2")) / 2 - 1.0)
    adjusted = graph.adjusted_strength(strength, asks, F.lower(F.concat_ws(" ", "r1", "r2")), names, F.array(F.lit("EUROPE"), F.lit("FRANCE")))
    return t.select("first", "second", F.round(adjusted, 4).alias("strength"))


@query("g14_asserted_gate", r"""WITH r AS (SELECT l_orderkey AS chunk, l_linenumber AS line, CASE l_linenumber % 5 WHEN 0 THEN 'mentions' WHEN 1 THEN 'provides' WHEN 2 THEN 'ships to' WHEN 3 THEN 'unknown' ELSE 'uses' END AS rel, CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE 'Supplier ' || l_suppkey END AS src, CASE WHEN l_partkey % 13 = 0 THEN 'supplier-' || l_suppkey ELSE 'Part ' || l_partkey END AS dst, 'Note: Supplier ' || l_suppkey || ' provides Part ' || (l_partkey - l_partkey % 2) || ' by ' || l_returnflag AS t, round(1 - l_discount, 2) AS confidence FROM lineitem),
    n AS (SELECT *, upper(regexp_replace(rel, '[^A-Za-z0-9]+', '_', 'g')) AS kind, CASE WHEN contains(lower(t), lower(src)) THEN instr(lower(t), lower(src)) WHEN contains(lower(t), lower(dst)) THEN instr(lower(t), lower(dst)) END - 1 AS pos, CASE WHEN contains(lower(t), lower(src)) THEN length(src) ELSE length(dst) END AS size FROM r)
    SELECT chunk, line, kind, greatest(0, pos - 40) AS span_start, least(length(t), pos + greatest(size, 8) + 80) AS span_end, confidence AS weight FROM n WHERE kind IN ('PROVIDES', 'SHIPS_TO', 'USES') AND src <> '' AND dst <> '' AND lower(src) <> lower(dst) AND regexp_replace(lower(src), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(dst), '[^a-z0-9]', '', 'g') AND pos IS NOT NULL""")
def _(d: Data) -> DataFrame:
    """Extracted relations that become facts: an allowed relation between two names that differ, with a span of the text that bears it."""
    mode, s, p = F.col("l_linenumber") % 5, F.col("l_suppkey").cast("string"), F.col("l_partkey")
    raw = d.table("lineitem").select(
        F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("line"), F.when(mode == 0, "mentions").when(mode == 1, "provides").when(mode == 2, "ships to").when(mode == 3, "unknown").otherwise("uses").alias("rel"),
        F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(F.concat(F.lit("Supplier "), s)).alias("src"), F.when(p % 13 == 0, F.concat(F.lit("supplier-"), s)).otherwise(F.concat(F.lit("Part "), p.cast("string"))).alias("dst"),
        F.concat(F.lit("Note: Supplier "), s, F.lit(" provides Part "), (p - p % 2).cast("string"), F.lit(" by "), "l_returnflag").alias("text"), F.round(1 - F.col("l_discount"), 2).alias("weight"),
    )
    return graph.asserted(raw, ("PROVIDES", "SHIPS_TO", "USES")).select("chunk", "line", "kind", "span_start", "span_end", "weight")


@query("g15_web_hierarchy", f"""WITH {_U}, h AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS host, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END AS p FROM x), one AS (SELECT host, p, min(page_id) AS page FROM h GROUP BY ALL),
    up AS (SELECT a.page, arg_max(b.page, length(b.p)) AS parent FROM one a JOIN one b ON a.host = b.host AND a.p <> b.p AND (b.p = '/' OR starts_with(a.p, b.p || '/')) GROUP BY 1),
    s AS (SELECT page, host, coalesce(nullif(regexp_extract(p, '^/+([^/]+)', 1), ''), 'site') AS sec FROM one), hd AS (SELECT page_id AS page, trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)) AS h1 FROM pages), t AS (SELECT s.*, CASE WHEN length(coalesce(h1, '')) BETWEEN 3 AND 80 THEN h1 ELSE sec END AS topic FROM s LEFT JOIN hd USING (page))
    SELECT 'page:' || page AS src, 'page:' || parent AS dst, 'parent' AS layer FROM up UNION SELECT 'page:' || page, 'topic:' || lower(topic), 'topic' FROM t UNION SELECT 'topic:' || lower(topic), 'section:' || sec, 'section' FROM t""")
def _(d: Data) -> DataFrame:
    """PART_OF links of pages: to the nearest page above, to the topic of their heading (else their section), and from topics to sections."""
    p = F.regexp_replace(web.url_path(F.col("url")), "(?<=.)/+$", "")
    one = _urls(d).select(F.regexp_extract("url", "^https?://[^/?#]*", 0).alias("host"), p.alias("p"), "page_id").groupBy("host", "p").agg(F.min("page_id").alias("page"))
    up = one.select("host", "page", F.posexplode(web.ancestors(F.col("p"))).alias("distance", "above"))
    parent = up.join(one.select("host", F.col("p").alias("above"), F.col("page").alias("parent")), ["host", "above"]).groupBy("page").agg(F.min_by("parent", "distance").alias("parent"))
    heading = d.pages.select(F.col("page_id").alias("page"), F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>([^<]*)</h1>", 1)).alias("h1"))
    section = F.regexp_extract("p", "^/+([^/]+)", 1)
    t = one.select("page", F.when(section == "", "site").otherwise(section).alias("sec")).join(heading, "page", "left")
    t = t.select("page", "sec", F.lower(F.when(F.char_length(F.coalesce("h1", F.lit(""))).between(3, 80), F.col("h1")).otherwise(F.col("sec"))).alias("topic"))
    link = lambda rows, a, x, b, y, layer: rows.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(layer).alias("layer"))
    return link(parent, "page:", "page", "page:", "parent", "parent").union(link(t, "page:", "page", "topic:", "topic", "topic")).union(link(t, "topic:", "topic", "section:", "sec", "section")).distinct()


@query("g24_enriched", """WITH f AS (SELECT DISTINCT p_brand AS entity, CAST(floor(p_retailprice / 5) * 5 AS BIGINT) AS amount FROM part), c AS (SELECT 'CONFLICTS_WITH' AS what, x.entity || ':' || x.amount AS a, y.entity || ':' || y.amount AS b FROM f x JOIN f y ON x.entity = y.entity AND x.amount < y.amount),
    m AS (SELECT e.dst AS id, count(*) AS n, min(v.chunk_id) AS chunk FROM kg_active e JOIN kg_evidence v ON v.edge_id = e.id WHERE v.status = 'active' GROUP BY 1 ORDER BY n DESC, id LIMIT 40)
    SELECT * FROM c UNION ALL SELECT 'summary', id, substr('order ' || o_orderkey || ' ' || o_orderpriority, 1, 420) FROM m JOIN orders ON o_orderkey = chunk""")
def _(d: Data) -> DataFrame:
    """Conflict edges between an entity's amounts, and summaries of the 40 entities with most evidence from their first chunk."""
    f = d.table("part").select(F.col("p_brand").alias("entity"), (F.floor(F.col("p_retailprice") / 5) * 5).cast("long").alias("amount")).distinct()
    key = lambda amount: F.concat_ws(":", "entity", F.col(amount).cast("string"))
    c = f.withColumnRenamed("amount", "low").join(f.withColumnRenamed("amount", "high"), "entity").where("low < high").select(F.lit("CONFLICTS_WITH").alias("what"), key("low").alias("a"), key("high").alias("b"))
    held = d.active_edges.select(F.col("id").alias("edge_id"), "dst").join(d.evidence.where("status = 'active'"), "edge_id").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk")).orderBy(F.desc("n"), "id").limit(40)
    told = held.join(d.table("orders"), F.col("o_orderkey") == F.col("chunk")).select(F.lit("summary").alias("what"), F.col("id").alias("a"), F.substring(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority"), 1, 420).alias("b"))
    return c.unionByName(told)


@query("g25_domain_aliases", """WITH al AS (SELECT trim(regexp_replace(lower(k), '\\s+', ' ', 'g')) AS k, trim(regexp_replace(lower(v), '\\s+', ' ', 'g')) AS v FROM (VALUES ('  Small  Ring', 'Tiny Band'), ('FRANCE', 'french  republic'), ('', 'x'), ('europe', ' ')) t(k, v) WHERE trim(k) <> '' AND trim(v) <> '') SELECT id, coalesce(v, normalized_name) AS name FROM kg_nodes LEFT JOIN al ON k = normalized_name""")
def _(d: Data) -> DataFrame:
    """Names after a workspace's own aliases, which are applied to normalised names; blank aliases don't count."""
    pairs = (("  Small  Ring", "Tiny Band"), ("FRANCE", "french  republic"), ("", "x"), ("europe", " "))
    plain = lambda s: " ".join(s.lower().split())
    known = F.create_map(*(F.lit(plain(x)) for k, v in pairs if k.strip() and v.strip() for x in (k, v)))
    return d.nodes.select("id", F.coalesce(F.try_element_at(known, F.col("normalized_name")), F.col("normalized_name")).alias("name"))


def _embed(dims: int):
    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                v = np.random.default_rng(int(hashlib.sha256((t or "").encode()).hexdigest()[:16], 16)).standard_normal(dims).astype(np.float32)
                for word in set((t or "").lower().split()):
                    v[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims] += 1.0
                out.append(v / (float(np.linalg.norm(v)) or 1.0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.float32()))], ["id", "embedding"])

    return run


@query("r29_local_embedding")
def _(d: Data) -> DataFrame:
    """A deterministic vector of 384 components for every message: noise seeded by the text, one more for each of its words, unit length."""
    return d.messages.select("id", F.col("content").alias("text")).mapInArrow(_embed(384), "id long, embedding array<float>")


@query("r23_name_quotes", r"""WITH n AS (SELECT unnest(['Hopper', 'Alan Turing', 'Knuth', 'Quartz']) AS name), h AS (SELECT name, id, text, instr(' ' || lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')) || ' ', ' ' || lower(name) || ' ') - 1 AS pos FROM passages, n), f AS (SELECT * FROM h WHERE pos >= 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1)
    SELECT name, id, trim(substr(text, greatest(0, pos - 60) + 1, least(length(text), pos + 180) - greatest(0, pos - 60))) AS quote FROM f""")
def _(d: Data) -> DataFrame:
    """The first passage that names each asked person, with the words around the name."""
    names = F.array(*map(F.lit, ("Hopper", "Alan Turing", "Knuth", "Quartz")))
    found = d.passages.select("id", "text", F.explode(names).alias("name")).where("regexp_like(text, concat('(?i)\\\\b', name, '\\\\b'))")
    first = found.groupBy("name").agg(F.min_by(F.struct("id", "text"), "id").alias("p")).select("name", "p.id", "p.text")
    at = F.expr("regexp_instr(text, concat('(?i)\\\\b', name, '\\\\b'))") - 1
    start = F.greatest(F.lit(0), at - 60)
    return first.select("name", "id", F.trim(F.substring(F.col("text"), start + 1, F.least(F.char_length("text"), at + 180) - start)).alias("quote"))


@query("r26_conflict_penalty", """WITH c AS (SELECT p_brand, p_size, least(3, count(DISTINCT floor(p_retailprice / 100)) - 1) AS n FROM part GROUP BY ALL), e AS (SELECT l_partkey AS p_partkey, least(2, count(*) FILTER (l_returnflag = 'R')) AS k FROM lineitem GROUP BY 1), t AS (SELECT p_partkey, coalesce(n, 0) AS n, least(0.35::DOUBLE, 0.05::DOUBLE * coalesce(k, 0) + 0.12::DOUBLE * coalesce(n, 0)) AS penalty, 0.5::DOUBLE + (p_size % 50) / 100.0::DOUBLE AS overall FROM part LEFT JOIN c USING (p_brand, p_size) LEFT JOIN e USING (p_partkey))
    SELECT p_partkey, round(penalty, 3)::DOUBLE AS penalty, round(greatest(0.0, overall - penalty * 0.25), 3)::DOUBLE AS overall FROM t""")
def _(d: Data) -> DataFrame:
    """Trust after the conflicts of what is cited: prices that differ for one brand and size, three at most, and returned lines, two at most."""
    c = d.table("part").groupBy("p_brand", "p_size").agg(F.least(F.lit(3).cast("long"), F.countDistinct(F.floor(F.col("p_retailprice") / 100)) - 1).alias("n"))
    e = d.table("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.least(F.lit(2).cast("long"), F.count("*")).alias("k"))
    t = d.table("part").join(c, ["p_brand", "p_size"], "left").join(e, "p_partkey", "left")
    penalty = F.least(F.lit(0.35), F.lit(0.05) * F.coalesce("k", F.lit(0)) + F.lit(0.12) * F.coalesce("n", F.lit(0)))
    return t.select("p_partkey", F.round(penalty, 3).alias("penalty"), F.round(F.greatest(F.lit(0.0), 0.5 + (F.col("p_size") % 50) / 100.0 - penalty * 0.25), 3).alias("overall"))


@query("r21_retrieval_mode", """WITH m AS (SELECT id, coalesce(trust, 0.0) AS rel, (length(content) % 100) / 100.0 AS cov, length(content) % 4 AS tops, turn % 2 = 0 AS lead FROM messages WHERE role = 'assistant')
    SELECT id, CASE WHEN turn0 AND cov < 0.35 THEN 'document_overview' WHEN rel < 0.2 THEN 'hybrid_kb' WHEN rel < 0.35 THEN CASE WHEN tops > 0 THEN 'hybrid_graph_kb' ELSE 'hybrid_kb' END WHEN lead AND tops >= 1 AND rel >= 0.45 AND cov >= 0.45 THEN 'graph_primary' WHEN tops > 0 THEN 'hybrid_graph_kb' ELSE 'hybrid_kb' END AS mode FROM (SELECT *, id % 1000 = 1 AS turn0 FROM m)""")
def _(d: Data) -> DataFrame:
    """Which evidence leads: text, graph, both, or whole documents."""
    m = d.messages.where("role = 'assistant'")
    rel, n = F.coalesce("trust", F.lit(0.0)), F.char_length("content")
    cov, tops = (n % 100) / 100.0, n % 4
    both = F.when(tops > 0, "hybrid_graph_kb").otherwise("hybrid_kb")
    mode = F.when((F.col("id") % 1000 == 1) & (cov < 0.35), "document_overview").when(rel < 0.2, "hybrid_kb").when(rel < 0.35, both).when((F.col("turn") % 2 == 0) & (tops >= 1) & (rel >= 0.45) & (cov >= 0.45), "graph_primary").otherwise(both)
    return m.select("id", mode.alias("mode"))


@query("g06_named_path", """WITH RECURSIVE steps AS MATERIALIZED (SELECT src AS u, dst AS v FROM kg_active UNION SELECT dst, src FROM kg_active), ends AS (SELECT 'customer:' || min(c_custkey) AS a, 'part:' || max(p_partkey) AS b FROM customer, part WHERE c_custkey % 17 <> 0), w(node, hops) AS (SELECT a, 0 FROM ends UNION SELECT v, hops + 1 FROM w JOIN steps ON u = node WHERE hops < 6)
    SELECT a.name AS source, b.name AS target, CAST((SELECT min(hops) FROM w WHERE node = ends.b) AS INTEGER) AS hops FROM ends JOIN kg_nodes a ON a.id = ends.a JOIN kg_nodes b ON b.id = ends.b""")
def _(d: Data) -> DataFrame:
    """Hops of the shortest path, six at most, between two named nodes; null if there is none."""
    ends = d.table("customer").where("c_custkey % 17 <> 0").agg(F.concat(F.lit("customer:"), F.min("c_custkey").cast("string")).alias("seed")).crossJoin(d.table("part").agg(F.concat(F.lit("part:"), F.max("p_partkey").cast("string")).alias("node")))
    found = graph.reach(ends.select("seed"), d.active_edges, 6, d.edge_parts)
    named = lambda key, to: d.nodes.select(F.col("id").alias(key), F.col("name").alias(to))
    return ends.join(found, ["seed", "node"], "left").join(named("seed", "source"), "seed").join(named("node", "target"), "node").select("source", "target", "hops")
