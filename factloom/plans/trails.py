"""Shortest paths between pairs of the graph's nodes, and ranked trails of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import trails
from factloom.plans.datasets import Data
from factloom.plans.registry import query
from factloom.plans.weave import _TERMS

_ENDS = "pairs AS MATERIALIZED (SELECT DISTINCT 'customer:' || o_custkey AS a, 'part:' || l_partkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query("g02_shortest_paths", f"""WITH {_ENDS}, s AS MATERIALIZED (SELECT src AS u, dst AS v FROM kg_active UNION SELECT dst, src FROM kg_active), i AS MATERIALIZED (SELECT u, v FROM s WHERE v IN (SELECT u FROM s GROUP BY u HAVING count(*) > 1)), f AS MATERIALIZED (SELECT DISTINCT a FROM pairs),
    w1 AS MATERIALIZED (SELECT a, [a, v] AS p, v AS x FROM f JOIN i ON u = a), w2 AS MATERIALIZED (SELECT a, list_append(p, v) AS p, v AS x FROM w1 JOIN i ON u = x WHERE NOT list_contains(p, v)),
    ways AS (SELECT a, b, 1 AS hops, [a, b] AS path FROM pairs JOIN s ON u = a AND v = b UNION ALL SELECT a, b, 2, list_append(p, b) FROM pairs JOIN w1 USING (a) JOIN s ON u = x AND v = b UNION ALL SELECT a, b, 3, list_append(p, b) FROM pairs JOIN w2 USING (a) JOIN s ON u = x AND v = b WHERE NOT list_contains(p, b))
    SELECT a, b, CAST(hops AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM ways QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY hops, path) = 1""")
def _(d: Data) -> DataFrame:
    """How customers hang together with parts that they ordered, at most three hops: a path for each pair of all order lines."""
    lines = d.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    pairs = d.table("orders").join(lines, "o_orderkey").select(ref("customer", "o_custkey").alias("a"), ref("part", "l_partkey").alias("b"))
    return trails.shortest_paths(pairs, d.active_edges, 3, d.edge_parts).select("a", "b", "hops", F.array_join("path", ">").alias("path"))


@query("g04_ranked_trails", f"""WITH line AS (SELECT l_orderkey AS q, min({{'s': l_suppkey, 'p': l_partkey}}) AS x FROM lineitem WHERE l_orderkey % 40 = 0 GROUP BY 1), ask AS MATERIALIZED (SELECT q, 'Is ' || s_name || ' responsible for what it provides as ' || p_name AS t, ['supplier:' || x.s, 'part:' || x.p] AS seeds, [s_name, p_name] AS names FROM line JOIN supplier ON s_suppkey = x.s JOIN part ON p_partkey = x.p), s AS (SELECT q, t FROM ask), {_TERMS},
    ev AS MATERIALIZED (SELECT * FROM kg_evidence WHERE status = 'active'), e AS MATERIALIZED (SELECT id, src, dst, rel_type, weight FROM kg_active WHERE edge_class = 'asserted_fact' AND id IN (SELECT edge_id FROM ev)), two AS MATERIALIZED (SELECT src AS u, dst AS v, id FROM e UNION ALL SELECT dst, src, id FROM e),
    seed AS MATERIALIZED (SELECT DISTINCT unnest(seeds) AS seed FROM ask), w1 AS MATERIALIZED (SELECT seed, [seed, v] AS nodes, [id] AS edges FROM seed JOIN two ON u = seed QUALIFY row_number() OVER (PARTITION BY seed ORDER BY id) <= 24), few1 AS (SELECT seed, count(*) AS n FROM w1 GROUP BY 1 HAVING count(*) < 24),
    w2 AS MATERIALIZED (SELECT seed, list_append(nodes, v) AS nodes, list_append(edges, id) AS edges, n FROM w1 JOIN few1 USING (seed) JOIN two ON u = nodes[-1] WHERE NOT list_contains(nodes, v) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY list_append(edges, id)) + n <= 24), few2 AS (SELECT seed, any_value(n) + count(*) AS n FROM w2 GROUP BY 1 HAVING any_value(n) + count(*) < 24),
    w3 AS MATERIALIZED (SELECT seed, list_append(nodes, v) AS nodes, list_append(edges, id) AS edges FROM w2 JOIN few2 USING (seed) JOIN two ON u = nodes[-1] WHERE NOT list_contains(nodes, v) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY list_append(edges, id)) + few2.n <= 24),
    ego AS (SELECT seed, nodes, edges FROM w1 UNION ALL SELECT seed, nodes, edges FROM w2 UNION ALL SELECT seed, nodes, edges FROM w3),
    pr AS MATERIALIZED (SELECT DISTINCT seeds[1] AS a, seeds[2] AS b FROM ask), sp AS (SELECT a, b, [a, b] AS nodes, [id] AS edges FROM pr JOIN two ON u = a AND v = b
        UNION ALL SELECT a, b, [a, x.v, y.v, b], [x.id, y.id, z.id] FROM pr JOIN two x ON x.u = a JOIN two z ON z.v = b JOIN two y ON y.u = x.v AND y.v = z.u WHERE x.v <> b AND z.u <> a),
    short AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(edges), nodes) = 1),
    tr AS MATERIALIZED (SELECT q, nodes, edges, max(pair) AS pair FROM (SELECT q, nodes, edges, 0.0::DOUBLE AS pair FROM (SELECT q, unnest(seeds) AS seed FROM ask) JOIN ego USING (seed) UNION ALL SELECT q, nodes, edges, 0.22 FROM ask JOIN short ON a = seeds[1] AND b = seeds[2]) GROUP BY ALL),
    ch AS MATERIALIZED (SELECT edge_id, list(DISTINCT chunk_id) AS chunks, arg_max(quote, {{'c': confidence, 'i': id}}) AS quote FROM ev GROUP BY 1), st AS MATERIALIZED (SELECT edge_id AS key, count(*) FILTER (quote LIKE 'A%') AS won, count(*) FILTER (quote LIKE 'R%') AS lost FROM kg_evidence GROUP BY 1),
    h AS MATERIALIZED (SELECT q, edges, nodes, pair, list(weight ORDER BY i) AS w, list_distinct(flatten(list(chunks))) AS chunks, string_agg(quote, ' ' ORDER BY i) AS quotes FROM (SELECT q, edges, nodes, pair, unnest(edges) AS edge_id, generate_subscripts(edges, 1) AS i FROM tr) JOIN e ON e.id = edge_id JOIN ch USING (edge_id) GROUP BY ALL),
    n AS MATERIALIZED (SELECT q, edges, nodes, list(name ORDER BY i) AS names FROM (SELECT q, edges, nodes, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS i FROM tr) JOIN kg_nodes USING (id) GROUP BY ALL),
    k AS (SELECT h.q, h.edges, len(h.edges) AS hops, h.pair, w, len(chunks) AS c, lower(array_to_string(n.names, ' ') || ' ' || quotes) AS blob, len(list_intersect(list_distinct(n.names), list_distinct(ask.names))) AS met, CASE WHEN won + lost >= 2 THEN won / (won + lost)::DOUBLE - 0.5 ELSE 0.0 END AS fit, list_filter(terms, lambda x: x NOT IN ('who', 'what', 'when', 'where', 'why', 'how', 'which', 'does', 'did', 'are', 'is')) AS terms
        FROM h JOIN n ON n.q = h.q AND n.edges = h.edges AND n.nodes = h.nodes JOIN ask ON ask.q = h.q JOIN v1 ON v1.q = h.q LEFT JOIN st ON key = array_to_string(h.edges, '|')),
    o AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda x: contains(blob, x))) / len(terms)::DOUBLE ELSE 0.0 END - 0.35 * CASE WHEN length(trim(blob)) < 20 THEN 0.4 ELSE 0.0 END AS rel FROM k),
    z AS (SELECT q, array_to_string(edges, '|') AS trail, hops, c, round(least(1.0::DOUBLE, 0.72::DOUBLE + 0.06::DOUBLE * c + pair - 0.1::DOUBLE * (hops - 1) + 0.08::DOUBLE * (list_sum(w) / len(w) - 1.0::DOUBLE) + 0.22::DOUBLE * fit) + 0.15::DOUBLE + 0.28::DOUBLE * greatest(0.0, least(1.0, rel)) - CASE WHEN rel < 0.2 THEN 0.35 ELSE 0.0 END::DOUBLE + CASE WHEN met >= 2 THEN 0.12::DOUBLE * (met - 1) ELSE 0.0 END::DOUBLE, 6)::DOUBLE AS strength FROM o)
    SELECT q, trail, CAST(hops AS INTEGER) AS hops, false AS conflict, strength, CAST(row_number() OVER (PARTITION BY q ORDER BY strength DESC, trail) AS INTEGER) AS rank, strength >= 0.5 AND c > 0 AS viable FROM z QUALIFY row_number() OVER (PARTITION BY q ORDER BY strength DESC, trail) <= 8""")
def _(d: Data) -> DataFrame:
    """The eight best trails for a question on the supplier and part of every 40th order, over edges with evidence; returned lines are a path's losses."""
    lines = d.table("lineitem").where("l_orderkey % 40 = 0").groupBy(F.col("l_orderkey").alias("q")).agg(F.min(F.struct(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))).alias("x")).select("q", "x.*")
    named = lines.join(d.table("supplier").select("s_suppkey", "s_name"), "s_suppkey").join(d.table("part").select("p_partkey", "p_name"), "p_partkey")
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    asks = named.select("q", F.concat(F.lit("Is "), "s_name", F.lit(" responsible for what it provides as "), "p_name").alias("t"), F.array(ref("supplier", "s_suppkey"), ref("part", "p_partkey")).alias("seeds"))
    active = d.evidence.where("status = 'active'")
    edges = d.active_edges.where("edge_class = 'asserted_fact'").join(active.select(F.col("edge_id").alias("id")), "id", "left_semi")
    stats = d.evidence.groupBy(F.col("edge_id").alias("key")).agg(F.count_if(F.col("quote").startswith("A")).alias("won"), F.count_if(F.col("quote").startswith("R")).alias("lost"))
    return trails.ranked_trails(asks, d.nodes, edges, active, stats)
