"""Paths between many pairs of nodes, and the ranked trails of questions over edges that bear evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import evidence as rules
from factloom.functions import questions
from factloom.operators.dedupe import global_rank
from factloom.operators.graph import adjusted_by_relation, spread, trail_strength, undirected
from factloom.operators.lineage import cut

#: Neighbours up to which a node's are kept as one list, and entries of such lists that cost as much as a row that is exchanged.
LISTED, ENTRIES = 4096, 16

#: Distinct chunks of an edge that can still raise a trail's strength: with twelve it is 1 whatever hops, weights and losses take off.
CHUNKS = 12


def shortest_paths(pairs: DataFrame, edges: DataFrame, hops: int, parts: int | None = None) -> DataFrame:
    """a, b, hops, path of pairs (a, b) that are at most ``hops`` apart; of shortest paths the first by its nodes.

    A search from both ends: a pair that isn't adjacent becomes the pairs of one end's neighbours with the other
    end, by the end that has fewer. Pairs that many searches come to are solved once, nodes with one neighbour are no
    one's way, and results travel back as the least of each pair's ways; the last two hops are told by ``_middles``.
    The output is a row a pair.
    """
    steps = cut(spread(undirected(edges).select("u", "v").where("u <> v"), parts, "u", "v").distinct())
    degree = cut(steps.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")))
    inner = cut(steps.join(degree.where("n > 1").select(F.col("node").alias("v")), "v").select("u", "v"))
    width = inner.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"))
    return _between(pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), steps, inner, cut(width), hops)


def _between(pairs: DataFrame, steps: DataFrame, inner: DataFrame, width: DataFrame, hops: int) -> DataFrame:
    known = pairs.join(steps.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("next")), ["a", "b"], "left")
    known = cut(known.withColumn("hops", F.when(F.col("a") == F.col("b"), 0).when(F.col("next") & (F.lit(hops) > 0), 1)))
    done = known.where("hops IS NOT NULL").select("a", "b", "hops", F.when(F.col("hops") == 0, F.array("a")).otherwise(F.array("a", "b")).alias("path"))
    if hops < 2:
        return done
    wide = lambda side: width.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"))
    open_ = known.where("hops IS NULL").select("a", "b").join(wide("a"), "a", "left").join(wide("b"), "b", "left").where("n_a > 0 AND n_b > 0")
    open_ = cut(open_.select("a", "b", (F.col("n_a") <= F.col("n_b")).alias("left"), F.least("n_a", "n_b").alias("few"), F.greatest("n_a", "n_b").alias("many")))
    if open_.isEmpty():
        return done
    if hops == 2:
        met = _middles(open_, inner)
        return cut(done.unionByName(met.select("a", "b", F.lit(2).alias("hops"), F.array("a", "m", "b").alias("path"))))
    way = inner.select(F.col("u").alias("from"), F.col("v").alias("to"))
    lefts = open_.where("left").join(way, F.col("a") == F.col("from")).select("a", "b", "left", F.col("to").alias("x"), F.col("b").alias("y"))
    rights = open_.where("NOT left").join(way, F.col("b") == F.col("from")).select("a", "b", "left", F.col("a").alias("x"), F.col("to").alias("y"))
    opened = cut(lefts.unionByName(rights))
    found = _between(opened.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), steps, inner, width, hops - 1)
    back = opened.join(found.select(F.col("a").alias("x"), F.col("b").alias("y"), "hops", "path"), ["x", "y"])
    whole = F.when(F.col("left"), F.concat(F.array("a"), "path")).otherwise(F.concat("path", F.array("b")))
    best = back.select("a", "b", F.struct((F.col("hops") + 1).alias("hops"), whole.alias("path")).alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    return cut(done.unionByName(best.select("a", "b", "w.hops", "w.path")))


def _middles(open_: DataFrame, inner: DataFrame) -> DataFrame:
    """a, b, m: the first node between the ends of pairs (a, b, left, few, many) that aren't adjacent, where there is one; inner: u, v.

    Three ways that tell the same, chosen by how many rows they exchange. Neighbours of both sides' ends meet by the node
    between, so an end's neighbours are told once however many pairs it has; that is little where one side has few ends, hubs say.
    Otherwise the narrower end's neighbours go to the other end as one list of numbers in order of name, not as rows;
    where the other end has too many for a list, as rows.
    """
    narrow, other = F.when(F.col("left"), F.col("a")).otherwise(F.col("b")), F.when(F.col("left"), F.col("b")).otherwise(F.col("a"))
    asked = cut(open_.select("a", "b", narrow.alias("from"), other.alias("to"), "few", "many"))
    rows = asked.agg(F.sum(F.when(F.col("many") <= LISTED, (F.col("few") + F.col("many")) / ENTRIES).otherwise(F.col("few")))).first()[0] or 0
    at = lambda end: cut(inner.join(asked.select(F.col(end).alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias(end), F.col("v").alias("m")))
    near, far = at("a"), at("b")
    n = lambda df, name: df.groupBy("m").agg(F.count("*").alias(name))
    if (n(near, "x").join(n(far, "y"), "m").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0) <= rows:
        met = near.join(far, "m").groupBy("a", "b").agg(F.min("m").alias("m"))
        return asked.join(met, ["a", "b"]).select("a", "b", "m")
    held = near.select(F.col("a").alias("node"), "m").unionByName(far.select(F.col("b").alias("node"), "m"))
    few = asked.where(F.col("many") <= LISTED)
    ends = few.select(F.col("from").alias("node")).unionByName(few.select(F.col("to").alias("node"))).distinct()
    held = held.join(ends, "node", "left_semi").distinct()
    names = cut(global_rank(held.select("m").distinct(), ["m"], "number"))
    lists = cut(held.join(names, "m").groupBy("node").agg(F.array_sort(F.collect_list(F.col("number").cast("int"))).alias("list")))  # at most LISTED entries
    of = lambda end, name: lists.select(F.col("node").alias(end), F.col("list").alias(name)).hint("merge")
    both = few.select("a", "b", "from", "to").join(of("from", "x"), "from").join(of("to", "y"), "to")
    met = cut(both.select("a", "b", F.array_min(F.array_intersect("x", "y")).alias("number")).where("number IS NOT NULL"))
    tried = asked.where(F.col("many") > LISTED).join(inner.select(F.col("u").alias("from"), F.col("v").alias("m")), "from").select("a", "b", "to", "m")
    wide = tried.join(inner.select(F.col("u").alias("to"), F.col("v").alias("m")), ["to", "m"]).groupBy("a", "b").agg(F.min("m").alias("m"))
    return met.join(names.select(F.col("number").cast("int").alias("number"), "m"), "number").select("a", "b", "m").unionByName(wide)


def ego_trails(seeds: DataFrame, steps: DataFrame, hops: int, k: int) -> DataFrame:
    """seed, nodes, edges: the k first simple paths of each seed by length, then by their edges; steps: u, v, id.

    A seed that has k paths stops, and each seed's rows are limited before they are exchanged. Of a node's steps only as
    many are read as k paths can need, though some lead back into a path: k of each pair's, and k for each node of a path and k more.
    Paths are ordered by their first edges, so of a seed's paths only the first ones go on, those whose least numbers of next steps make up k.
    """
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    near = steps.where("u <> v").repartition("u").withColumn("r", by("u", "v")).where(F.col("r") <= k).withColumn("r", by("u")).where(F.col("r") <= k * (hops + 1)).drop("r")
    near = cut(near)
    ways = near.groupBy("u").agg(F.countDistinct("v").alias("ways"))
    ahead_of = Window.partitionBy("seed").orderBy("edges").rowsBetween(Window.unboundedPreceding, -1)
    paths = seeds.select("seed", F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(0).cast("long").alias("had"))
    out = None
    for h in range(hops):
        ahead = paths.withColumn("u", F.element_at("nodes", -1))
        if h:  # a path of h edges has h nodes that its last one may not go to
            sure = F.coalesce(F.sum(F.greatest(F.col("ways") - h, F.lit(0))).over(ahead_of), F.lit(0))
            ahead = ahead.join(ways, "u").withColumn("sure", sure).where(F.col("sure") + F.col("had") < k).drop("ways", "sure")
        ahead = ahead.join(near, "u").where(~F.array_contains("nodes", F.col("v")))
        ahead = ahead.select("seed", F.concat("nodes", F.array("v")).alias("nodes"), F.concat("edges", F.array("id")).alias("edges"), "had")
        ranked = ahead.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("edges"))).where(F.col("r") <= k)
        kept = cut(ranked.where(F.col("r") + F.col("had") <= k).drop("r"))
        out = kept.select("seed", "nodes", "edges") if out is None else out.unionByName(kept.select("seed", "nodes", "edges"))
        paths = kept.select("seed", "nodes", "edges", (F.col("had") + F.count("*").over(Window.partitionBy("seed"))).alias("had")).where(F.col("had") < k)
    return out


def path_key(edges: Column) -> Column:
    return F.array_join(edges, "|")


def ranked_trails(asks: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, stats: DataFrame, hops: int = 3, paths: int = 24, keep: int = 8) -> DataFrame:
    """q, trail (edge ids), hops, conflict, strength, rank, viable: the best trails of every question.

    asks: q (each once), t and seeds (ids of nodes, an array); edges: id, src, dst, rel_type, weight, all with evidence; evidence: id, edge_id,
    chunk_id, quote, confidence; stats: key (edge ids joined by bars), won, lost. Trails are the first paths around each seed,
    and the shortest one between each two seeds, which gains .22.
    """
    edges = cut(edges.select("id", "src", "dst", "rel_type", "weight"))
    steps = undirected(edges).select("u", "v", "id")
    asks = cut(asks.select("q", "t", F.array_distinct("seeds").alias("seeds"), questions.question_terms(F.col("t")).alias("qterms")))  # once a question, not a trail
    each = asks.select("q", F.explode("seeds").alias("seed"))
    around = each.join(ego_trails(each.select("seed").distinct(), steps, hops, paths), "seed").select("q", "nodes", "edges", F.lit(0.0).alias("pair"))
    placed = asks.select("q", F.posexplode("seeds").alias("i", "seed"))
    two = placed.select("q", "i", F.col("seed").alias("a")).join(placed.select("q", F.col("i").alias("j"), F.col("seed").alias("b")), "q").where("i < j").distinct()  # a question has few seeds
    between = two.select("q", "a", "b").join(shortest_paths(two.select("a", "b"), edges, hops).where("hops > 0"), ["a", "b"])
    one = steps.groupBy("u", "v").agg(F.min("id").alias("id"))
    walked = between.select("q", "a", "b", "path", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("i", "u")).withColumn("v", F.get("path", F.col("i") + 1)).join(one, ["u", "v"])
    paired = walked.groupBy("q", "path").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("e")).select("q", F.col("path").alias("nodes"), F.col("e.id").alias("edges"), F.lit(0.22).alias("pair"))
    trails = cut(around.unionByName(paired).groupBy("q", "nodes", "edges").agg(F.max("pair").alias("pair")))

    chunk = evidence.select("edge_id", "chunk_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("edge_id").orderBy("chunk_id"))).where(F.col("r") <= CHUNKS)
    chunks = chunk.groupBy("edge_id").agg(F.collect_list("chunk_id").alias("chunks"))
    quotes = evidence.groupBy("edge_id").agg(F.max(F.struct("confidence", "id", "quote"))["quote"].alias("quote"))
    told = edges.select(F.col("id").alias("edge_id"), "rel_type", "weight").join(chunks, "edge_id", "left").join(quotes, "edge_id", "left")
    hop = trails.select("q", "nodes", "edges", "pair", F.posexplode("edges").alias("i", "edge_id")).join(told, "edge_id")
    path = hop.groupBy("q", "nodes", "edges", "pair").agg(F.array_sort(F.collect_list(F.struct("i", "rel_type", "weight", "chunks", "quote"))).alias("h"))
    names = trails.select(F.explode("nodes").alias("id")).distinct().join(nodes.select("id", "name"), "id")
    named = trails.select("q", "edges", "nodes", F.posexplode("nodes").alias("i", "id")).join(names, "id").groupBy("q", "nodes", "edges").agg(F.array_sort(F.collect_list(F.struct("i", "name")))["name"].alias("names"))
    seed_names = each.join(nodes.select(F.col("id").alias("seed"), "name"), "seed").groupBy("q").agg(F.collect_set("name").alias("seed_names"))
    whole = path.join(named, ["q", "nodes", "edges"]).join(asks.select("q", "t", "qterms"), "q").join(seed_names, "q").join(stats.withColumnRenamed("key", "own_key"), path_key(F.col("edges")) == F.col("own_key"), "left")

    trials = F.coalesce(F.col("won") + F.col("lost"), F.lit(0))
    fit = F.when(trials >= 2, F.col("won") / trials - 0.5).otherwise(0.0)
    n = F.size(F.array_distinct(F.flatten(F.filter("h.chunks", lambda c: c.isNotNull()))))
    conflict = F.array_contains("h.rel_type", "CONFLICTS_WITH")
    mean = F.aggregate("h.weight", F.lit(0.0), lambda s, w: s + w) / F.size("h")
    strength = trail_strength(n, F.size("h"), mean, fit, conflict, F.col("pair"))
    rels, blob = F.lower(F.array_join("h.rel_type", " ")), F.lower(F.concat_ws(" ", F.array_join("names", " "), F.array_join(F.filter("h.quote", lambda x: x.isNotNull()), " ")))
    whole = whole.withColumn("blob", blob).select("q", F.size("h").alias("hops"), path_key(F.col("edges")).alias("trail"), "t", conflict.alias("conflict"), strength.alias("own"), adjusted_by_relation(F.lower("t"), rels).alias("asked"), n.alias("n"), F.size(F.array_intersect("names", "seed_names")).alias("met"), rules.content_overlap(F.col("t"), F.col("blob"), {"qterms": F.col("qterms")}).alias("ov"), rules.text.boilerplate_penalty(F.col("blob")).alias("pen"))
    rel = rules.trail_relevance(F.col("ov"), F.col("pen"))
    total = F.col("own") + F.col("asked") + 0.28 * rel - F.when(rel < 0.2, 0.35).otherwise(0.0) + F.when(F.col("met") >= 2, 0.12 * (F.col("met") - 1)).otherwise(0.0)
    rated = whole.select("q", "trail", "hops", "conflict", F.round(total, 6).alias("strength"), "n")
    ranked = rated.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("strength"), "trail"))).where(F.col("rank") <= keep)
    return ranked.select("q", "trail", "hops", "conflict", "strength", "rank", ((F.col("strength") >= 0.5) & (F.col("n") > 0)).alias("viable"))
