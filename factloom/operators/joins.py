"""Joins of the knowledge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.lineage import cut, sorted_join

#: Parts that the rows of a very frequent piece are dealt into.
SALTS = 64


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: edges at either end; a self-loop counts once. One pass instead of a join on src OR dst."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def with_endpoint_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with src_name and dst_name; edges that lack a node go."""
    names = nodes.select("id", "name")
    one = edges.join(names.withColumnsRenamed({"id": "src", "name": "src_name"}), "src")
    return one.join(names.withColumnsRenamed({"id": "dst", "name": "dst_name"}), "dst")


def evidenced_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Asserted, active edges with active evidence."""
    return edges.where("edge_class = 'asserted_fact' AND status = 'active'").join(evidence.where("status = 'active'").select(F.col("edge_id").alias("id")), "id", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge, missing: endpoints that no node has."""
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array("src", "dst")).alias("missing"))
    return ends.join(nodes.select(F.col("id").alias("missing")), "missing", "left_anti").select("edge", "missing")


def resolve_exact(names: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """term, id: nodes whose normalised name or alias is the term, each once."""
    direct = names.join(nodes.select(F.col("normalized_name").alias("term"), "id"), "term")
    by_alias = names.join(aliases.select(F.col("normalized_alias").alias("term"), F.col("node_id").alias("id")), "term")
    return direct.select("term", "id").union(by_alias.select("term", "id")).distinct()


def fuzzy_link(names: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """term, id, rank of the k best nodes by any of their names (id, normalized_name): exact, then prefix of either, then containment (terms or names of 5 and more).

    Whichever string lies in the other, all its 4-character pieces do: it is looked up by its rarest one, so that
    pieces which many names share form no large groups. Strings under 4 characters have no candidates. Pieces that make
    up more than a thousandth of all, fewer than a thousand, are known to every task, and their rows are dealt into ``SALTS`` parts.
    """
    from pyspark.sql import Window

    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - 3), lambda i: F.substring(c, i, 4)))
    terms = sorted_join(names.where(F.char_length("term") >= 4).select("term", F.explode(grams(F.col("term"))).alias("g")))
    named = sorted_join(nodes.where(F.char_length("normalized_name") >= 4).select("id", F.col("normalized_name").alias("n"), F.explode(grams(F.col("normalized_name"))).alias("g")))
    often = cut(named.groupBy("g").agg(F.count("*").alias("often")))
    total = often.agg(F.sum("often").alias("total"))
    often = often.crossJoin(F.broadcast(total)).select("g", "often", (F.col("often") * 1000 > F.col("total")).alias("hot"))
    hot = F.broadcast(often.where("hot").select("g", "hot"))
    dealt = sorted_join(named.join(hot, "g", "left").select("id", "n", "g", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "n"), F.lit(SALTS))).otherwise(0).alias("salt")))
    everywhere = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("hot"), SALTS - 1).otherwise(0).cast("long")))).drop("hot")
    rarest = lambda *more: F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g", *more)).alias("r")
    by_term = terms.join(sorted_join(often), "g", "left").groupBy("term").agg(rarest("hot")).select("term", "r.g", "r.hot")
    by_term = sorted_join(everywhere(by_term)).join(dealt, ["g", "salt"]).select("term", "id", "n")
    by_name = dealt.join(sorted_join(everywhere(often)), ["g", "salt"]).groupBy("id", "n").agg(rarest("salt")).select("id", "n", "r.g", "r.salt")
    by_name = by_name.join(everywhere(terms.join(hot, "g", "left")), ["g", "salt"]).select("term", "id", "n")
    near = by_term.union(by_name).distinct()
    long_t, long_n = F.char_length("term") >= 5, F.char_length("n") >= 5
    rank = F.when(F.col("term") == F.col("n"), 0).when(F.col("n").startswith(F.col("term")) | F.col("term").startswith(F.col("n")), 1).when((long_t & F.col("n").contains(F.col("term"))) | (long_n & F.col("term").contains(F.col("n"))), 2)
    scored = near.select("term", "id", rank.alias("class"), F.abs(F.char_length("term") - F.char_length("n")).alias("gap")).where("class IS NOT NULL")
    best = scored.groupBy("term", "id").agg(F.min(F.struct("class", "gap")).alias("best"))
    order = Window.partitionBy("term").orderBy("best", "id")
    return best.select("term", "id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
