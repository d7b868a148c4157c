"""From names in questions to entities: exact name or alias, code, near names; versions that a bare name leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import terms as T
from factloom.functions import text
from factloom.functions.arrays import found
from factloom.operators.joins import fuzzy_link
from factloom.operators.lineage import cut, sorted_join

#: How many entities a code, a near name and a bare name of versions may stand for.
BY_CODE, BY_FUZZY, VERSIONS = 8, 4, 12


def _first(rows: DataFrame, k: int, *order) -> DataFrame:
    place = Window.partitionBy("term").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def resolved(terms: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """term, n, id, name, copies, rank, how: what each distinct term may stand for.

    nodes (id, name) of equal normalised names are one entity n, told by their smallest id, with the number of them.
    how: ``exact`` by name or alias (node_id, normalized_alias); else ``code``, for terms like SL3000 that a name equals
    without blanks and hyphens; else ``fuzzy``, by prefix or containment of names and aliases, closest in length first.
    ``version`` rows come beside them where two or more versions of a bare name exist. Null and empty names stand for
    nothing. Terms that nothing matches have no row. Joins are on names, squeezed names, stems and rare pieces; nodes
    of one name meet a term as one row, so a name that many nodes have is no hot key.
    """
    keyed = sorted_join(nodes.select("id", "name", text.entity_name(F.col("name")).alias("n")).where("n <> ''"))
    names = sorted_join(cut(keyed.groupBy("n").agg(F.min("id").alias("id"), F.min("name").alias("name"), F.count("*").alias("copies"))))
    known = aliases.select(F.col("normalized_alias").alias("key"), F.col("node_id").alias("id")).join(keyed.select("id", "n"), "id").groupBy("key", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    known = sorted_join(cut(known.where("key <> ''")))
    asked = cut(terms.select("term").where("term IS NOT NULL").distinct().withColumn("norm", text.entity_name(F.col("term"))).where("norm <> ''"))

    own = asked.join(names.select(F.col("n").alias("norm"), "n", "id", "copies"), "norm")
    by_alias = asked.join(known.withColumnRenamed("key", "norm"), "norm")
    exact = own.select("term", "n", "id", "copies").unionByName(by_alias.select("term", "n", "id", "copies")).groupBy("term", "n").agg(F.min("id").alias("id"), F.max("copies").alias("copies"))
    exact = cut(_first(exact, 2**31 - 1, "id", "n").withColumn("how", F.lit("exact")))
    open_ = asked.join(sorted_join(exact.select("term").distinct()), "term", "left_anti")

    squeezed = lambda c: F.lower(F.regexp_replace(c, "[ -]", ""))
    keys = names.select("n", "id", "copies", F.explode(F.array_distinct(F.array(squeezed(F.col("n")), squeezed(F.col("name"))))).alias("key"))
    coded = open_.withColumn("key", text.alnum_key(F.col("norm"))).where((F.char_length("key") >= 4) & F.col("key").rlike(r"^[a-z]{1,8}\d{2,}$"))
    code = cut(_first(coded.join(keys, "key").select("term", "n", "id", "copies").distinct(), BY_CODE, "id", "n").withColumn("how", F.lit("code")))
    open_ = open_.join(sorted_join(code.select("term").distinct()), "term", "left_anti")

    near = fuzzy_link(open_.select(F.col("norm").alias("term")).distinct(), names.select(F.col("n").alias("id"), F.col("n").alias("normalized_name")).unionByName(known.select(F.col("n").alias("id"), F.col("key").alias("normalized_name"))), BY_FUZZY)
    fuzzy = open_.join(sorted_join(near.select(F.col("term").alias("norm"), F.col("id").alias("n"), "rank")), "norm").join(names.select("n", "id", "copies"), "n").withColumn("how", F.lit("fuzzy"))

    columns = ["term", "n", "id", "copies", "rank", "how"]
    every = exact.select(columns).unionByName(code.select(columns)).unionByName(fuzzy.select(columns)).unionByName(_versions(asked, names).select(columns))
    return every.join(names.select("n", "name"), "n").select("term", "n", "id", "name", "copies", "rank", "how")


def _versions(asked: DataFrame, names: DataFrame) -> DataFrame:
    """The versions of bare names: ``<name> v..``, two at least."""
    stems = F.transform(F.filter(F.sequence(F.lit(1), F.char_length("n")), lambda i: F.substring(F.col("n"), i, F.lit(2)) == " v"), lambda i: F.substring(F.col("n"), F.lit(1), i - 1))
    versions = names.where(F.col("n").rlike(T.VERSION)).select("n", "id", "copies", F.explode(F.array_distinct(F.concat(stems, F.array("n")))).alias("norm"))
    bare = asked.where((F.char_length("norm") >= 4) & ~F.col("term").rlike(T.CODES) & ~F.col("term").rlike(T.VERSION))
    rows = bare.join(sorted_join(versions), "norm")
    several = rows.groupBy("term").agg(F.sum("copies").alias("all")).where("all > 1").select("term")
    return _first(rows.join(sorted_join(several), "term", "left_semi"), VERSIONS, "n").withColumn("how", F.lit("version"))


def overlap(name: Column, n: Column, term: Column, question: Column) -> Column:
    """Hundredths: 10 for the name itself, 6 for a name that holds the term, 1.5 for each other word of the question in it, .05 less for each character over 40."""
    low, blob = F.lower(F.trim(term)), F.lower(F.concat_ws(" ", name, n))
    base = F.when(n == low, 1000).when((low != "") & blob.contains(low), 600).otherwise(0)
    words = F.filter(found(F.lower(question), "[a-z0-9]{4,}"), lambda w: (w != low) & blob.contains(w))
    return base + 150 * F.size(words) - 5 * F.greatest(F.lit(0), F.char_length(name) - 40)


def is_related(name: Column, n: Column, term: Column) -> Column:
    """Whether a name shares the term, as it stands or, from four characters on, without marks."""
    low, blob = F.lower(F.trim(term)), F.lower(F.concat_ws(" ", name, n))
    key = text.alnum_key(term)
    return (key != "") & (blob.contains(low) | ((F.char_length(key) >= 4) & text.alnum_key(blob).contains(key)))


def decided(asks: DataFrame, found_: DataFrame) -> DataFrame:
    """q, term, id, name, ambiguous, options: the entity of each term of each question.

    asks: q, t, comparison, side (whether the term is a compared side), term; found_: what ``resolved`` tells. Several names of
    like length are ambiguous, unless one is the term, one overlaps clearly most with the question, or only one is related;
    then id and name are null and up to four names are options. Compared things are asked back only about their sides,
    codes never bind to what doesn't share them. Terms that nothing matches have null id.
    """
    rows = asks.distinct().join(sorted_join(found_), "term")
    versions = Window.partitionBy("q", "term")
    rows = rows.withColumn("open", (F.max(F.col("how") == "version").over(versions)) & ~F.col("comparison")).where((F.col("how") == "version") == F.col("open"))
    rows = rows.withColumn("related", is_related(F.col("name"), F.col("n"), F.col("term"))).withColumn("score", overlap(F.col("name"), F.col("n"), F.col("term"), F.col("t")))
    ranked = rows.withColumn("place", F.row_number().over(versions.orderBy(F.desc("score"), "rank", "n")))
    one = F.struct("rank", "id", "name")
    size = F.char_length("n")
    g = ranked.groupBy("q", "term").agg(
        F.first("t").alias("t"), F.first("comparison").alias("comparison"), F.first("side").alias("side"), F.count("*").alias("names"), F.sum("copies").alias("matches"), (F.max(size) - F.min(size)).alias("gap"),
        F.max(F.col("n") == F.lower(F.trim("term"))).alias("itself"), F.min(one).alias("first"), F.min(F.when(F.col("related"), one)).alias("near"), F.sum(F.when(F.col("related"), F.col("copies")).otherwise(0)).alias("near_matches"),
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("top"), F.max(F.when((F.col("place") == 2) | ((F.col("place") == 1) & (F.col("copies") > 1)), F.col("score"))).alias("second"),
        F.max(F.when(F.col("place") == 1, one)).alias("best"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 4, F.struct("rank", "name")))).alias("options"),
    )
    single_word = ~F.trim("term").rlike(r"\s")
    may_ask = (~F.col("comparison") | F.col("side")) & ~(single_word & F.col("t").rlike(T.ARTIFACT))
    alike = (F.col("names") > 1) & ~F.col("itself") & (F.col("gap") <= 8) & may_ask
    foreign = T.is_code(F.trim("term")) & F.col("near").isNull()
    clear = (F.col("top") >= 600) & (F.col("top") >= F.col("second") + 300)
    pick = F.when(foreign, None).when(alike & clear, F.col("best")).when(alike & (F.col("near_matches") != 1), None).otherwise(F.coalesce("near", "first"))
    unsure = alike & ~foreign & ~clear & (F.col("near_matches") != 1)
    told = g.select("q", "term", pick.alias("pick"), unsure.alias("ambiguous"), F.when(unsure, F.transform("options", lambda o: o["name"])).otherwise(F.array().cast("array<string>")).alias("options"))
    every = asks.select("q", "term").distinct().join(sorted_join(told), ["q", "term"], "left")
    return every.select("q", "term", F.col("pick.id").alias("id"), F.col("pick.name").alias("name"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("options", F.array().cast("array<string>")).alias("options"))


def outcomes(asks: DataFrame, terms: DataFrame, decisions: DataFrame) -> DataFrame:
    """q, entities, clear, reason, options: whether each question of ``asks`` (q, comparison, sides, overview) is resolved.

    Comparisons of two sides always go on; others need an entity and no ambiguity. Options are those of the first
    four ambiguous names, each once whatever its case, in order of the terms (q, term, pos).
    """
    d = terms.join(sorted_join(decisions), ["q", "term"]).groupBy("q").agg(F.count_if(F.col("id").isNotNull()).alias("entities"), F.max("ambiguous").alias("ambiguous"), F.array_sort(F.collect_list(F.struct("pos", "options"))).alias("o"))
    rows = asks.join(sorted_join(d), "q", "left")
    n, unsure = F.coalesce("entities", F.lit(0)), F.coalesce("ambiguous", F.lit(False))
    two = F.col("comparison") & (F.size("sides") >= 2)
    reason = F.when(two, "").when(unsure, "ENTITY_AMBIGUOUS").when((n == 0) & ~F.col("overview") & ~F.col("comparison"), "ENTITY_NOT_RESOLVED").otherwise("")
    flat = F.flatten(F.transform("o", lambda x: x["options"]))
    options = F.when(unsure & ~two, F.slice(F.filter(flat, lambda x, i: F.array_position(F.transform(flat, F.lower), F.lower(x)) == i + 1), 1, 4)).otherwise(F.array().cast("array<string>"))
    return rows.select("q", n.cast("long").alias("entities"), (two | (~unsure & (n > 0))).alias("clear"), reason.alias("reason"), options.alias("options"))
