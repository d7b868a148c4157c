"""Lexical retrieval and judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import chunks
from factloom.operators.phrases import occurrences


def term_overlap(t: Column, terms: list[str]) -> Column:
    low = F.lower(t)
    return sum((F.when(low.contains(x), 1).otherwise(0) for x in terms), F.lit(0)) / float(len(terms))


def trust(entity: Column, path: Column, cover: Column, quality: Column, conflict: Column) -> Column:
    """Component-wise trust in [0, 1]."""
    raw = 0.20 * entity + 0.20 * path + 0.35 * cover + 0.25 * quality - F.when(conflict, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def verify_cases(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, docs, verdict of cases (item_id, must): in how many documents (id, text) a case's phrase stands; texts and phrases in one case."""
    hits = occurrences(docs, cases.select(F.col("must").alias("phrase"))).groupBy("phrase").agg(F.count("*").alias("docs"))
    return cases.join(hits.withColumnRenamed("phrase", "must"), "must", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.when(F.col("docs") > 0, "pass").otherwise("retrieval").alias("verdict"))


def fail_kind(expect: Column, decision: Column, must: Column, answer: Column, forbidden: Column) -> Column:
    """Why a case fails, or the empty string: the decision, then what the answer must hold, then what it must not."""
    missed = (F.size(must) > 0) & ~F.exists(must, lambda w: answer.contains(w))
    wrong = F.when((expect == "answer") & (decision == "refuse"), "refuse_wrong").when((expect == "answer") & (decision == "clarify"), "clarify_wrong").when((expect == "refuse") & (decision == "answer"), "should_refuse").otherwise("decision_mismatch")
    return F.when((expect != "either") & (decision != expect), wrong).when((expect == "answer") & missed, "must_any_miss").when(forbidden, "forbid_hit").otherwise("")


def evidence_pack(scored: DataFrame, terms: list[str], k: int) -> DataFrame:
    """doc_id, score: the k best rows (doc_id, t, score) and the best row of every term, in two passes however many terms there are."""
    best = scored.orderBy(F.desc("score"), "doc_id").limit(k).select("doc_id", "score")
    held = scored.select("doc_id", "score", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda term: F.col("t").contains(term))).alias("term"))
    first = held.groupBy("term").agg(F.min(F.struct((-F.col("score")).alias("order"), "doc_id", "score")).alias("b"))
    return best.union(first.select("b.doc_id", "b.score")).distinct()


def lexical_pack(docs: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k best passages of deduplicated, chunked documents, quarantined ones left out.

    Texts are hashed, cut and scored in one scan; of equal texts the passages meet by hash and place, without the text,
    and those of the document that stays are kept. The texts of the k best are read again for their excerpts.
    """
    hashed = docs.select("doc_id", "n_chars", "text", "source", F.sha2("text", 256).alias("h"))
    title, piece = F.col("source"), F.col("piece")
    pieces = chunks.chunked(hashed, "doc_id", "text", keep=["n_chars", "source", "h"]).withColumn("parts", text.quarantine_parts(title, piece))
    pieces = pieces.withColumn("chrome", text.quarantine_chrome(F.col("parts"), title, piece))
    scored = pieces.select("h", "ordinal", "n_chars", "doc_id", "char_start", "char_end", F.round(text.lexical_score(piece, title, terms), 4).alias("score"), text.quarantined(F.col("parts"), F.col("chrome")).alias("quarantine"))
    kept = scored.groupBy("h", "ordinal").agg(F.max(F.struct("n_chars", "doc_id", "char_start", "char_end", "score", "quarantine")).alias("p")).select("p.*", "ordinal").where("NOT quarantine")
    order = [F.desc("score"), F.col("doc_id"), F.col("ordinal")]
    best = kept.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    piece = text.stripped(F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    told = docs.select("doc_id", "text").join(F.broadcast(best), "doc_id")
    return told.select("doc_id", "ordinal", "char_start", "char_end", "score", text.excerpt(piece, terms[0]).alias("excerpt"), "rank")
