"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import alignment, bpe, jaccard, knn, langid, packing, periodic, quality, secrets, sharding, simhash, suffix_dedup, toxicity
from factloom.llm.heldout import held_out

#: The byte-level vocabulary; the operators take any such file's path.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: The sentencepiece model; likewise.
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.select("doc_id", bpe.encoder(spark, BYTE_BPE)("text").alias("ids"))
    done = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), bpe.decoder(spark, BYTE_BPE)(F.coalesce("ids", F.array().cast("array<int>"))).alias("decoded"))  # coalesce: else ids are computed for each use
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove passages of 50 bytes that documents with smaller ids have."""
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group near-duplicate documents."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), langid.identify(docs, langid.learn(docs)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every 50th vector."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out().alias("held_out"), toxicity.probability(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put every document into one of 40 shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by word statistics and compression bands."""
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.render(base).cast("binary"), 256).alias("base_sha256"), secrets.render(F.col("spans")).alias("spans"))


def planted_period(text: Column, doc_id: Column) -> Column:
    """The contract's rewriting: of every tenth text by crc32 of its id, the words from some place on repeat the first of them."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    start = F.pmod(g, F.nullif(n, F.lit(0))).cast("int")
    period = (1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
    return F.when(h % 10 == 0, F.array_join(F.concat(F.slice(words, 1, start), F.slice(again, 1, n - start)), " ")).otherwise(text)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find every document's maximal periodic runs of words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.find_runs(docs)
    before = lambda a, b: F.struct(-a["length"], a["start"], a["period"]) < F.struct(-b["length"], b["start"], b["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda m, r: F.when(m.isNull() | before(r, m), r).otherwise(m))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    told = found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    return told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group documents whose fingerprints differ in at most 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align two tokenizers over every document and count their linked ids."""
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    found = alignment.cross_align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE, rendering=digest)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's word statistics and base rule, without the compression verdict."""
    return op9_quality(spark, sf_dir).drop("kept")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's base spans, without the linked ones."""
    return op10_secrets(spark, sf_dir).drop("spans")


QUERIES = {"op1_bpe": op1_bpe, "op2_packing": op2_packing, "op3_suffix_dedup": op3_suffix_dedup, "op4_jaccard": op4_jaccard, "op5_langid": op5_langid, "op6_topk": op6_topk, "op7_toxicity": op7_toxicity, "op8_sharding": op8_sharding, "op9_quality": op9_quality, "op10_secrets": op10_secrets, "op11_periodic": op11_periodic, "op12_simhash": op12_simhash, "op13_alignment": op13_alignment, "base_quality": base_quality, "base_secrets": base_secrets}
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
        ), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        classes AS MATERIALIZED (SELECT min(doc_id) AS rep, any_value(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
        rep_shingles AS MATERIALIZED (SELECT rep, n, unnest(s) AS shingle FROM classes),
        links AS MATERIALIZED (
            SELECT a.rep AS x, b.rep AS y FROM rep_shingles a JOIN rep_shingles b ON a.shingle = b.shingle AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least_of AS (SELECT x, min(y) AS component FROM reach GROUP BY x),
        member AS (SELECT s.doc_id, c.rep FROM sets s JOIN classes c ON len(s.s) > 0 AND list_sort(s.s) = list_sort(c.s))
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id
        FROM sets s LEFT JOIN member m USING (doc_id) LEFT JOIN least_of l ON l.x = m.rep""",
    "base_quality": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        words AS MATERIALIZED (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM t),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t),
        again AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, array_to_string(w[i:i + 4], ' ') AS five FROM words WHERE len(w) >= 5),
        twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
        covered AS (SELECT doc_id, CAST(count(DISTINCT k) AS BIGINT) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
            CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(a.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
            len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
        FROM words LEFT JOIN again a USING (doc_id) LEFT JOIN covered c USING (doc_id)""",
    "base_secrets": r"""
        WITH kinds(kind, name, pattern, part, least) AS (VALUES
            (0, 'assign', '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
            (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24)),
        t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        pieces AS (
            SELECT doc_id, 0 AS kind, regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m, regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS g,
                string_split_regex(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS b FROM t
            UNION ALL SELECT doc_id, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM t
            UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM t
        ), each AS (SELECT doc_id, kind, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: len(x))) AS n, unnest(list_transform(g, lambda x: len(x))) AS k, unnest(list_transform(b[1:len(m)], lambda x: len(x))) AS gap FROM pieces),
        ends AS (SELECT doc_id, kind, n, k, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM each),
        spans AS (SELECT doc_id, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, name FROM ends JOIN kinds USING (kind) WHERE k >= least)
        SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind), '')) AS base_sha256
        FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id""",
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[]) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}
