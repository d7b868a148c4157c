"""A cleaning and packing pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``docs``. Rows without a doc_id pass the stages that compare documents unchanged.

Defined cases: null, empty and wordless texts fail the quality rules and go first; texts of any length are read whole by
every stage; of rows with one id and text one stays, whichever (they differ in other columns at most), and of a near-duplicate
group the row with the smallest id; repeated passages stay in the document with the smallest id; an empty table gives no rows; other columns are kept
up to packing, and names that a stage needs for itself are chosen so that they clash with none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard, packing, quality, secrets, suffix_dedup
from factloom.llm.queries import BYTE_BPE
from factloom.llm.scratch import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    own = named("quality", docs)
    return quality.judge(docs, prefix=own("")).where(F.col(own("kept"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays; documents without words have no group."""
    own = named("group", docs)
    groups = jaccard.near_duplicates(docs, with_texts=True)
    stays = groups.where("doc_id = component_id").select("doc_id", F.struct("n_bytes", "crc32").alias(own("key"))).distinct()
    rows = docs.where("doc_id IS NOT NULL").withColumn(own("key"), text_key())
    return rows.join(stays, ["doc_id", own("key")], "left_semi").dropDuplicates(["doc_id", own("key")]).select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that earlier documents have are cut out; halves of characters at the cuts go with them."""
    own = named("found", docs)
    left = suffix_dedup.remove_repeats(docs.select("doc_id", "text"), as_text=True)
    left = left.where("doc_id IS NOT NULL AND n_removed > 0").select("doc_id", F.struct("n_bytes", "crc32").alias(own("key")), F.col("kept").alias(own("kept")))
    joined = docs.withColumn(own("key"), text_key()).join(left.dropDuplicates(["doc_id", own("key")]), ["doc_id", own("key")], "left")
    return replaced(docs, joined, F.coalesce(F.col(own("kept")), F.col("text")))


def redacted_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    spans = named("found", docs)("spans")
    return replaced(docs, secrets.scan(docs, out=spans), secrets.redact(F.col("text"), F.col(spans)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack(docs, BYTE_BPE)


def text_key():
    """Length and checksum of the text: with the id, what tells rows apart."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text.cast("binary")).alias("crc32"))


def named(label: str, docs: DataFrame):
    """Names for columns that no column of ``docs`` has."""
    while any(c.lower().startswith(label) for c in docs.columns):
        label = "_" + label
    return lambda c: f"{label}_{c}"


def replaced(docs: DataFrame, rows: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` with a new text and its length."""
    new = named("new", docs)("text")
    value = {"text": F.col(new), "n_chars": F.coalesce(F.char_length(F.col(new)).cast(dict(docs.dtypes).get("n_chars", "long")), "n_chars")}
    return rows.withColumn(new, text).select(*(value.get(c, F.col(c)).alias(c) for c in docs.columns))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", redacted_secrets),
    ("packing", packed),
]

#: Tokens, fingerprints and least-squares plans aren't for SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES[:-1]:
        docs = materialize(f(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
