"""Training-data operators against plain versions, on adversarial words, long texts and growing inputs."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import jaccard, knn, langid, quality, queries, secrets, sharding, suffix_dedup, toxicity
from factloom.llm.scratch import shared_dir
from tests.conftest import SF
from tests.llm.test_llm import groups, odd, repeats, sha, word_counts  # noqa: F401
from tests.oracle import rows, sql_rows


@pytest.mark.parametrize("name", ["op4_jaccard", "base_quality", "base_secrets"])
def test_matches_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == sql_rows(queries.ORACLE_SQL[name], SF)


def complements(n: int) -> tuple[str, str]:
    """Two words that sums of powers of an odd base, modulo a power of two, can't tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_a_kind_differ(spark):
    rows_, texts = [], []
    for k, n in enumerate((32, 64, 512, 1024, 2048, 4096)):
        a, b = complements(n)
        texts += [f"{a}\n{b}", " ".join([a, "one two three four", b, "one two three four"]), f"{a} {a}\n{a} {a}", " ".join([a] * 9 + [b] * 3)]
        rows_ += [(10 * k, f"shared words are four {a}"), (10 * k + 1, f"shared words are four {b}"), (10 * k + 2, f"shared words are four {a}")]
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in quality.judge(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert tuple(r[f] for f in fields) == word_counts(r.text)
    got = jaccard.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == groups(rows_)


def linked(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text, every weak part looked at beside every other part."""
    patterns = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.WEAK_ID, secrets.WEAK_SECRET, secrets.ENDPOINT]
    parts = sorted((m.start(), m.end(), k) for k, p in enumerate(patterns) for m in re.finditer(p, text) if k or len(m[2]) >= 6)
    near = lambda x, role: any(secrets.ROLES[secrets.KINDS[y[2]]] == role and abs(y[0] - x[0]) < secrets.SCOPE for y in parts)
    needs = {"weak_id": "s", "weak_secret": "i", "endpoint": "is"}
    return [x for x in parts if all(near(x, role) for role in needs.get(secrets.KINDS[x[2]], ""))]


def test_links_by_brute_force(spark):
    rng = random.Random(2)
    parts = ["token=abcdef ", "é", "🙂", "user: bobby ", "AKIA" + "A" * 17, " password='x' ", "0" * 26, " ", "https://a.b/c ", "api_key = zzzzzzz", " filler" * 40, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12 "]
    table = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 600)))) for i in range(40)]
    found = secrets.scan(spark.createDataFrame(table, "i int, text string")).withColumn("t", secrets.redact(F.col("text"), F.col("spans")))
    for r in found.collect():
        assert [(s.start, s.end, s.kind) for s in r.spans] == linked(r.text)
        out, at = [], 0
        for s in r.spans:
            if s.start >= at:
                out += [r.text[at : s.start], "[SECRET]"]
            at = max(at, s.end)
        assert r.t == "".join(out) + r.text[at:]


def test_secrets_take_linear_time(spark):
    def seconds(n: int) -> float:
        began = time.perf_counter()
        found = secrets.scan(spark.createDataFrame([("token=abcdef user=bob " * n,)], "text string"))
        r = found.select(F.size("spans").alias("n"), F.char_length(secrets.redact(F.col("text"), F.col("spans"))).alias("left")).first()
        assert (r.n, r.left) == (2 * n, len("[SECRET] [SECRET] ") * n)
        return time.perf_counter() - began

    seconds(1)
    assert seconds(200_000) < 60


def test_running_sums(spark):
    rng = random.Random(5)
    arrays = [[rng.randint(-5, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 4096, 4097, 9000)]
    got = spark.createDataFrame([(a,) for a in arrays], "a array<int>").select("a", secrets.running(F.col("a"), lambda x, y: x + y).alias("s")).collect()
    assert all(r.s == np.cumsum(r.a, dtype=int).tolist() for r in got)


def test_language_by_plain_vectors(spark, odd):  # noqa: F811
    """Trigram by trigram, with dense vectors."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).union(odd.where("length(text) < 5000").select("text"))
    names, prototypes = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    e = langid.Encoder()
    letters = e.letters.astype(int)
    for r in docs.select("text", langid.identify(docs, (names, prototypes)).alias("p")).collect():
        s = [0, *(int(e.symbol[ord(c)]) for c in r.text or ""), 0]
        total = np.zeros(langid.DIMENSIONS, int)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            if b or (a and c):
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        if not any(s):
            assert (r.p.lang_pred, r.p.score) == ("und", 0.0)
            continue
        cosine = prototypes @ total / max(1e-9, np.linalg.norm(total))
        assert abs(r.p.score - min(1, max(0, cosine.max()))) < 1e-4 and cosine[names.index(r.p.lang_pred)] >= cosine.max() - 1e-5


def plain_odds(text: str | None, score: np.ndarray) -> float:
    folded = bytes(toxicity._FOLD[np.frombuffer((text or "").encode(), np.uint8)])
    values = []
    for word in folded.split():
        bordered, own = b" " + word + b" ", []
        for n in toxicity.GRAMS:
            for i in range(len(bordered) - n + 1):
                h = (int.from_bytes(bordered[i : i + n], "little") * 0x9E3779B97F4A7C15 + n) % 2**64
                h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
                own.append(float(score[h >> 47]))
        values.append(sum(own) / max(1, len(own)))
    n = toxicity.WINDOW
    return max((sum(values[i : i + n]) / len(values[i : i + n]) for i in range(max(1, len(values) - n + 1))), default=-np.inf) if values else -np.inf


def test_toxicity_by_plain_sums(spark, odd):  # noqa: F811
    score = np.random.default_rng(3).normal(size=toxicity.BUCKETS).astype(np.float32)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(30).union(odd.where("text IS NULL OR length(text) < 5000").select("text"))
    for r in docs.select("text", toxicity.log_odds(docs, score, "text").alias("x")).collect():
        want = plain_odds(r.text, score)
        assert r.x == want or abs(r.x - want) < 1e-5


def test_training_reads_every_window():
    texts, labels = [" ".join(f"w{i}" for i in range(100_003)), "", None, "bad words"], [0, 0, 1, 1]
    got, of = toxicity.windows_of(texts, labels)
    assert b" ".join(got).split() == " ".join(t or "" for t in texts).encode().split() and Counter(of.tolist()) == {0: 12_502, 1: 2}


def test_shards_are_even_and_contiguous(spark):
    for sf in ("sf0.001", "sf0.01"):
        got = sharding.shard(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), 10).collect()
        load, group = Counter(), Counter()
        for r in got:
            load[r.shard] += r.size
            group[r.text_crc32, r.size] += r.size
        assert len(load) == 10 and max(load.values()) - min(load.values()) <= max(group.values())
    rng = random.Random(8)
    sizes = [rng.randint(1, 90) for _ in range(500)]
    sizes[77], sizes[300] = 9_000, 4_000
    placed = sorted((r.unit, r.shard) for r in sharding.capacity_plan(spark.createDataFrame(list(enumerate(sizes)), "unit int, bytes long"), 9).collect())
    order = [77, 300, *(u for u, _ in placed if u not in (77, 300))]
    shards = [dict(placed)[u] for u in order]
    assert shards == sorted(shards) and set(shards) == set(range(9)) and shards[:2] == [0, 1] and shards[2] == 2


def test_hot_text_is_numbered_in_parts(spark):
    docs = spark.range(5_000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = sharding.shard(docs, 4, part_rows=100).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 5_000 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_vectors_too_large(spark):
    big = spark.createDataFrame([(i, [1e9, -1e9, float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        knn.top_k(big, lambda i: i % 5 == 0)
    table = [(i, [float(i * 2**18), 1.0]) for i in range(30)]  # scores beyond what doubles hold exactly
    got = knn.top_k(spark.createDataFrame(table, "vec_id long, embedding array<double>"), lambda i: i == 29, k=2, pivots=3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 28, 29 * 28 * 2**52 + 2**16), (2, 27, 29 * 27 * 2**52 + 2**16)]


def test_very_long_texts(spark):
    """Texts of 5 MB, one of them without a blank, through the operators that read whole texts."""
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(5_000)]
    long = " ".join(rng.choice(words) for _ in range(800_000))
    rows_ = [(1, long), (2, long + " with an end"), (3, "x" * 5_000_000), (4, "short and clean"), (5, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == len(long) and bytes(got[2].kept) == b" with an end" and got[3].n_removed == 0
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert judged[1].n_words == 800_000 and judged[3].word_chars == 5_000_000 and judged[1].kept and not judged[3].kept
    assert {r.doc_id: len(r.spans) for r in secrets.scan(docs).collect()} == dict.fromkeys((1, 2, 3, 4, 5), 0)
    assert sharding.shard(docs, 2).count() == 5
    assert docs.select(langid.identify(docs, (["en"], np.ones((1, langid.DIMENSIONS), np.float32)))).count() == 5
    assert docs.select(toxicity.probability(docs, (np.zeros(toxicity.BUCKETS, np.float32), 1.0, 0.0))).count() == 5


def test_ranges_grow_with_the_input(spark):
    """The runs' ranges follow from the size alone: nothing is sampled and nothing is broadcast."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = repeats([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    for anchor_bytes in (14, 0.001):
        before, suffix_dedup.BYTES_AN_ANCHOR = suffix_dedup.BYTES_AN_ANCHOR, anchor_bytes
        try:
            got = suffix_dedup.remove_repeats(table, run_bytes=50_000)
            assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got.collect()), key=repr) == want
        finally:
            suffix_dedup.BYTES_AN_ANCHOR = before


def test_hot_grams_by_windows(spark):
    """Phrases that many documents have, each in its own context, with nearly all grams hot."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    phrase, other = prose(30), prose(14)
    rows_ = [(i, prose(rng.randint(0, 30)) + " " + phrase + " " + prose(rng.randint(0, 30)) + (other + prose(9) if i % 3 == 0 else "") + ("é" * 30 + "z" * 70 if i % 7 == 0 else "")) for i in range(90)]
    rows_ += [(5, phrase), (100, phrase + phrase), (None, phrase), (101, rows_[8][1]), (102, None), (103, other)]
    table = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    before = suffix_dedup.HOT
    for hot in (1, 2, 20, 4096):
        suffix_dedup.HOT = hot
        try:
            got = suffix_dedup.remove_repeats(table, run_bytes=1_500)
            assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got.collect()), key=repr) == repeats(rows_)
        finally:
            suffix_dedup.HOT = before


def test_shared_folder_is_named_or_local(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
