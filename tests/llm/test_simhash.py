"""SimHash groups against plain fingerprints and all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import queries, simhash
from tests.conftest import SF
from tests.llm.test_llm import SCHEMA, WORD, awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text: str | None) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def grouped(rows: list[tuple]) -> list[tuple]:
    """doc_id, fingerprint, component of (doc_id, fingerprint), by all pairs."""
    prints = np.array([p for _, p in rows], np.uint64)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4).tolist():
            a, b = root[i], root[j]
            if a != b:
                root = [a if r == b else r for r in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return sorted(((d, f"{p:016x}", least[root[k]]) for k, (d, p) in enumerate(rows)), key=repr)


def test_query_by_all_pairs(spark):
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op12_simhash(spark, SF).collect()), key=repr)
    assert got == grouped(docs)
    assert any(d != c for d, _, c in got)


def test_awkward_rows(spark, tmp_path):
    spark.createDataFrame(awkward(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_simhash(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == grouped([(r[0], plain(r[1])) for r in awkward()])
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_simhash(spark, f"{tmp_path}/none").count() == 0


def test_hash_is_sparks(spark):
    texts = ["a", "é 🙂 x", "one two three four", "x" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert [r.h & (1 << 64) - 1 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_long_texts_count_in_blocks():
    rng = random.Random(4)
    text = " ".join(rng.choice(["a", "bb", "Ccc", "dé"]) + str(rng.randrange(50)) for _ in range(150_000))
    other = "one two\n three"
    raw = (text + other).encode()
    got = simhash.fingerprints(np.frombuffer(raw, np.uint8), np.array([0, len(text.encode()), len(raw), len(raw)]))
    assert got.tolist() == [plain(text), plain(other), 0]


@pytest.mark.parametrize("blocks", [("golay", "golay"), ("golay", "golay", "hamming")])
def test_near_prints_meet(blocks):
    rng = random.Random(6)
    x = [rng.getrandbits(64) for _ in range(1500)]
    y = [v ^ sum(1 << b for b in rng.sample(range(64), k % 5)) for k, v in enumerate(x)]
    of_x, of_y = (set(zip(*(part.tolist() for part in simhash.anchors(np.array(v, np.uint64), blocks, 4)), strict=True)) for v in (x, y))
    assert {who for who, _ in of_x & of_y} == set(range(1500))


def components_of(links) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("large", [4096, 16])
def test_dense_families(spark, monkeypatch, large):
    """Many distinct fingerprints around one, at few anchors; also dealt to anchors over rotated bits."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(3000)})
    array = np.array(prints, np.uint64)
    want = components_of((prints[i], prints[j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(array[i:] ^ array[i]) <= 4) + i if i != j)
    who, cell = simhash.anchors(array, ("golay", "golay"), 4)
    order = np.argsort(cell, kind="stable")
    found = simhash.links_at(cell[order], array[who[order]], 4, ("golay", "golay"))
    assert components_of((a, b) for x, y in found for a, b in zip(x.tolist(), y.tolist(), strict=True)) == want
    table = spark.createDataFrame([(v - (1 << 64) * (v >> 63),) for v in prints], "print long")
    got = simhash.links(table, len(prints)).collect()
    assert components_of((r.a % (1 << 64), r.b % (1 << 64)) for r in got) == want


def test_other_ids_and_names(spark):
    rows = [("b", "one two three four five", 1), ("a", "one two three four five", 2), ("c", "other words stand in here", 3)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "name string, body string, print int"), "name", "body").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [("a", "a"), ("b", "a"), ("c", "c")]
