"""Periodic runs against brute force over every period."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from factloom.llm import periodic, queries
from tests.conftest import SF
from tests.llm.test_llm import SCHEMA, WORD, awkward


def brute(w: list[str], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period; every period tried at every place."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            smaller = any(all(w[k] == w[k + d] for k in range(a, i + q - d)) for d in range(1, q) if q % d == 0)
            if i + q - a >= max(least, times * q) and not smaller:
                out.append((a, i + q - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def runs_of(words: list, **kw) -> list[tuple]:
    text = " ".join(words).encode()
    return [(a, b - a, q) for a, b, q in periodic.runs_of_texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), **kw)[2].tolist()]


@pytest.mark.parametrize("limits", [(6, 4), (4, 2), (6, 3)])
def test_runs_by_brute_force(limits):
    rng = random.Random(3)
    for t in range(1500):
        n, letters = rng.randint(0, 70), "abc"[: rng.randint(1, 3)]
        w = [rng.choice(letters) for _ in range(n)]
        if t % 3 == 0 and n > 8:
            a, p = rng.randrange(n - 1), rng.randint(1, 6)
            w = [w[i] if i < a else w[a + (i - a) % min(p, n - a)] for i in range(n)]
        assert runs_of(w, least=limits[0], times=limits[1]) == brute(w, *limits)


def test_words_beside_one_another_in_other_texts_make_no_run():
    text = b"a a a a a" * 3
    n, doc, runs = periodic.runs_of_texts(np.frombuffer(text, np.uint8), np.array([0, 9, 18, 27]))
    assert n.tolist() == [5, 5, 5] and not len(runs)


def test_hashes_that_agree_by_construction():
    """Hashes modulo a power of two call these equal whatever the words are; they are told apart word by word."""
    thue = ["ab"[bin(i).count("1") % 2] for i in range(1 << 13)]
    other = ["ba"["ab".index(c)] for c in thue]
    w = thue + other + thue + thue + thue + thue + other
    assert runs_of(w) == [r for r in brute_at(w, [1, 2, 1 << 13])]


def brute_at(w: list[str], periods: list[int]) -> list[tuple]:
    x, out = np.array(w), []
    for q in periods:
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        out += [(a, b - a + q, q) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a + q >= max(6, 4 * q)]
    return sorted(out)


def test_long_texts_take_no_quadratic_time():
    began = time.perf_counter()
    assert runs_of(["a", "b"] * 300_000) == [(0, 600_000, 2)]
    a, b = "a", "ab"
    while len(b) < 200_000:
        a, b = b, b + a
    assert runs_of(list(b)) == [] and len(runs_of(list(b), times=3)) > 10_000
    assert time.perf_counter() - began < 60


def expected(doc_id, text) -> tuple:
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w) if n < 3000 else runs_of(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{k},{q}\n" for a, k, q in runs)
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def test_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_periodic(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(expected(*r) for r in docs.items())
    assert sum(r.n_runs for r in got) > 5


def test_awkward_rows(spark, tmp_path):
    table = awkward() + [(i, "x y z " * k + "end", None, None, None, None, None) for i, k in enumerate([1, 2, 3, 4, 5, 9, 400] * 9, 100)]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(r[0], r[1]) for r in table), key=repr)
    assert queries.op11_periodic(spark, str(tmp_path)).where("runs_sha256 IS NULL OR collapsed_sha256 IS NULL").count() == 0


def test_clashing_names_very_long_and_empty(spark):
    long = spark.createDataFrame([("a b c " * 1_000_000, 1, "r", None)], "text string, n_words int, runs string, extra string")
    r = periodic.find_runs(long).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.extra) == (3_000_000, [(0, 3_000_000, 3)], "a b c", None)
    both = periodic.find_runs(long, prefix="own_")
    assert both.columns == ["text", "n_words", "runs", "extra", "own_n_words", "own_runs", "own_collapsed"] and both.first().runs == "r"
    assert periodic.find_runs(long.limit(0)).count() == 0
