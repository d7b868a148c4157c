"""Vector neighbours by cells against all pairs, and how many cells a query opens."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import cells

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k):
    out = set()
    unit = {i: np.array(e) / (np.linalg.norm(e) or 1.0) for i, e in rows}
    for q in queries:
        best = sorted((-round(float(unit[q] @ v), 6) + 0.0, i) for i, v in unit.items() if i != q)[:k]
        out |= {(q, r + 1, i) for r, (_, i) in enumerate(best)}
    return out


def told(found):
    return {(r.query_id, r["rank"], r.vec_id) for r in found.collect()}


@pytest.fixture(scope="module")
def clustered():
    """Vectors around 20 well parted centres, a third of them one and the same, some zero."""
    rng = np.random.default_rng(3)
    centres = np.eye(24)[:20] * 5
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.05, 24)).round(4).tolist()) for i in range(600)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(300)]
    return [*rows, *((2000 + i, [0.0] * 24) for i in range(5))]


def test_equals_all_pairs(spark, clustered):
    rows = spark.createDataFrame(clustered, SCHEMA)
    queries = [i for i, _ in clustered if i % 20 == 0]
    index = cells.build(rows)
    assert told(cells.search(index, rows.where("vec_id % 20 = 0"), 6)) == brute(clustered, queries, 6)


def test_a_filter_comes_before_the_cells(spark, clustered):
    rows = spark.createDataFrame(clustered, SCHEMA)
    kept = [(i, e) for i, e in clustered if i % 3 == 0]
    queries = [i for i, _ in kept if i % 60 == 0]
    index = cells.kept(cells.build(rows), rows.where("vec_id % 3 = 0").select("vec_id"))
    assert told(cells.search(index, rows.where("vec_id % 60 = 0"), 4)) == brute(kept, queries, 4)


def test_few_cells_are_opened(spark, clustered):
    rows = spark.createDataFrame(clustered, SCHEMA)
    index, queries = cells.build(rows), rows.where("vec_id % 20 = 0 AND vec_id < 1000")
    k, some = 5, queries.count()
    every = index.vectors.select("cell").distinct().count()
    best = cells.search(index, queries, k).groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("score"))
    read = cells.opened(index, queries, k).count() + cells.opened(index, queries, k, best).count()
    assert every >= 10 and read <= 0.5 * every * some


def test_odd_vectors_and_few(spark):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0])], SCHEMA)
    assert told(cells.search(cells.build(odd), odd, 9)) == {(1, 1, 2), (1, 2, 6), (2, 1, 1), (2, 2, 6), (6, 1, 1), (6, 2, 2)}
    none = spark.createDataFrame([], SCHEMA)
    assert told(cells.search(cells.build(none), odd, 3)) == set()
