"""Questions against blocks in rounds that exchange a bounded number of pairs: the same answers as in one."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from factloom.operators import index, tallies
from factloom.operators.lineage import cut, drop
from tests import test_retrieval, test_tallies


def test_index_in_rounds(spark, monkeypatch):
    rounds, kth = [], index._kth
    monkeypatch.setattr(index, "ROUND", 10)
    monkeypatch.setattr(index, "MOST_ASKS", 16)
    monkeypatch.setattr(index, "_kth", lambda found, k: rounds.append(k) or kth(found, k))
    test_retrieval.test_blocks_are_pruned_and_nothing_is_lost(spark, 50)
    assert len(rounds) > 3


def test_tallies_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(tallies, "ROUND", 200)
    test_tallies.test_best_equal_all_pairs(spark, 5000)


def test_written_tables_and_their_shuffles_go(spark):
    table = cut(spark.range(50).repartition(3, F.col("id") % 7))
    path = spark._jvm.java.net.URI(table.inputFiles()[0]).getPath()
    assert os.path.exists(path) and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    drop(table)
    assert not os.path.exists(path)
