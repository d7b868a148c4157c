"""Question rules on texts beyond ASCII, against their SQL."""

from __future__ import annotations

import os
import shutil

import pytest

from factloom.plans import catalog
from tests.conftest import SF
from tests.oracle import rows, sql_rows

ODD = ("Los ídoes son muchos", "ABÉ CEOÉ ÉAB ISO27001É", "who ! what we do  , team", "\r hello", 'say "  quoted é text " now', "What\x0bis the éSL2000é plan of ISO 27001", "renewé the Gold Plan", "", None)


@pytest.mark.parametrize("name", ["ask_gate", "f02_secret_guard", "f10_evidence_shape", "r06_distinctive_terms", "r07_required_terms"])
def test_odd_questions(spark, tmp_path, name):
    for f in os.listdir(SF):
        if f.endswith(".parquet") and f != "conversations.parquet":
            shutil.copy(f"{SF}/{f}", tmp_path)
    told = [(i, 1, "user", t) for i, t in enumerate(ODD)]
    spark.createDataFrame(told, "conv_id long, turn int, role string, text string").toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    assert rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == sql_rows(catalog.ORACLE_SQL[name], str(tmp_path))
