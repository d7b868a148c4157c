"""Rows updated in place, against a plain loop over the log."""

from __future__ import annotations

import json
import random

from factloom.sources import sinks

OLD = [(1, "a", 1.0, "draft", '{"x": 1, "deep": {"y": [1, 2]}}'), (2, "b", None, "draft", None), (3, "c", 3.0, "closed", "[1, 2]"), (4, "d", 4.0, "draft", '{"kept": null, "q\\"uote": "5"}'), (5, "e", 5.0, "draft", "no json")]
SCHEMA = "id long, name string, score double, status string, props string"


def test_patches_as_a_loop_does(spark):
    rng = random.Random(7)
    values = ["1", '"1"', "null", "[3]", '{"z": 0}', "true"]
    log = [(rng.choice([1, 1, 1, 2, 3, 4, 9]), t, rng.choice([None, float(t)]), rng.choice([None, "draft", "accepted", "rejected"]), rng.choice([None, f'{{"{rng.choice(["x", "n", "deep"])}": {rng.choice(values)}}}', "[]"])) for t in range(60)]
    want = {r[0]: [*r[:4], json.loads(r[4]) if r[4] and r[4][0] in "[{" else r[4]] for r in OLD}
    for i, _, score, status, props in log:
        if i not in want:
            continue
        row, new = want[i], json.loads(props) if props else {}
        row[2] = row[2] if score is None else score
        row[3] = status if status and row[3] == "draft" else row[3]
        if isinstance(new, dict) and new:
            row[4] = {**(row[4] if isinstance(row[4], dict) else {}), **new}
    changes = spark.createDataFrame([(*r, "renamed") for r in log + log[:5]], "id long, t int, score double, status string, props string, name string")
    got = sinks.patched(spark.createDataFrame(OLD, SCHEMA), changes, ["id"], ["t"], ["score"], "props", {"status": "draft"})
    assert got.columns == ["id", "name", "score", "status", "props"]
    rows = {r.id: [*r[:4], json.loads(r.props) if r.props and r.props[0] in "[{" else r.props] for r in got.collect()}
    assert rows == want


def test_no_changes_and_no_rows(spark):
    old = spark.createDataFrame(OLD, SCHEMA)
    changes = spark.createDataFrame([], "id long, t int, score double, status string, props string")
    same = sinks.patched(old, changes, ["id"], ["t"], ["score"], "props", {"status": "draft"})
    assert sorted(map(tuple, same.collect()), key=lambda r: r[0]) == OLD
    assert sinks.patched(old.limit(0), changes, ["id"], ["t"], ["score"]).count() == 0
