"""Facts of titles and of questions come before their pairs."""

from __future__ import annotations

from factloom.plans import catalog
from tests.conftest import SF


def test_titles_are_read_once(spark):
    """Paths, names and the questions' words are computed below the join, not for each pair."""
    plan = catalog.QUERIES["r14_title_bonus"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join ")]
    for fact in ("RLIKE", ".pdf", "regexp_replace", "regexp_extract_all"):
        assert fact not in above
    assert "RLIKE" in plan and ".pdf" in plan
