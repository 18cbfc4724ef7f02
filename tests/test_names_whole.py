"""File names are cleaned once a name, not once a row."""

from __future__ import annotations

from assay import registry
from tests.conftest import SF


def test_names_are_distinct_before_they_are_cleaned(spark):
    plan = registry.QUERIES["sanitize_name"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    cleaned = next(i for i, x in enumerate(lines) if "[^A-Za-z0-9._-]+" in x)
    assert any("Aggregate" in x for x in lines[cleaned + 1 :])  # parents stand first
