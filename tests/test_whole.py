"""Registered queries over all rows of their tables."""

from __future__ import annotations

import pytest

from assay import registry
from tests.conftest import SF
from tests.test_registry import plain

CHECKS = "derive_status verdict exit_code best_run dashboard_counts module_counts combine_axis compare_rows primary_check merge_findings scan_counts gate_block config_diff".split()


@pytest.mark.parametrize("key", CHECKS)
def test_checks_are_all_lines(spark, duck, key):
    """Against the registered SQL without its clause that keeps a seventh of the orders."""
    sql = registry.ORACLE_SQL[key].replace(" WHERE l_orderkey % 7 = 0", "")
    got, want = registry.QUERIES[key](spark, SF).toPandas(), duck.execute(sql).df()
    for c in got.columns:
        if want[c].dtype.kind == "f" or got[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
        elif got[c].dtype.kind in "iu":
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    assert plain(got) == plain(want)


def test_no_line_is_left_out(spark, duck):
    got = registry.QUERIES["derive_status"](spark, SF).agg({"n_checks": "sum"}).first()[0]
    assert got == duck.execute("SELECT count(*) FROM lineitem").fetchone()[0]


@pytest.mark.parametrize("key, cut", [("log_confidence", " AND score < 0.95"), ("predict", " HAVING abs(sum(n.value)) > 1e-9")])
def test_top_scores_and_ties_stay(spark, duck, key, cut):
    """Against the registered SQL without its clause that drops them, and with the decision on a rounded sum."""
    sql = registry.ORACLE_SQL[key].replace(cut, "").replace("exp(-sum(n.value))", "exp(-round(sum(n.value), 9))")
    got, want = registry.QUERIES[key](spark, SF).toPandas(), duck.execute(sql).df()
    assert len(got) == len(want) and plain(got) == plain(want)
