"""Every registered evaluation query against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime

import pytest

from assay import registry
from tests.conftest import SF


def plain(df):
    def one(v):
        if v is None or type(v).__name__ in ("NaTType", "NAType") or v != v:
            return "none"
        if isinstance(v, datetime.date | datetime.datetime) or "Timestamp" in type(v).__name__:
            return str(v)[:10]
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, row)) for row in df.astype(object).values.tolist())


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query(spark, duck, key):
    got = registry.QUERIES[key](spark, SF).toPandas()
    assert len(got)
    if key in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[key]).df()
        assert sorted(got.columns) == sorted(want.columns)
        for c in got.columns:
            if want[c].dtype.kind == "f":
                got[c] = got[c].astype(float)
            elif want[c].dtype.kind in "iu" and got[c].dtype.kind == "f":  # nulls made integers floats
                want[c] = want[c].astype(float)
            elif str(want[c].dtype).startswith("Int") or got[c].dtype.kind in "iu":
                want[c], got[c] = want[c].astype("Int64"), got[c].astype("Int64")
        assert plain(got) == plain(want)


def test_entry_is_registered():
    import __spark_entry__

    assert "operating_points" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
