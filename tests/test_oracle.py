"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

from conftest import SF01

from rookery.plans.catalog import catalog
from rookery.plans.verify import compare

KEYS = sorted(catalog())
ORACLE_KEYS = [k for k in KEYS if catalog()[k].oracle is not None]
ROWS_ONLY = [k for k in KEYS if catalog()[k].oracle is None]


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_query_matches_oracle(spark, duck, key):
    q = catalog()[key]
    got = q.build(spark, SF01).toPandas()
    want = duck.execute(q.oracle_text()).df()
    assert compare(got, want) == []


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_rows_only_query_runs(spark, key):
    df = catalog()[key].build(spark, SF01)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    rows = e.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"result", "count", "pct"}
    assert set(e.oracle_sql()) <= set(e.queries())
