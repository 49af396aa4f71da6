"""The driver contract: names agree, oracles agree on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["sharpe", "drawdown_details", "resample", "asof_flows", "corr_spearman", "study_horizons", "wilder_atr", "store_upsert"])
def test_oracle(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(e.oracle_sql()[name]).fetchdf()
    got = e.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert got[c].sum() == pytest.approx(want[c].astype(float).sum(), rel=1e-5, abs=1e-4), c
