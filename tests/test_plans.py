"""Plans that must not grow: scans by column, two-level ranks, lines of all runs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantmere.functions import formations as L
from quantmere.operators import calendar as C
from quantmere.operators import eda as E
from quantmere.operators import indicators as I
from quantmere.operators import indicators_more as M  # noqa: F401  (registers them)


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    path = str(tmp_path_factory.mktemp("cells") / "x")
    spark.createDataFrame(pd.DataFrame({c: rng.integers(0, 30, 400).astype(float) for c in "abcd"})).write.parquet(path)
    return spark.read.parquet(path)


def test_spearman_scans_grow_with_the_columns_only(cells):
    assert [scans(E.spearman(cells, list("abcd"[:n]))) for n in (2, 3, 4)] == sorted(scans(E.spearman(cells, list("abcd"[:n]))) for n in (2, 3, 4))
    assert scans(E.spearman(cells)) <= 3 * 4 + 1
    want = cells.toPandas().corr("spearman")
    for r in E.spearman(cells).collect():
        assert r["corr"] == pytest.approx(want.loc[r.a, r.b])


def test_drift_reads_each_frame_once_for_a_pass(cells):
    low, high = cells.filter("a < 15"), cells.filter("a >= 15")
    assert scans(E.drift(low, high, ["b"])) == scans(E.drift(low, high, ["b", "c", "d"]))


def test_ranks_inside_keys(cells):
    got = {(r.a, r.b): r.b__rank for r in E.ranks_of(cells.select("a", "b"), "b", "a").collect()}
    want = cells.toPandas()
    want["r"] = want.groupby("a")["b"].rank()
    assert got == {(r.a, r.b): r.r for r in want.itertuples()}


def test_numbered(cells):
    rows = cells.select("a", "b").distinct()
    got = [(r.a, r.b) for r in E.numbered(rows, "a", "b").orderBy("row_no").collect()]
    assert got == sorted(got) and len(got) == rows.count()


def test_distinct_counts(cells):
    stats = {r["column"]: r.distinct for r in E.column_stats(cells.withColumn("e", F.lit(None).cast("string"))).collect()}
    assert stats == {c: cells.select(c).distinct().count() for c in "abcd"} | {"e": 0}


def test_daily_cadence_takes_the_first_bar_of_each_step(spark):
    days = pd.to_datetime(["2024-01-01 09:00", "2024-01-01 17:00", "2024-01-02 08:00", "2024-01-02 10:00", "2024-01-05 09:00"])
    out = C.cadence_triggers(spark.createDataFrame(pd.DataFrame({"ts": days})), "daily")
    assert sorted(r.ts for r in out.collect()) == [days[0].to_pydatetime(), days[3].to_pydatetime(), days[4].to_pydatetime()]


def test_lines_of_all_runs():
    rng = np.random.default_rng(3)
    at = np.sort(rng.choice(400, 40, replace=False))
    p = L.Pivots(at, 100 + rng.normal(0, 5, 40), np.where(np.arange(40) % 2, 1, -1))
    s = L.spans(p, 1, 2)
    seen = list(s.runs(np.ones_like(s.able)))
    assert len(seen) == int(s.able.sum())
    for i, j in np.argwhere(s.able):
        own, other = s.main[i : j + 1], s.other[s.lo[i] : s.hi[j]]
        for k, some in enumerate((own, other)):
            line = L.fit(p.at[some], p.price[some], True)
            assert s.at_start[k][i, j] == pytest.approx(line(p.at[own[0]])) and s.at_end[k][i, j] == pytest.approx(line(p.at[own[-1]]))
            assert s.tilt[k][i, j] == pytest.approx(line.slope / p.price[some].mean(), abs=1e-12)


@pytest.mark.parametrize("name", I.list_indicators())
def test_every_indicator_keeps_the_bars(bars, name):
    out = I.indicator(name, bars, **({"n": 10} if name in ("tema", "trix") else {})).toPandas()
    values = [c for c in out.columns if c not in ("asset", "ts")]
    assert len(out) == 100 and out[values].notna().any().all()


def test_recursive_indicators_by_their_definitions(spark):
    n = 60
    close = 100 + np.cumsum(np.sin(np.arange(n)))
    rows = [((pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)).to_pydatetime(), "A", float(c), float(c + 1), float(c - 1), float(c), 1000.0) for k, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "ts timestamp, asset string, open double, high double, low double, close double, volume double")
    kama = I.indicator("kama", bars).orderBy("ts").toPandas()["kama"].to_numpy()
    value = close[9]
    for t in range(10, n):
        path = sum(abs(close[k] - close[k - 1]) for k in range(t - 9, t + 1))
        rate = (abs(close[t] - close[t - 10]) / path * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        value += rate * (close[t] - value)
        assert kama[t] == pytest.approx(value)
    s = I.indicator("stochrsi", bars).toPandas()
    assert s["fastk"].dropna().between(0, 100).all()
    sar = I.indicator("sar", bars).orderBy("ts").toPandas()["sar"].to_numpy()
    assert np.isnan(sar[0]) and (np.abs(sar[1:] - close[1:]) < 15).all()
