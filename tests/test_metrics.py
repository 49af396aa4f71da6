"""Metrics against pandas formulas and identities."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantmere.api import Returns
from quantmere.config import config
from quantmere.functions import metrics as M
from quantmere.operators import benchmark as B
from quantmere.operators import calendar as C
from quantmere.operators import rolling as R
from quantmere.operators import summary as S
from quantmere.operators.frames import staged


def dd(r: pd.Series) -> pd.Series:
    w = (1 + r).cumprod()
    return w / w.cummax() - 1


PANDAS = {
    "total_return": lambda r: (1 + r).prod() - 1,
    "cagr": lambda r: (1 + r).prod() ** (252 / len(r)) - 1,
    "volatility": lambda r: r.std() * 252**0.5,
    "downside_volatility": lambda r: (r.clip(upper=0) ** 2).mean() ** 0.5 * 252**0.5,
    "sharpe": lambda r: r.mean() / r.std() * 252**0.5,
    "sortino": lambda r: r.mean() / (r.clip(upper=0) ** 2).mean() ** 0.5 * 252**0.5,
    "max_drawdown": lambda r: dd(r).min(),
    "ulcer_index": lambda r: ((dd(r) * 100) ** 2).mean() ** 0.5,
    "skew": lambda r: r.skew(),
    "kurtosis": lambda r: r.kurt(),
    "value_at_risk": lambda r: r.quantile(0.05),
    "cvar": lambda r: r[r <= r.quantile(0.05)].mean(),
    "omega": lambda r: r.clip(lower=0).sum() / -r.clip(upper=0).sum(),
    "win_rate": lambda r: (r > 0).mean(),
    "tail_ratio": lambda r: abs(r.quantile(0.95)) / abs(r.quantile(0.05)),
    "smart_sharpe": lambda r: r.mean() / r.std() * 252**0.5 / math.sqrt(1 + 2 * sum(r.autocorr(k) for k in (1, 2, 3))),
}


def test_scalars_match_pandas(returns, panel):
    got = staged(returns).groupBy("series").agg(*[M.SCALARS[n]().alias(n) for n in PANDAS]).toPandas().set_index("series")
    for s in panel:
        for n, f in PANDAS.items():
            assert got.loc[s, n] == pytest.approx(f(panel[s]), rel=1e-9, abs=1e-12), n


def test_nulls_are_skipped_but_counted(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1 + k), v) for k, v in enumerate([0.1, None, -0.1, 0.2])], "series string, ts timestamp, ret double")
    row = staged(df).groupBy("series").agg(M.win_rate().alias("w"), M.avg_return().alias("m"), M.exposure().alias("e")).first()
    assert row.w == pytest.approx(0.5) and row.m == pytest.approx(0.2 / 3) and row.e == 1.0


def test_degenerate_series_give_null(spark):
    one = spark.createDataFrame([("a", datetime(2024, 1, 1), 0.0)], "series string, ts timestamp, ret double")
    row = staged(one).groupBy("series").agg(*[f().alias(n) for n, f in M.SCALARS.items()]).first()
    assert row.sharpe is None and row.skew is None and row.payoff_ratio is None
    assert staged(one.limit(0)).groupBy("series").agg(M.sharpe().alias("x")).count() == 0


def test_alpha_bounds():
    with pytest.raises(ValueError):
        M.value_at_risk(1.0)


def test_normal_cdf(spark):
    zs = [-6.0, -2.5, -1.0, 0.0, 0.3, 1.96, 4.3, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", M.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * (1 + math.erf(r.z / 2**0.5)), abs=1e-12)


def test_benchmark_against_itself(returns):
    bench = returns.filter("series = 'AAA'").select("ts", F.col("ret").alias("bench"))
    row = B.benchmark_aggregates(B.with_benchmark(returns, bench)).filter("series = 'AAA'").first()
    assert row.beta == pytest.approx(1) and row.alpha == pytest.approx(0, abs=1e-12) and row.up_capture == pytest.approx(1) and row.information_ratio is None


def test_rolling_needs_full_windows(returns, panel):
    got = R.rolling_sharpe(returns, 20).filter("series = 'BBB'").toPandas().set_index("ts").sort_index()["rolling_sharpe"]
    want = panel["BBB"].rolling(20).mean() / panel["BBB"].rolling(20).std() * 252**0.5
    assert got.isna().sum() == 19
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), rtol=1e-9)


def test_drawdown_episodes(spark):
    r = [0.1, -0.2, 0.05, 0.5, -0.1, -0.1]
    df = spark.createDataFrame([("a", datetime(2024, 1, 1 + k), v) for k, v in enumerate(r)], "series string, ts timestamp, ret double")
    rows = S.drawdown_details(df).orderBy("start").collect()
    assert [str(x.start.date()) for x in rows] == ["2024-01-01", "2024-01-04"]
    assert str(rows[0].recovery.date()) == "2024-01-04" and rows[1].recovery is None
    assert rows[0].max_drawdown == pytest.approx(-0.2) and rows[1].max_drawdown == pytest.approx(0.81 - 1)
    up = S.runup_details(df).orderBy("start").collect()
    assert [str(x.peak.date()) for x in up] == ["2024-01-04"]
    s = S.streaks(df).first()
    assert (s.consecutive_wins, s.consecutive_losses) == (2, 2)


def test_calendar(returns, panel):
    got = {(r.year, r.month): r.ret for r in C.monthly_returns(returns).filter("series = 'CCC'").collect()}
    want = (1 + panel["CCC"]).groupby([panel.index.year, panel.index.month]).prod() - 1
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    per = {r.period: r.ret for r in C.period_returns(returns).filter("series = 'AAA'").collect()}
    last = panel.index[-1]
    cut = last - pd.DateOffset(months=3)
    assert per["3M"] == pytest.approx((1 + panel["AAA"][panel.index >= cut]).prod() - 1)


def test_config_overrides(returns, panel):
    with config(periods_per_year=12):
        row = Returns(returns).sharpe().filter("series = 'AAA'").first()
    assert row.sharpe == pytest.approx(panel["AAA"].mean() / panel["AAA"].std() * 12**0.5)


def test_bundle_has_one_row_per_series(returns):
    assert S.metrics_bundle(returns).count() == 3
