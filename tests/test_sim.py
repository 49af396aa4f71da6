"""The fold bar by bar, on literal bars."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantmere.operators import sim as X
from quantmere.operators.strategies import DCA, Hold, triggers

DAYS = list(pd.date_range("2024-01-02", periods=8))


def panel(rows):
    a = np.array(rows, float)
    return {f: a[:, [k]] for k, f in enumerate(("open", "high", "low", "close"))}


def run(rows, orders, **models):
    fold = X.Fold(costs=models.get("costs", X.NoCost()), slippage=models.get("slippage", X.NoSlippage()), execution=models.get("execution", X.NextBarOpen()), cash=1000.0)
    by = {}
    for i, o in orders:
        by.setdefault(i, []).append(o)
    out = fold.run(DAYS[: len(rows)], ["BTC"], panel(rows), lambda b: by.get(b.index, ()))
    pick = lambda k: [r for r in out if r[0] == k]
    return pick("trade"), pick("equity"), pick("order")


FLAT = [(100, 101, 99, 100)] * 4


def test_fill_next_open_with_costs():
    trades, equity, orders = run(FLAT, [(0, X.Order("BTC", "buy", qty=2))], costs=X.FixedBps(10), slippage=X.HalfSpread(20))
    assert trades[0][1] == 1 and trades[0][6] == pytest.approx(100.1)
    assert equity[1][9] == pytest.approx(1000 - 2 * 100.1 - 2 * 100.1 * 1e-3 + 200)
    assert orders[0][-1] is True


def test_last_bar_orders_never_fill():
    trades, _, orders = run(FLAT, [(3, X.Order("BTC", "buy", qty=1))])
    assert not trades and orders[0][-1] is False


def test_limit_is_checked_after_slippage():
    o = X.Order("BTC", "buy", qty=1, kind="limit", limit_price=100.0)
    assert not run(FLAT, [(0, o)], slippage=X.HalfSpread(20))[0]
    assert run(FLAT, [(0, o)])[0]


def test_stop_loss_gap_fills_at_open():
    rows = [(100, 101, 99, 100), (100, 101, 99, 100), (90, 95, 85, 92), (92, 93, 91, 92)]
    trades, _, _ = run(rows, [(0, X.Order("BTC", "buy", qty=1, sl_stop=0.05))])
    assert [(t[1], t[6], t[10]) for t in trades] == [(1, 100, "signal"), (2, 90, "stop_loss")]


def test_stop_beats_target_in_one_bar():
    rows = [(100, 101, 99, 100), (100, 101, 99, 100), (100, 120, 90, 100)]
    trades, _, _ = run(rows, [(0, X.Order("BTC", "buy", qty=1, sl_stop=0.05, tp_stop=0.1))])
    assert trades[1][10] == "stop_loss" and trades[1][6] == pytest.approx(95)


def test_trailing_stop_ratchets_after_the_check():
    rows = [(100, 101, 99, 100), (100, 110, 100, 109), (109, 111, 104, 105), (105, 106, 99, 100)]
    trades, _, _ = run(rows, [(0, X.Order("BTC", "buy", qty=1, tsl_stop=0.05))])
    # anchor 110 after bar 1: level 104.5, bar 2 touches it
    assert trades[1][1] == 2 and trades[1][6] == pytest.approx(104.5) and trades[1][10] == "trailing_stop"


def test_short_bracket_mirrors():
    rows = [(100, 101, 99, 100), (100, 101, 99, 100), (100, 107, 99, 104)]
    trades, _, _ = run(rows, [(0, X.Order("BTC", "sell", qty=1, sl_stop=0.05))])
    assert trades[1][6] == pytest.approx(105) and trades[1][5] == pytest.approx(1)


def test_same_bar_fill_is_refused():
    class Now(X.NextBarOpen):
        def fill_at(self, bar):
            return bar

    with pytest.raises(ValueError):
        run(FLAT, [(0, X.Order("BTC", "buy", qty=1))], execution=Now())


@pytest.mark.parametrize("bad", [dict(side="hold", qty=1), dict(side="buy"), dict(side="buy", qty=1, notional=1), dict(side="buy", qty=1, kind="limit"), dict(side="buy", qty=1, sl_stop=1.5)])
def test_orders_are_checked(bad):
    with pytest.raises(ValueError):
        X.Order("BTC", **bad)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["buy", "sell"]), st.floats(0.1, 5)), max_size=8))
def test_equity_is_cash_plus_holdings(orders):
    rows = [(100 + k, 102 + k, 98 + k, 101 + k) for k in range(8)]
    trades, equity, _ = run(rows, [(i, X.Order("BTC", side, qty=q)) for i, side, q in orders])
    cash = 1000 - sum(t[5] * t[6] for t in trades)
    assert equity[-1][9] == pytest.approx(cash + sum(t[5] for t in trades) * 108)


def test_runs_are_independent(spark, bars):
    w = spark.createDataFrame([("a", datetime(2022, 1, 3), "AAA", 1.0), ("b", datetime(2022, 1, 3), "BBB", 0.5)], "run_id string, ts timestamp, asset string, weight double")
    res = X.Simulator(bars, costs=X.NoCost()).run_weights(w)
    assert {(r.run_id, r.asset) for r in res.trades.collect()} == {("a", "AAA"), ("b", "BBB")}
    assert res.equity.filter("run_id = 'a'").count() == 50


def test_signals_and_strategies(spark, bars):
    sig = bars.selectExpr("ts", "asset", "dayofweek(ts) = 2 AS entry", "dayofweek(ts) = 5 AS exit")
    assert X.Simulator(bars).run_signals(sig, size=0.2).trades.count() > 5
    assert X.Simulator(bars).run_strategy(Hold(weights={"AAA": 0.6, "BBB": 0.4})).trades.count() == 2
    dca = X.Simulator(bars, costs=X.NoCost()).run_strategy(DCA(amount=100.0, horizon="weekly"))
    assert dca.orders.count() == 2 * 10


def test_triggers():
    days = list(pd.bdate_range("2024-01-01", periods=60))
    assert len(triggers(days, "monthly", day=31)) == 3 and max(triggers(days, "monthly", day=31)).day == 22
    assert len(triggers(days, "weekly")) == 12
