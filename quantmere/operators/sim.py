"""Backtests: a deterministic fold over bars, one run per group, runs in parallel.

A run shares cash across its assets, so its bars are folded in order in one
grouped-map call; parameter grids and strategies spread over the cluster by
``run_id``.  The fold is one loop: fill what was queued, check brackets inside
the bar, ask the decider for orders, mark to market.  Weights, signals, order
lists and strategies differ only in their decider.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CostModel(Protocol):
    def fee(self, price: float, qty: float) -> float: ...


class SlippageModel(Protocol):
    def apply(self, price: float, side: str) -> tuple[float, float]: ...


class ExecutionModel(Protocol):
    def fill_at(self, bar: int) -> int: ...

    def reference(self, bar: dict[str, float]) -> float: ...


@dataclass(frozen=True)
class NoCost:
    def fee(self, price: float, qty: float) -> float:
        return 0.0


@dataclass(frozen=True)
class FixedBps:
    bps: float = 5.0
    minimum: float = 0.0

    def fee(self, price: float, qty: float) -> float:
        return max(self.minimum, abs(price * qty) * self.bps * 1e-4)


@dataclass(frozen=True)
class PerShare:
    rate: float = 0.005
    minimum: float = 1.0

    def fee(self, price: float, qty: float) -> float:
        return max(self.minimum, abs(qty) * self.rate)


@dataclass(frozen=True)
class NoSlippage:
    def apply(self, price: float, side: str) -> tuple[float, float]:
        return price, 0.0


@dataclass(frozen=True)
class HalfSpread:
    spread_bps: float = 2.0

    def apply(self, price: float, side: str) -> tuple[float, float]:
        half = self.spread_bps / 2
        return price * (1 + (half if side == "buy" else -half) * 1e-4), half


@dataclass(frozen=True)
class NextBarOpen:
    def fill_at(self, bar: int) -> int:
        return bar + 1

    def reference(self, bar: dict[str, float]) -> float:
        return bar["open"]


@dataclass(frozen=True)
class NextBarClose:
    def fill_at(self, bar: int) -> int:
        return bar + 1

    def reference(self, bar: dict[str, float]) -> float:
        return bar["close"]


@dataclass(frozen=True)
class Order:
    """One instruction: exactly one of qty and notional; stops are fractions of the fill price."""

    asset: str
    side: str
    qty: float | None = None
    notional: float | None = None
    kind: str = "market"
    limit_price: float | None = None
    sl_stop: float | None = None
    tp_stop: float | None = None
    tsl_stop: float | None = None

    def __post_init__(self) -> None:
        if self.side not in ("buy", "sell"):
            raise ValueError("side is 'buy' or 'sell'")
        if (self.qty is None) == (self.notional is None):
            raise ValueError("exactly one of qty and notional")
        if self.kind not in ("market", "limit"):
            raise ValueError("kind is 'market' or 'limit'")
        if self.kind == "limit" and self.limit_price is None:
            raise ValueError("a limit order needs a price")
        for name, top in (("sl_stop", 1.0), ("tsl_stop", 1.0), ("tp_stop", math.inf)):
            v = getattr(self, name)
            if v is not None and not 0 < v < top:
                raise ValueError(f"{name} out of range")


@dataclass
class Position:
    qty: float = 0.0
    cost: float = 0.0
    last: float = math.nan
    stop: float | None = None
    target: float | None = None
    trail: float | None = None
    anchor: float = 0.0

    def clear(self) -> None:
        self.qty = self.cost = self.anchor = 0.0
        self.stop = self.target = self.trail = None


def _ok(x: float | None) -> bool:
    return x is not None and math.isfinite(x) and x > 0


@dataclass
class Book:
    """Cash and positions of a run at one bar; what deciders see."""

    assets: list[str]
    cash: float
    positions: dict[str, Position] = field(default_factory=dict)
    ts: object = None
    bar: dict[str, dict[str, float]] = field(default_factory=dict)
    index: int = 0

    def __post_init__(self) -> None:
        self.positions = {a: Position() for a in self.assets}

    def close(self, asset: str) -> float | None:
        x = self.bar.get(asset, {}).get("close", math.nan)
        return x if _ok(x) else None

    def qty(self, asset: str) -> float:
        return self.positions[asset].qty

    def value(self, asset: str) -> float:
        """Value at the close, else at the last price, else at cost."""
        p = self.positions[asset]
        if not p.qty:
            return 0.0
        price = next((x for x in (self.close(asset), p.last, p.cost) if _ok(x)), None)
        return p.qty * price if price else 0.0

    def equity(self) -> float:
        return self.cash + sum(self.value(a) for a in self.assets)


Decider = Callable[[Book], Iterable[Order]]


@dataclass
class Fold:
    """The loop and what it records."""

    costs: CostModel = field(default_factory=FixedBps)
    slippage: SlippageModel = field(default_factory=NoSlippage)
    execution: ExecutionModel = field(default_factory=NextBarOpen)
    cash: float = 1_000_000.0

    def run(self, times: list, assets: list[str], panel: dict[str, np.ndarray], decide: Decider) -> list[tuple]:
        """Rows (kind, bar, ts, asset, side, qty, price, fee, slippage_bps, value, reason, filled)."""
        book = Book(assets, self.cash)
        queue: dict[int, list[tuple[int, Order]]] = {}
        out: list[tuple] = []
        orders: list[list] = []
        for i, ts in enumerate(times):
            book.ts, book.index = ts, i
            book.bar = {a: {f: float(panel[f][i, j]) for f in ("open", "high", "low", "close")} for j, a in enumerate(assets)}
            for number, order in queue.pop(i, ()):
                orders[number][-1] = self._fill(book, order, i, ts, out)
            self._brackets(book, i, ts, out)
            for order in decide(book):
                if order.asset not in book.positions:
                    continue
                orders.append(["order", i, ts, order.asset, order.side, order.qty, order.limit_price, None, None, order.notional, order.kind, False])
                at = self.execution.fill_at(i)
                if at <= i:
                    raise ValueError("an order can't fill on the bar that gives it")
                if at < len(times):
                    queue.setdefault(at, []).append((len(orders) - 1, order))
            for a in assets:
                if (c := book.close(a)) is not None:
                    book.positions[a].last = c
            equity = book.equity()
            out.append(("equity", i, ts, None, None, None, None, None, None, equity, None, None))
            if equity:
                out += [("weight", i, ts, a, None, book.qty(a), None, None, None, v / equity, None, None) for a in assets if (v := book.value(a))]
        return out + [tuple(o) for o in orders]

    def _book(self, book: Book, asset: str, signed: float, price: float, slip: float, i: int, ts, reason: str, out: list[tuple]) -> float:
        fee = self.costs.fee(price, signed)
        book.cash -= signed * price + fee
        book.positions[asset].last = price
        out.append(("trade", i, ts, asset, "buy" if signed > 0 else "sell", signed, price, fee, slip, signed * price, reason, None))
        return fee

    def _fill(self, book: Book, order: Order, i: int, ts, out: list[tuple]) -> bool:
        ref = self.execution.reference(book.bar[order.asset])
        if not _ok(ref):
            return False
        qty = order.qty if order.qty and order.qty > 0 else (order.notional or 0) / ref
        if not qty > 0:
            return False
        price, slip = self.slippage.apply(ref, order.side)
        buy = order.side == "buy"
        if order.kind == "limit" and _ok(order.limit_price) and (price > order.limit_price if buy else price < order.limit_price):
            return False
        signed = qty if buy else -qty
        p = book.positions[order.asset]
        before, after = p.qty, p.qty + signed
        adds = before == 0 or (before > 0) == buy
        if buy and after > 0:
            p.cost = (before * p.cost + signed * price) / after
        p.qty = after
        self._book(book, order.asset, signed, price, slip, i, ts, "signal", out)
        if after == 0:
            p.clear()
        elif adds:
            side = 1 if after > 0 else -1
            if order.sl_stop:
                p.stop = price * (1 - side * order.sl_stop)
            if order.tp_stop:
                p.target = price * (1 + side * order.tp_stop)
            if order.tsl_stop and p.trail is None:
                p.trail, p.anchor = order.tsl_stop, price
        return True

    def _brackets(self, book: Book, i: int, ts, out: list[tuple]) -> None:
        for asset, p in book.positions.items():
            if not p.qty or (p.stop is None and p.target is None and p.trail is None):
                continue
            b = book.bar[asset]
            # seen from the position: a short is a long in the mirrored market
            s = 1 if p.qty > 0 else -1
            o, worst, best = (s * b["open"], s * b["low"], s * b["high"]) if s > 0 else (-b["open"], -b["high"], -b["low"])
            if not all(map(math.isfinite, (o, worst, best))):
                continue
            exits: list[tuple[float, str]] = []
            if p.stop is not None and worst <= s * p.stop:
                exits.append((min(o, s * p.stop), "stop_loss"))
            if p.trail is not None:
                anchor = max(s * p.anchor, o)
                level = anchor * (1 - p.trail) if s > 0 else anchor * (1 + p.trail)
                if worst <= level:
                    exits.append((min(o, level), "trailing_stop"))
                else:
                    anchor = max(anchor, best)
                p.anchor = s * anchor
            if exits:
                price, reason = max(exits, key=lambda e: (e[0], e[1] == "trailing_stop"))  # the tighter stop
            elif p.target is not None and best >= s * p.target:
                price, reason = max(o, s * p.target), "take_profit"
            else:
                continue
            qty = p.qty
            fill, slip = self.slippage.apply(s * price, "sell" if s > 0 else "buy")
            self._book(book, asset, -qty, fill, slip, i, ts, reason, out)
            p.clear()


def rebalance(book: Book, weights: dict[str, float], tolerance: float = 0.0) -> list[Order]:
    """Orders that bring positions to the weights at the close."""
    equity = book.cash + sum(book.qty(a) * (book.close(a) or (book.positions[a].last if _ok(book.positions[a].last) else 0.0)) for a in book.assets if book.qty(a))
    if equity <= 0:
        return []
    out = []
    for a, w in weights.items():
        price = book.close(a) if a in book.positions else None
        if price is None or not math.isfinite(w):
            continue
        delta = equity * w / price - book.qty(a)
        if delta and abs(delta) * price >= tolerance * equity:
            out.append(Order(a, "buy" if delta > 0 else "sell", qty=abs(delta)))
    return out


def weights_decider(rows: pd.DataFrame, tolerance: float = 0.0) -> Decider:
    """Target weights of listed bars; a missing weight leaves its asset alone."""
    by: dict = {}
    for ts, asset, w in rows[["ts", "asset", "weight"]].dropna(subset=["weight"]).itertuples(index=False):
        by.setdefault(pd.Timestamp(ts), {})[asset] = float(w)
    return lambda book: rebalance(book, {a: by[book.ts][a] for a in book.assets if a in by[book.ts]}, tolerance) if book.ts in by else ()


def signals_decider(rows: pd.DataFrame, size: float = 1.0) -> Decider:
    """Entries buy cash * size at the close, each from the full cash; exits sell the whole long."""
    enter = {(pd.Timestamp(t), a) for t, a in rows.loc[rows["entry"].fillna(False).astype(bool), ["ts", "asset"]].itertuples(index=False)}
    leave = {(pd.Timestamp(t), a) for t, a in rows.loc[rows["exit"].fillna(False).astype(bool), ["ts", "asset"]].itertuples(index=False)}

    def decide(book: Book) -> list[Order]:
        out = []
        for a in book.assets:
            if (book.ts, a) in enter and (c := book.close(a)) is not None and book.cash * size > 0:
                out.append(Order(a, "buy", qty=book.cash * size / c))
        return out + [Order(a, "sell", qty=book.qty(a)) for a in book.assets if (book.ts, a) in leave and book.qty(a) > 0]

    return decide


OPTIONAL = ("qty", "notional", "kind", "limit_price", "sl_stop", "tp_stop", "tsl_stop")


def orders_decider(rows: pd.DataFrame) -> Decider:
    """Explicit orders at their bar; zero or missing stops are none."""
    by: dict = {}
    for r in rows.to_dict("records"):
        args = {k: r.get(k) for k in OPTIONAL}
        args = {k: None if v is None or (isinstance(v, float) and math.isnan(v)) else v for k, v in args.items()}
        args |= {k: None for k in ("sl_stop", "tp_stop", "tsl_stop") if not args[k]}
        args["kind"] = args["kind"] or "market"
        if args["qty"] is not None:
            args["notional"] = None
        by.setdefault(pd.Timestamp(r["ts"]), []).append(Order(r["asset"], r["side"], **args))
    return lambda book: by.get(book.ts, ())


EVENTS = "run_id string, kind string, bar int, ts timestamp, asset string, side string, qty double, price double, fee double, slippage_bps double, value double, reason string, filled boolean"


@dataclass
class SimResult:
    """Frames of a simulation; each is a filter of the recorded rows."""

    rows: DataFrame

    @property
    def equity(self) -> DataFrame:
        return self.rows.filter("kind = 'equity' AND value <> 0").select("run_id", "ts", F.col("value").alias("equity"))

    @property
    def trades(self) -> DataFrame:
        return self.rows.filter("kind = 'trade'").select("run_id", "ts", "asset", "qty", "price", "fee", "slippage_bps", F.col("value").alias("notional"), "reason")

    @property
    def orders(self) -> DataFrame:
        return self.rows.filter("kind = 'order'").select("run_id", "ts", "asset", "side", "qty", F.col("value").alias("notional"), F.col("reason").alias("type"), F.col("price").alias("limit_price"), "filled")

    @property
    def weights(self) -> DataFrame:
        return self.rows.filter("kind = 'weight'").select("run_id", "ts", "asset", F.col("value").alias("weight"))

    @property
    def returns(self) -> DataFrame:
        from .frames import to_returns

        return to_returns(self.equity, field="equity", key="run_id")


def simulate(bars: DataFrame, instructions: DataFrame | None, make: Callable[[pd.DataFrame], Decider], fold: Fold = Fold()) -> SimResult:
    """Fold every run of ``instructions`` (run_id, ...) over the bars.

    Without a run_id there is one run, '0'.  Bars reach a run by a join on
    run_id, so each run's bars and instructions are in one group; prices are
    filled forward, volume is not.  Instructions on dates or assets without bars
    are ignored.  Instructions None: the decider needs none ('0' only).
    """
    spark = bars.sparkSession
    price = bars.select("ts", "asset", "open", "high", "low", "close")
    if instructions is None:
        tagged = price.withColumn("run_id", F.lit("0"))
        cols = ["ts", "asset"]
        empty = spark.createDataFrame([], "run_id string, ts timestamp, asset string")
        told = empty
    else:
        told = instructions if "run_id" in instructions.columns else instructions.withColumn("run_id", F.lit("0"))
        told = told.withColumn("run_id", F.col("run_id").cast("string"))
        runs = told.select("run_id").distinct().groupBy().agg(F.collect_set("run_id").alias("runs"))
        # every run needs every bar: the answer's own size
        tagged = price.join(F.broadcast(runs)).select(F.explode("runs").alias("run_id"), "ts", "asset", "open", "high", "low", "close")
        cols = [c for c in told.columns if c != "run_id"]

    told = told.toDF(*[f"told_{c}" for c in told.columns])  # both sides may stem from the same bars

    def run(key: tuple, rows: pd.DataFrame, orders: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        if rows.empty:
            return pd.DataFrame(columns=names)
        wide = {f: rows.pivot(index="ts", columns="asset", values=f).sort_index().ffill() for f in ("open", "high", "low", "close")}
        times = [pd.Timestamp(t) for t in wide["close"].index]
        assets = list(wide["close"].columns)
        out = fold.run(times, assets, {f: w.to_numpy(float) for f, w in wide.items()}, make(orders.rename(columns=lambda c: c.removeprefix("told_"))[cols]))
        frame = pd.DataFrame(out, columns=names[1:])
        frame.insert(0, "run_id", key[0])
        return frame.astype({"qty": float, "price": float, "fee": float, "slippage_bps": float, "value": float})

    return SimResult(tagged.groupBy("run_id").cogroup(told.groupBy("told_run_id")).applyInPandas(run, EVENTS))


@dataclass
class Simulator:
    """Bars with cost, slippage and execution models and starting cash."""

    bars: DataFrame
    costs: CostModel = field(default_factory=FixedBps)
    slippage: SlippageModel = field(default_factory=NoSlippage)
    execution: ExecutionModel = field(default_factory=NextBarOpen)
    cash: float = 1_000_000.0

    @property
    def fold(self) -> Fold:
        return Fold(self.costs, self.slippage, self.execution, self.cash)

    def run_weights(self, weights: DataFrame, tolerance: float = 0.0) -> SimResult:
        return simulate(self.bars, weights, lambda rows: weights_decider(rows, tolerance), self.fold)

    def run_signals(self, signals: DataFrame, size: float = 1.0) -> SimResult:
        return simulate(self.bars, signals, lambda rows: signals_decider(rows, size), self.fold)

    def run_orders(self, orders: DataFrame) -> SimResult:
        return simulate(self.bars, orders, orders_decider, self.fold)

    def run_strategy(self, strategy) -> SimResult:
        """A strategy with start(times, assets) and decide(book); it is pickled to the worker."""
        events = getattr(strategy, "events", None)
        marked = events(self.bars) if callable(events) else None
        grid = self.bars.select("ts", "asset")
        told = grid if marked is None else grid.join(marked, ["ts", "asset"], "left")

        def make(rows: pd.DataFrame) -> Decider:
            times = sorted({pd.Timestamp(t) for t in rows["ts"]})
            strategy.start(times, sorted(rows["asset"].unique()), rows)
            return strategy.decide

        return simulate(self.bars, told, make, self.fold)
