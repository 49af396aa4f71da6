"""Fluent facades over long frames: ``Returns(df).sharpe()``, ``Bars(df).evaluate_pattern(..)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .functions import formations
from .functions import metrics as M
from .operators import benchmark as B
from .operators import calendar as C
from .operators import eda, frames, patterns, rolling, sim, strategies, study, summary
from .operators.portfolio import Portfolio
from .plans.report import Tearsheet


@dataclass
class Returns:
    """(series, ts, ret); every scalar metric is a method that gives (series, <metric>)."""

    df: DataFrame

    def __getattr__(self, name: str):
        if name in M.SCALARS:
            return lambda **options: summary.metric(self.df, name, **options)
        if name in B.RELATIVE:
            return lambda bench, **options: B.with_benchmark(self.df, bench).groupBy("series").agg(B.RELATIVE[name](**options).alias(name))
        if hasattr(rolling, name) and name.startswith("rolling_"):
            return lambda *args, **options: getattr(rolling, name)(self.df, *args, **options)
        raise AttributeError(name)

    def metrics(self, benchmark: DataFrame | None = None) -> DataFrame:
        return summary.metrics_bundle(self.df, benchmark)

    def summary(self) -> DataFrame:
        return summary.returns_stats(self.df)

    def drawdown_series(self) -> DataFrame:
        return summary.drawdown_series(self.df)

    def drawdown_details(self) -> DataFrame:
        return summary.drawdown_details(self.df)

    def streaks(self) -> DataFrame:
        return summary.streaks(self.df)

    def monthly_returns(self) -> DataFrame:
        return C.monthly_returns(self.df)

    def yearly_returns(self) -> DataFrame:
        return C.yearly_returns(self.df)

    def period_returns(self) -> DataFrame:
        return C.period_returns(self.df)

    def describe(self) -> DataFrame:
        return eda.describe(self.df)

    def portfolio(self, **options) -> Portfolio:
        return Portfolio(self.df, **options)

    def render_html(self, title: str = "Tear sheet") -> str:
        return Tearsheet(Portfolio(self.df), title).render_html()


@dataclass
class Bars:
    """(ts, asset, open, high, low, close, volume)."""

    df: DataFrame

    def to_prices(self, field: str = "close") -> DataFrame:
        return frames.to_prices(self.df, field)

    def to_returns(self, **options) -> DataFrame:
        return frames.to_returns(self.to_prices(), **options)

    def resample(self, rule: str, **options) -> DataFrame:
        return frames.resample(self.df, rule, **options)

    def list_patterns(self) -> list[str]:
        return sorted(formations.FORMATIONS)

    def pattern_events(self, pattern: str, **options) -> DataFrame:
        return patterns.pattern_events(self.df, pattern, **options)

    def detect_pattern(self, pattern: str, mode: str = "breakout", decay_bars: int = 5, **options) -> DataFrame:
        return patterns.events_to_signal(self.pattern_events(pattern, **options), self.df, mode=mode, decay_bars=decay_bars)

    def evaluate_pattern(self, pattern: str, *, horizons: tuple[int, ...] = study.HORIZONS, condition: patterns.Condition | None = None, **options) -> DataFrame:
        events = self.pattern_events(pattern, **options)
        if condition is not None:
            events = patterns.apply_condition(events, condition, self.df)
        return study.evaluate(events, self.df, horizons=horizons)

    def simulator(self, **options) -> sim.Simulator:
        return sim.Simulator(self.df, **options)

    def run_hold(self, **options) -> sim.SimResult:
        return self.simulator().run_strategy(strategies.Hold(**options))

    def run_dca(self, **options) -> sim.SimResult:
        return self.simulator().run_strategy(strategies.DCA(**options))

    def run_pattern(self, pattern: str, *, condition: patterns.Condition | None = None, size: float = 0.1, **options) -> sim.SimResult:
        return self.simulator().run_strategy(strategies.PatternStrategy(pattern, condition or patterns.Condition(), size, **options))

    def simulate(self, what, **options) -> sim.SimResult:
        """By kind: a strategy, orders (a side column), signals (entry and exit) or weights."""
        s = self.simulator(**options)
        if hasattr(what, "decide"):
            return s.run_strategy(what)
        cols = set(what.columns)
        if "side" in cols:
            return s.run_orders(what)
        return s.run_signals(what) if {"entry", "exit"} <= cols else s.run_weights(what)
