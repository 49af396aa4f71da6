"""Portfolios as frames: combination, turnover, attribution, populations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import summary
from .calendar import period_returns, yearly_returns
from .frames import running
from .nav import returns_from_nav


def combine(returns: DataFrame, weights: DataFrame | None = None, name: str = "portfolio") -> DataFrame:
    """(series, ts, ret): weighted sum of the series of each date; missing returns contribute 0.

    Without weights every series of the frame weighs the same; with them (series,
    weight) the join is on one row per series.
    """
    if weights is None:
        n = returns.agg(F.count_distinct("series").alias("__n"))
        rows = returns.join(F.broadcast(n)).withColumn("weight", 1 / F.col("__n"))  # a single row
    else:
        rows = returns.join(weights.select("series", "weight"), "series")
    return rows.groupBy("ts").agg(F.sum(F.coalesce(F.col("weight") * F.col("ret"), F.lit(0.0))).alias("ret")).select(F.lit(name).alias("series"), "ts", "ret")


def reduce_returns(returns: DataFrame, name: str = "mean") -> DataFrame:
    """Mean of the series of each date."""
    return returns.groupBy("ts").agg(F.avg("ret").alias("ret")).select(F.lit(name).alias("series"), "ts", "ret")


def turnover(weights: DataFrame) -> DataFrame:
    """One row: mean over rebalances of half the summed weight changes; the first date is none."""
    w = Window.partitionBy("asset").orderBy("ts")
    step = weights.withColumn("d", F.abs(F.col("weight") - F.lag("weight").over(w)))
    by_date = step.filter("d IS NOT NULL").groupBy("ts").agg((F.sum("d") / 2).alias("t"))
    return by_date.agg(F.avg("t").alias("turnover"))


def attribution(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(ts, asset, attribution): weight times the portfolio's return of the date."""
    return returns.select("ts", "ret").join(weights, "ts").select("ts", "asset", (F.col("weight") * F.col("ret")).alias("attribution"))


def contribution(weights: DataFrame, returns: DataFrame) -> DataFrame:
    return attribution(weights, returns).groupBy("asset").agg(F.avg("attribution").alias("contribution"))


def composition(weights: DataFrame) -> DataFrame:
    """Last weights of each asset, null as 0."""
    last = weights.agg(F.max("ts").alias("__last"))
    return weights.join(F.broadcast(last)).filter(F.col("ts") == F.col("__last")).select("asset", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def cumulative_returns(returns: DataFrame) -> DataFrame:
    value = F.product(1 + F.coalesce(F.col("ret"), F.lit(0.0))).over(running()) - 1
    return returns.select("series", "ts", value.alias("cumulative"))


@dataclass
class Portfolio:
    """Analytics over a frame of returns, with optional weights and benchmark."""

    returns: DataFrame
    weights: DataFrame | None = None
    benchmark: DataFrame | None = None
    name: str = "portfolio"

    @classmethod
    def from_nav(cls, nav: DataFrame, *, method: str = "total_return", benchmark: DataFrame | None = None, name: str = "portfolio") -> Portfolio:
        return cls(returns_from_nav(nav, method=method), benchmark=benchmark, name=name)

    def metrics(self) -> DataFrame:
        return summary.metrics_bundle(self.returns, self.benchmark)

    def summary(self) -> DataFrame:
        return summary.returns_stats(self.returns)

    def metric(self, name: str, **options) -> DataFrame:
        return summary.metric(self.returns, name, **options)

    def drawdown_series(self) -> DataFrame:
        return summary.drawdown_series(self.returns)

    def worst_drawdowns(self, top: int = 10) -> DataFrame:
        return summary.worst_drawdowns(self.returns, top)

    def worst_runups(self, top: int = 10) -> DataFrame:
        return summary.worst_runups(self.returns, top)

    def equity_curve(self, cash: float = 1.0) -> DataFrame:
        return cumulative_returns(self.returns).select("series", "ts", ((1 + F.col("cumulative")) * cash).alias("equity"))

    def period_returns(self) -> DataFrame:
        return period_returns(self.returns)

    def yearly_returns(self) -> DataFrame:
        own = yearly_returns(self.returns)
        if self.benchmark is None:
            return own
        bench = yearly_returns(self.benchmark.select(F.lit("bench").alias("series"), "ts", F.col("bench").alias("ret")))
        return own.join(bench.select("year", F.col("ret").alias("bench")), "year", "full")

    def turnover(self) -> DataFrame:
        return turnover(self.weights)

    def attribution(self) -> DataFrame:
        return attribution(self.weights, self.returns)

    def contribution(self) -> DataFrame:
        return contribution(self.weights, self.returns)


@dataclass
class Population:
    """Named portfolios; repeated names get _1, _2, ..."""

    members: list[Portfolio] = field(default_factory=list)

    def names(self) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for m in self.members:
            k = seen.get(m.name, 0)
            seen[m.name] = k + 1
            out.append(m.name if not k else f"{m.name}_{k}")
        return out

    def returns(self) -> DataFrame:
        frames = [m.returns.select(F.lit(n).alias("series"), "ts", "ret") for n, m in zip(self.names(), self.members, strict=True)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def summary(self) -> DataFrame:
        return summary.batch_summary(self.returns())

    def cumulative_returns(self) -> DataFrame:
        return cumulative_returns(self.returns())

    def composition(self) -> DataFrame:
        frames = [composition(m.weights).withColumn("portfolio", F.lit(n)) for n, m in zip(self.names(), self.members, strict=True) if m.weights is not None]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
