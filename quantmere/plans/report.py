"""Report tables and a self-contained HTML tear sheet; only small frames reach the driver."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import calendar as C
from ..operators.frames import staged
from ..operators.portfolio import Portfolio, cumulative_returns

POINTS = 2000  # of a chart line


@dataclass(frozen=True)
class MetricInfo:
    label: str
    category: str
    fmt: str = "ratio"


#: How metrics are shown.
INFO = {
    "total_return": MetricInfo("Total return", "Return", "pct"),
    "cagr": MetricInfo("CAGR", "Return", "pct"),
    "volatility": MetricInfo("Volatility", "Risk", "pct"),
    "sharpe": MetricInfo("Sharpe", "Risk-adjusted"),
    "sortino": MetricInfo("Sortino", "Risk-adjusted"),
    "calmar": MetricInfo("Calmar", "Risk-adjusted"),
    "omega": MetricInfo("Omega", "Risk-adjusted"),
    "max_drawdown": MetricInfo("Max drawdown", "Drawdown", "pct"),
    "ulcer_index": MetricInfo("Ulcer index", "Drawdown"),
    "cvar": MetricInfo("CVaR 95%", "Tail", "pct"),
    "value_at_risk": MetricInfo("VaR 95%", "Tail", "pct"),
    "win_rate": MetricInfo("Win rate", "Trades", "pct"),
    "profit_factor": MetricInfo("Profit factor", "Trades"),
}


def show(name: str, value: float | None) -> str:
    if value is None or value != value:
        return "–"
    return f"{value:.2%}" if name in INFO and INFO[name].fmt == "pct" else f"{value:,.2f}"


def overview_table(returns: DataFrame) -> DataFrame:
    """Seven metrics of each series."""
    names = ("total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar")
    return staged(returns).groupBy("series").agg(*[getattr(M, n)().alias(n) for n in names])


def returns_sheet(returns: DataFrame) -> DataFrame:
    return cumulative_returns(returns).join(returns, ["series", "ts"]).select("series", "ts", "ret", "cumulative")


def heatmap_table(returns: DataFrame) -> DataFrame:
    """Monthly returns of every month between a series' first and last; months without rows are 0."""
    span = returns.groupBy("series").agg(F.trunc(F.min("ts"), "month").alias("a"), F.trunc(F.max("ts"), "month").alias("b"))
    grid = span.select("series", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")).select("series", F.year("m").alias("year"), F.month("m").alias("month"))
    return grid.join(C.monthly_returns(returns), ["series", "year", "month"], "left").select("series", "year", "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def drawdown_pill(returns: DataFrame) -> DataFrame:
    """Depth, date of the last peak before the trough, and mean of the drawdown bars."""
    s = staged(returns)
    peak = F.max(F.when(F.col("dd") == 0, F.col("ts"))).over(Window.partitionBy("series").orderBy("ts"))
    s = s.withColumn("peak_ts", peak)
    return s.groupBy("series").agg(F.min("dd").alias("max_drawdown"), F.min_by("peak_ts", F.struct("dd", "ts")).alias("peak_ts"), F.avg(F.when(F.col("dd") < 0, F.col("dd"))).alias("avg_drawdown"))


def _thinned(df: DataFrame, value: str) -> list[tuple[str, list[float]]]:
    """At most POINTS values of each series, evenly spaced, the last one kept."""
    w = Window.partitionBy("series").orderBy("ts")
    n = F.count("*").over(Window.partitionBy("series"))
    k = F.row_number().over(w)
    step = F.greatest(F.ceil(n / POINTS), F.lit(1))
    kept = df.withColumns({"__k": k, "__s": step, "__n": n}).filter((F.col("__k") % F.col("__s") == 0) | (F.col("__k") == F.col("__n")))
    out: dict[str, list[float]] = {}
    for r in kept.select("series", "ts", value).orderBy("series", "ts").collect():
        out.setdefault(r.series, []).append(r[value] or 0.0)
    return list(out.items())


def _svg(lines: list[tuple[str, list[float]]], title: str, size: tuple[int, int] = (760, 220)) -> str:
    values = [v for _, vs in lines for v in vs] or [0.0]
    lo, hi = min(values), max(values)
    width, height = size
    y = lambda v: height - 10 - (v - lo) / ((hi - lo) or 1) * (height - 30)
    paths = []
    for k, (name, vs) in enumerate(lines):
        points = " ".join(f"{10 + i * (width - 20) / max(len(vs) - 1, 1):.1f},{y(v):.1f}" for i, v in enumerate(vs))
        paths.append(f'<polyline fill="none" stroke="hsl({k * 67 % 360},55%,45%)" points="{points}"><title>{html.escape(name)}</title></polyline>')
    return f'<h2>{html.escape(title)}</h2><svg viewBox="0 0 {width} {height}" role="img">{"".join(paths)}</svg>'


def _table(rows: list[dict], columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(INFO[c].label if c in INFO else c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(show(c, r[c]) if isinstance(r[c], float) or r[c] is None else str(r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


@dataclass
class Tearsheet:
    portfolio: Portfolio
    title: str = "Tear sheet"

    def stats(self) -> DataFrame:
        return self.portfolio.metrics()

    def render_html(self) -> str:
        r = self.portfolio.returns
        names = ["series", *[n for n in INFO]]
        stats = staged(r).groupBy("series").agg(*[getattr(M, n)().cast("double").alias(n) for n in INFO])
        parts = [
            _table([x.asDict() for x in stats.orderBy("series").collect()], names),
            _svg(_thinned(cumulative_returns(r), "cumulative"), "Cumulative return"),
            _svg(_thinned(self.portfolio.drawdown_series(), "dd"), "Drawdown"),
            "<h2>Worst drawdowns</h2>" + _table([x.asDict() for x in self.portfolio.worst_drawdowns(5).orderBy("series", "rank").collect()], ["series", "start", "valley", "recovery", "max_drawdown", "days"]),
        ]
        style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:4px 8px;border-bottom:1px solid #ddd;text-align:right}"
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(self.title)}</title><style>{style}</style></head><body><h1>{html.escape(self.title)}</h1>{''.join(parts)}</body></html>"
