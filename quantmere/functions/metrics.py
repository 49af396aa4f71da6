"""Scalar metrics as aggregate Columns.

Every function gives a Column to be used in ``groupBy(series).agg(...)`` over a
frame staged by ``operators.frames.staged`` (columns ret, wealth, dd and lags).
Null returns are missing: sums and means skip them, row counts keep them where
noted.  Zero denominators give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ppy_of, rf_of

R, DD, WEALTH = "ret", "dd", "wealth"


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _neg(x: Column) -> Column:
    return F.when(x < 0, x).when(x.isNotNull(), F.lit(0.0))


def _pos(x: Column) -> Column:
    return F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0))


def _root(x: Column) -> Column:
    return F.sqrt(x)


def growth() -> Column:
    return F.product(1 + F.coalesce(F.col(R), F.lit(0.0)))


def total_return() -> Column:
    return growth() - 1


def cagr(periods_per_year: float | None = None) -> Column:
    """Annualised over the row count, missing rows included."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return F.pow(growth(), F.lit(ppy_of(periods_per_year)) / n) - 1


def volatility(periods_per_year: float | None = None) -> Column:
    return F.stddev_samp(R) * ppy_of(periods_per_year) ** 0.5


def downside_volatility(target: float = 0.0, periods_per_year: float | None = None) -> Column:
    return _root(F.avg(F.pow(_neg(F.col(R) - target), 2))) * ppy_of(periods_per_year) ** 0.5


def avg_return() -> Column:
    return F.avg(R)


def best() -> Column:
    return F.max(R)


def worst() -> Column:
    return F.min(R)


def win_rate() -> Column:
    return F.avg(F.when(F.col(R) > 0, 1.0).otherwise(0.0))


def avg_win() -> Column:
    return F.avg(F.when(F.col(R) > 0, F.col(R)))


def avg_loss() -> Column:
    return F.avg(F.when(F.col(R) < 0, F.col(R)))


def payoff_ratio() -> Column:
    return div(avg_win(), F.abs(avg_loss()))


def profit_factor() -> Column:
    return div(F.sum(_pos(F.col(R))), -F.sum(_neg(F.col(R))))


def exposure() -> Column:
    return F.avg(F.when(F.col(R).isNull() | (F.col(R) != 0), 1.0).otherwise(0.0))


def kelly_criterion() -> Column:
    return win_rate() - div(1 - win_rate(), payoff_ratio())


def risk_of_ruin(starting_capital: float = 1.0, ruin_level: float = 0.0) -> Column:
    """Share of bars whose wealth is below the level that counts as ruin."""
    return F.avg(F.when(F.col(WEALTH) * starting_capital < starting_capital * (1 - ruin_level), 1.0).otherwise(0.0))


def skew() -> Column:
    """Bias-adjusted; null below three values."""
    n = F.count(R)
    return F.when(n > 2, F.skewness(R) * _root(n * (n - 1)) / (n - 2))


def kurtosis() -> Column:
    """Bias-adjusted excess; null below four values."""
    n = F.count(R)
    return F.when(n > 3, ((n + 1) * F.kurtosis(R) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def sharpe(risk_free: float | None = None, periods_per_year: float | None = None) -> Column:
    ppy = ppy_of(periods_per_year)
    return div(F.avg(R) - rf_of(risk_free) / ppy, F.stddev_samp(R)) * ppy**0.5


def sortino(target: float = 0.0, periods_per_year: float | None = None) -> Column:
    excess = F.col(R) - target
    return div(F.avg(excess), _root(F.avg(F.pow(_neg(excess), 2)))) * ppy_of(periods_per_year) ** 0.5


def adjusted_sortino(target: float = 0.0, periods_per_year: float | None = None) -> Column:
    return sortino(target, periods_per_year) / 2**0.5


def max_drawdown() -> Column:
    return F.min(DD)


def calmar(periods_per_year: float | None = None) -> Column:
    return div(cagr(periods_per_year), F.abs(max_drawdown()))


def omega(target: float = 0.0) -> Column:
    excess = F.col(R) - target
    return div(F.sum(_pos(excess)), F.sum(_pos(-excess)))


def value_at_risk(alpha: float = 0.95) -> Column:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return F.percentile(R, F.lit(1 - alpha))


def cvar() -> Column:
    """Mean of returns at or below the staged value at risk."""
    return F.avg(F.when(F.col(R) <= F.col("var"), F.col(R)))


def tail_ratio(alpha: float = 0.05) -> Column:
    return div(F.abs(F.percentile(R, F.lit(1 - alpha))), F.abs(F.percentile(R, F.lit(alpha))))


def common_sense_ratio() -> Column:
    return tail_ratio() * profit_factor()


def ulcer_index() -> Column:
    return _root(F.avg(F.pow(F.col(DD) * 100, 2)))


def pain_index() -> Column:
    return F.avg(F.abs(DD))


def pain_ratio(risk_free: float | None = None, periods_per_year: float | None = None) -> Column:
    return div(cagr(periods_per_year) - rf_of(risk_free), pain_index())


def gain_to_pain_ratio() -> Column:
    return div(F.sum(R), F.abs(F.sum(_neg(F.col(R)))))


def ulcer_performance_index(risk_free: float | None = None, periods_per_year: float | None = None) -> Column:
    return div(cagr(periods_per_year) - rf_of(risk_free), ulcer_index() / 100)


def autocorr_penalty(max_lag: int = 3) -> Column:
    """1 / sqrt(1 + 2 sum of the autocorrelations), 1 below five values."""
    total = F.lit(0.0)
    for k in range(1, max_lag + 1):
        rho = F.corr(R, f"lag{k}")
        total = total + F.when(F.isnan(rho) | rho.isNull(), 0.0).otherwise(rho)
    return F.when(F.count(R) < 5, 1.0).otherwise(1 / _root(F.greatest(1 + 2 * total, F.lit(1e-8))))


def smart_sharpe(risk_free: float | None = None, periods_per_year: float | None = None) -> Column:
    return sharpe(risk_free, periods_per_year) * autocorr_penalty()


def smart_sortino(target: float = 0.0, periods_per_year: float | None = None) -> Column:
    return sortino(target, periods_per_year) * autocorr_penalty()


def probabilistic_sharpe_z(target_sharpe: float = 0.0, periods_per_year: float | None = None) -> Column:
    """The z-score whose normal probability is the probabilistic Sharpe ratio."""
    sr = div(F.avg(R), F.stddev_samp(R))
    target = target_sharpe / ppy_of(periods_per_year) ** 0.5
    spread = 1 - skew() * sr + kurtosis() / 4 * F.pow(sr, 2)
    return div((sr - target) * _root(F.count(R) - 1), _root(F.when(spread > 0, spread)))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, JVM-side; ``z`` should be a plain column.

    The series of erf below three, a continued fraction of the tail beyond, both
    folded over a short sequence; absolute error below 1e-12.
    """
    x = F.abs(z) / 2**0.5
    # erf(x) = 2/sqrt(pi) exp(-x^2) sum 2^k x^(2k+1) / (1*3*..*(2k+1))
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (2 / (2 * k + 1)) * x * x
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda acc: acc["total"])
    series = total * F.exp(-x * x) * (2 / 3.141592653589793**0.5)
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda acc, k: x + k / 2 / acc)
    far = 1 - F.exp(-x * x) / (tail * 3.141592653589793**0.5)
    erf = F.when(x < 3, series).otherwise(far)
    return F.when(z >= 0, 0.5 + erf / 2).otherwise(0.5 - erf / 2)


def periods() -> Column:
    return F.count(R)


#: name -> factory of the metrics that one aggregation over a staged frame gives
SCALARS: dict[str, Callable[[], Column]] = {
    f.__name__: f
    for f in (
        total_return, cagr, volatility, downside_volatility, avg_return, best, worst, win_rate, avg_win, avg_loss,
        payoff_ratio, profit_factor, exposure, kelly_criterion, risk_of_ruin, skew, kurtosis, sharpe, sortino,
        adjusted_sortino, calmar, omega, value_at_risk, cvar, tail_ratio, common_sense_ratio, max_drawdown,
        ulcer_index, pain_index, pain_ratio, gain_to_pain_ratio, ulcer_performance_index, smart_sharpe, smart_sortino,
        probabilistic_sharpe_z,
    )
}

#: the eleven rows of the short summary
SUMMARY = ("periods", "total_return", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "ulcer_index", "cvar", "omega")
