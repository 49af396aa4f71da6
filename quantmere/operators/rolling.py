"""Rolling metrics: null until the window holds enough non-null rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ppy_of, rf_of
from .benchmark import with_benchmark
from .frames import staged, trailing


def full(window: int, value: Column, col: str = "ret", key: str = "series") -> Column:
    """``value`` where the trailing frame has ``window`` non-null rows."""
    return F.when(F.count(col).over(trailing(window, key)) == window, value)


def rolling_mean(df: DataFrame, col: str = "ret", window: int = 63, key: str = "series") -> DataFrame:
    return df.withColumn("rolling_mean", full(window, F.avg(col).over(trailing(window, key)), col, key))


def rolling_std(df: DataFrame, col: str = "ret", window: int = 63, ddof: int = 1, key: str = "series") -> DataFrame:
    var = F.var_pop(col).over(trailing(window, key))
    value = F.sqrt(var * window / (window - ddof)) if window > ddof else F.lit(None).cast("double")
    return df.withColumn("rolling_std", full(window, value, col, key))


def rolling_sharpe(returns: DataFrame, window: int = 63, risk_free: float | None = None, periods_per_year: float | None = None) -> DataFrame:
    w, ppy = trailing(window), ppy_of(periods_per_year)
    value = F.try_divide(F.avg("ret").over(w) - rf_of(risk_free) / ppy, F.stddev_samp("ret").over(w)) * ppy**0.5
    return returns.select("series", "ts", full(window, value).alias("rolling_sharpe"))


def rolling_sortino(returns: DataFrame, window: int = 63, target: float = 0.0, periods_per_year: float | None = None) -> DataFrame:
    w = trailing(window)
    d = F.col("ret") - target
    low = F.when(d < 0, d * d).when(d.isNotNull(), 0.0)
    value = F.try_divide(F.avg(d).over(w), F.sqrt(F.avg(low).over(w))) * ppy_of(periods_per_year) ** 0.5
    return returns.select("series", "ts", full(window, value).alias("rolling_sortino"))


def rolling_volatility(returns: DataFrame, window: int = 63, periods_per_year: float | None = None) -> DataFrame:
    value = F.stddev_samp("ret").over(trailing(window)) * ppy_of(periods_per_year) ** 0.5
    return returns.select("series", "ts", full(window, value).alias("rolling_volatility"))


def _rolling_beta(window: int) -> Column:
    w = trailing(window)
    return F.try_divide(F.covar_samp("ret", "bench").over(w), F.var_samp("bench").over(w))


def rolling_beta(returns: DataFrame, benchmark: DataFrame, window: int = 63) -> DataFrame:
    """Rows are aligned (both sides present) before the windows are cut."""
    pairs = with_benchmark(returns, benchmark).filter(F.col("ret").isNotNull())
    return pairs.select("series", "ts", full(window, _rolling_beta(window)).alias("rolling_beta"))


def rolling_alpha(returns: DataFrame, benchmark: DataFrame, window: int = 63, risk_free: float | None = None, periods_per_year: float | None = None) -> DataFrame:
    pairs = with_benchmark(returns, benchmark).filter(F.col("ret").isNotNull())
    w, ppy = trailing(window), ppy_of(periods_per_year)
    rf = rf_of(risk_free) / ppy
    value = ((F.avg("ret").over(w) - rf) - _rolling_beta(window) * (F.avg("bench").over(w) - rf)) * ppy
    return pairs.select("series", "ts", full(window, value).alias("rolling_alpha"))


def rolling_drawdown(returns: DataFrame) -> DataFrame:
    return staged(returns).select("series", "ts", F.col("dd").alias("rolling_drawdown"))
