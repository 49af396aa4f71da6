"""Metrics against a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ppy_of, rf_of


def with_benchmark(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns with the benchmark of their date; dates without one go.

    One row per date: Spark broadcasts it below its checked threshold, and
    joins by shuffle beyond it.
    """
    bench = benchmark.select("ts", "bench").filter(F.col("bench").isNotNull())
    return returns.join(bench, "ts")


def beta() -> Column:
    return F.try_divide(F.covar_samp("ret", "bench"), F.var_samp("bench"))


def alpha(risk_free: float | None = None, periods_per_year: float | None = None) -> Column:
    ppy = ppy_of(periods_per_year)
    rf = rf_of(risk_free) / ppy
    return (F.avg("ret") - rf) * ppy - beta() * (F.avg("bench") - rf) * ppy


def correlation() -> Column:
    return F.corr("ret", "bench")


def r_squared() -> Column:
    return F.pow(correlation(), 2)


def information_ratio() -> Column:
    d = F.col("ret") - F.col("bench")
    return F.try_divide(F.avg(d), F.stddev_samp(d))


def tracking_error(periods_per_year: float | None = None) -> Column:
    return F.stddev_samp(F.col("ret") - F.col("bench")) * ppy_of(periods_per_year) ** 0.5


def _capture(up: bool) -> Column:
    on = F.col("bench") > 0 if up else F.col("bench") < 0
    return F.try_divide(F.avg(F.when(on, F.col("ret"))), F.avg(F.when(on, F.col("bench"))))


def up_capture() -> Column:
    return _capture(True)


def down_capture() -> Column:
    return _capture(False)


def capture_ratio() -> Column:
    return F.try_divide(up_capture(), down_capture())


def treynor_ratio(risk_free: float | None = None, periods_per_year: float | None = None) -> Column:
    ppy = ppy_of(periods_per_year)
    return F.try_divide((F.avg("ret") - rf_of(risk_free) / ppy) * ppy, beta())


RELATIVE = {f.__name__: f for f in (alpha, beta, correlation, r_squared, information_ratio, tracking_error, up_capture, down_capture, capture_ratio, treynor_ratio)}


def benchmark_aggregates(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("series").agg(*[f().alias(n) for n, f in RELATIVE.items()])
