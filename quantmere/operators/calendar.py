"""Calendar operators: monthly and yearly compounding, periods, cadences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ppy_of

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _compound(returns: DataFrame, unit: str) -> DataFrame:
    growth = F.product(1 + F.coalesce(F.col("ret"), F.lit(0.0))) - 1
    return returns.groupBy("series", F.trunc("ts", unit).alias("period")).agg(growth.alias("ret"))


def monthly_returns(returns: DataFrame) -> DataFrame:
    """(series, year, month, ret) of months that have rows."""
    m = _compound(returns, "month")
    return m.select("series", F.year("period").alias("year"), F.month("period").alias("month"), "ret")


def monthly_table(returns: DataFrame) -> DataFrame:
    """The same as years by month names."""
    m = _compound(returns, "month").withColumn("m", F.date_format("period", "MMM"))
    return m.groupBy("series", F.year("period").alias("year")).pivot("m", list(MONTHS)).agg(F.first("ret"))


def yearly_returns(returns: DataFrame) -> DataFrame:
    y = _compound(returns, "year")
    return y.select("series", F.year("period").alias("year"), "ret")


def calendar_stats(returns: DataFrame) -> DataFrame:
    """best/worst month and year, positive and negative months of each series."""
    m = _compound(returns, "month").groupBy("series").agg(
        F.max("ret").alias("best_month"), F.min("ret").alias("worst_month"),
        F.count_if(F.col("ret") > 0).alias("positive_months"), F.count_if(F.col("ret") < 0).alias("negative_months"),
    )
    y = _compound(returns, "year").groupBy("series").agg(F.max("ret").alias("best_year"), F.min("ret").alias("worst_year"))
    return m.join(y, "series")


def period_returns(returns: DataFrame, *, periods_per_year: float | None = None) -> DataFrame:
    """(series, period, ret) of nine windows that end at the series' last row; inclusive cut-offs."""
    anchored = returns.withColumn("anchor", F.max("ts").over(Window.partitionBy("series")))
    ppy = ppy_of(periods_per_year)
    a = F.col("anchor")

    def back(months: int) -> Column:
        return F.add_months(a, -months).cast("timestamp") + (a - F.date_trunc("day", a))

    cuts = {
        "MTD": (F.date_trunc("month", a), False), "3M": (back(3), False), "6M": (back(6), False), "YTD": (F.date_trunc("year", a), False),
        "1Y": (back(12), False), "3Y": (back(36), True), "5Y": (back(60), True), "10Y": (back(120), True), "All": (None, True),
    }
    aggs = []
    for name, (cut, annual) in cuts.items():
        on = F.lit(True) if cut is None else F.col("ts") >= cut
        g = F.product(F.when(on, 1 + F.coalesce(F.col("ret"), F.lit(0.0))))
        n = F.count_if(on)
        aggs.append((F.pow(g, F.lit(ppy) / n) - 1 if annual else g - 1).alias(name))
    return anchored.groupBy("series").agg(*aggs).unpivot("series", list(cuts), "period", "ret")


def cadence_triggers(calendar: DataFrame, every: str, *, day: int = 1, ts: str = "ts") -> DataFrame:
    """Dates (of column ts) on which a schedule fires, each snapped to a bar.

    'daily' and 'weekly' step a fixed length from the first bar and take the first
    bar at or after each step; 'monthly' and 'quarterly' take the last bar up to
    ``day`` of the month, or the month's last bar.
    """
    bars = calendar.select(F.col(ts).alias("ts")).distinct()
    if every in ("daily", "weekly"):
        step = {"daily": 1, "weekly": 7}[every]
        whole = bars.agg(F.min("ts").alias("lo"))
        # a bar fires if no bar before it is in its step
        taken = F.floor((F.unix_micros("ts") - F.unix_micros("lo")) / (step * 86_400_000_000.0))
        return bars.join(F.broadcast(whole)).groupBy(taken.alias("step")).agg(F.min("ts").alias("ts")).select("ts")
    months = {"monthly": 1, "quarterly": 3}[every]
    month = F.trunc("ts", "month")
    by_month = bars.groupBy(month.alias("month")).agg(F.max(F.when(F.dayofmonth("ts") <= day, F.col("ts"))).alias("upto"), F.max("ts").alias("end"))
    first = by_month.agg(F.min("month").alias("first"))
    nth = F.round(F.months_between("month", "first")).cast("int")
    return by_month.join(F.broadcast(first)).filter(nth % months == 0).select(F.coalesce("upto", "end").alias("ts"))
