"""Per-series metric tables: single metrics, bundles and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from .benchmark import benchmark_aggregates, with_benchmark
from .calendar import calendar_stats
from .frames import ordered, running, staged


def metric(returns: DataFrame, name: str, **options) -> DataFrame:
    """(series, <name>) of one metric."""
    return staged(returns).groupBy("series").agg(getattr(M, name)(**options).alias(name))


def returns_stats(returns: DataFrame) -> DataFrame:
    """The eleven-row summary as (series, metric, value)."""
    wide = staged(returns).groupBy("series").agg(*[getattr(M, n)().cast("double").alias(n) for n in M.SUMMARY])
    return wide.unpivot("series", list(M.SUMMARY), "metric", "value")


def batch_summary(returns: DataFrame) -> DataFrame:
    """The same as columns, one row for each series."""
    return staged(returns).groupBy("series").agg(*[getattr(M, n)().cast("double").alias(n) for n in M.SUMMARY])


def streaks(returns: DataFrame) -> DataFrame:
    """(series, consecutive_wins, consecutive_losses): longest runs of one sign, by islands."""
    sign = returns.withColumn("sign", F.when(F.col("ret") > 0, 1).when(F.col("ret") < 0, -1).otherwise(0))
    w, ws = ordered(), Window.partitionBy("series", "sign").orderBy("ts")
    island = sign.withColumn("island", F.row_number().over(w) - F.row_number().over(ws))
    runs = island.groupBy("series", "sign", "island").agg(F.count("*").alias("n"))
    pick = lambda s: F.coalesce(F.max(F.when(F.col("sign") == s, F.col("n"))), F.lit(0)).cast("long")
    return runs.groupBy("series").agg(pick(1).alias("consecutive_wins"), pick(-1).alias("consecutive_losses"))


def metrics_bundle(returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """All metrics of every series in one wide row, calendar, streak and benchmark ones too."""
    base = staged(returns).groupBy("series").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), M.periods().alias("periods"), *[f().alias(n) for n, f in M.SCALARS.items()]
    )
    out = base.withColumn("probabilistic_sharpe_ratio", M.normal_cdf(F.col("probabilistic_sharpe_z")))
    out = out.join(streaks(returns), "series", "left").join(calendar_stats(returns), "series", "left")
    if benchmark is not None:
        out = out.join(benchmark_aggregates(with_benchmark(returns, benchmark)), "series", "left")
    return out


def drawdown_series(returns: DataFrame) -> DataFrame:
    return staged(returns).select("series", "ts", "dd")


def _episodes(returns: DataFrame) -> DataFrame:
    """Staged rows with the number of the drawdown or run-up stretch they belong to."""
    w = ordered()
    s = staged(returns).withColumn("down", F.col("dd") < 0)
    change = (F.lag("down").over(w).isNull() | (F.col("down") != F.lag("down").over(w))).cast("int")
    s = s.withColumn("prev_ts", F.lag("ts").over(w)).withColumn("next_ts", F.lead("ts").over(w))
    return s.withColumn("episode", F.sum(change).over(running()))


def _days(a: Column, b: Column) -> Column:
    return F.datediff(b, a).cast("long")


def drawdown_details(returns: DataFrame) -> DataFrame:
    """One row per drawdown: bar before it, valley, recovery (null while open), depth and days."""
    eps = _episodes(returns).filter("down").groupBy("series", "episode").agg(
        F.min_by("prev_ts", "ts").alias("start"),
        F.min(F.struct("dd", "ts"))["ts"].alias("valley"),
        F.max_by("next_ts", "ts").alias("recovery"),
        F.max("ts").alias("last"),
        F.min("dd").alias("max_drawdown"),
        F.min("ts").alias("first"),
    )
    eps = eps.withColumn("start", F.coalesce("start", "first"))
    return eps.select(
        "series", "start", "valley", "recovery", "max_drawdown",
        _days(F.col("start"), F.col("valley")).alias("days_to_valley"),
        _days(F.col("start"), F.coalesce("recovery", "last")).alias("days"),
    )


def runup_details(returns: DataFrame) -> DataFrame:
    """One row per run-up: the stretch from a valley or the start to the peak before the next drawdown.

    Bars are numbered by the valleys up to them and the drawdowns begun before
    them; where both numbers agree the bar is in a stretch.  No join with the
    episodes, so the work doesn't grow with their number.
    """
    w, span = ordered(), Window.partitionBy("series", "episode")
    e = _episodes(returns)
    bottom = F.min(F.when(F.col("down"), F.struct("dd", "ts"))).over(span)["ts"]
    at_start = F.col("down") & F.col("prev_ts").isNull()  # a drawdown from the first bar begins at it
    begins = ~F.col("down") & F.coalesce(F.lead("down").over(w), F.lit(False))
    e = e.withColumns({"bottom": bottom, "begins": begins.cast("int"), "at_start": at_start.cast("int")})
    legs = F.sum((F.col("down") & (F.col("ts") == F.col("bottom"))).cast("int")).over(running())
    begun = F.coalesce(F.sum("begins").over(running().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("at_start").over(running())
    inside = e.withColumns({"leg": legs, "begun": begun}).filter("leg = begun")
    out = inside.groupBy("series", "leg").agg(
        F.min("ts").alias("start"), F.min_by("wealth", "ts").alias("w0"), F.max(F.struct("wealth", (-F.unix_micros("ts")).alias("o"), "ts")).alias("top")
    )
    return out.filter(F.col("top.ts") > F.col("start")).select(
        "series", "start", F.col("top.ts").alias("peak"), (F.try_divide(F.col("top.wealth"), F.col("w0")) - 1).alias("max_runup"), _days(F.col("start"), F.col("top.ts")).alias("days")
    )


def worst_drawdowns(returns: DataFrame, top: int = 10) -> DataFrame:
    """The deepest ``top`` episodes of every series, ranked."""
    w = Window.partitionBy("series").orderBy("max_drawdown", "start")
    return drawdown_details(returns).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def worst_runups(returns: DataFrame, top: int = 10) -> DataFrame:
    """The largest ``top`` run-ups of every series, ranked."""
    w = Window.partitionBy("series").orderBy(F.col("max_runup").desc(), "start")
    return runup_details(returns).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
