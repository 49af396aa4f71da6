"""NAV, capital flows and returns from NAV; forward as-of attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGN = {"INJECTION": 1.0, "WITHDRAWAL": -1.0, "DISTRIBUTION": -1.0}


def attribute_to_next(flows: DataFrame, dates: DataFrame, value: str = "amount", key: str = "account") -> DataFrame:
    """Sum of flows on the first date at or after each; later flows drop out.

    Flows and dates are united and sorted once by key; the next date is looked
    up by a window over the rows that follow, so no range join is needed.
    """
    marked = flows.select(key, "ts", F.col(value).alias("__v"), F.lit(None).cast("timestamp").alias("__date"))
    stops = dates.select(key, "ts").distinct().select(key, "ts", F.lit(None).cast("double").alias("__v"), F.col("ts").alias("__date"))
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("__date").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.unionByName(stops).withColumn("__next", F.last("__date", ignorenulls=True).over(w))
    return placed.filter(F.col("__v").isNotNull() & F.col("__next").isNotNull()).groupBy(key, F.col("__next").alias("ts")).agg(F.sum("__v").alias(value))


def signed_flows(flows: DataFrame, nav: DataFrame) -> DataFrame:
    """Net flow of every NAV date: injections in, withdrawals and distributions out, 0 where none."""
    sign = F.lit(None).cast("double")
    for kind, s in SIGN.items():
        sign = F.when(F.col("flow_type") == kind, F.lit(s)).otherwise(sign)
    net = attribute_to_next(flows.withColumn("amount", sign * F.col("amount")), nav)
    return nav.select("account", "ts").join(net, ["account", "ts"], "left").select("account", "ts", F.coalesce("amount", F.lit(0.0)).alias("flow"))


def per_share_distributions(flows: DataFrame, shares: DataFrame) -> DataFrame:
    """Distributions on their NAV date divided by the shares of that date."""
    own = attribute_to_next(flows.filter(F.col("flow_type") == "DISTRIBUTION"), shares)
    return own.join(shares, ["account", "ts"]).select("account", "ts", F.try_divide(F.col("amount"), F.col("shares")).alias("dist_per_share"))


METHODS = ("none", "total_return", "modified_dietz", "daily_twr")


def returns_from_nav(nav: DataFrame, *, method: str = "total_return", key: str = "account") -> DataFrame:
    """(series, ts, ret) from (key, ts, nav[, dist][, flow]); each series' first row is dropped.

    none: change / previous; total_return adds the distribution; modified_dietz
    takes the flow off and half of it into the base; daily_twr takes it off.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    w = Window.partitionBy(key).orderBy("ts")
    prev = F.lag("nav").over(w)
    change = F.col("nav") - prev
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in nav.columns else F.lit(0.0)
    ret = {
        "none": lambda: F.try_divide(change, prev),
        "total_return": lambda: F.try_divide(change + part("dist"), prev),
        "modified_dietz": lambda: F.try_divide(change - part("flow"), prev + 0.5 * part("flow")),
        "daily_twr": lambda: F.try_divide(change - part("flow"), prev),
    }[method]()
    out = nav.select(F.col(key).alias("series"), "ts", ret.alias("ret"), F.row_number().over(w).alias("__n"))
    return out.filter("__n > 1").drop("__n")


def synthetic_nav(nav: DataFrame, *, key: str = "account") -> DataFrame:
    """Flow-adjusted path: the first funded NAV compounded by daily time-weighted returns."""
    w = Window.partitionBy(key).orderBy("ts")
    funded = nav.withColumn("__on", F.max((F.col("nav") > 0).cast("int")).over(w)).filter("__on = 1")
    prev = F.lag("nav").over(w)
    flow = F.coalesce(F.col("flow"), F.lit(0.0))
    ret = F.coalesce(F.try_divide(F.col("nav") - prev - flow, prev), F.lit(0.0))
    base = F.first("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = funded.withColumn("__r", ret).withColumn("__base", base)
    path = F.product(1 + F.col("__r")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.select(key, "ts", (F.col("__base") * path).alias("nav"))
