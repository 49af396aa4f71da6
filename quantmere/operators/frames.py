"""Long-form frames: projection, returns, resampling, alignment, staging.

Bars are (ts, asset, open, high, low, close, volume, ...); returns are
(series, ts, ret).  NaN is turned to null once, at the door.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Double and float columns with NaN and infinities as null."""
    kinds = dict(df.dtypes)
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in kinds.items()])


def ordered(key: str = "series", ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts)


def running(key: str = "series", ts: str = "ts") -> WindowSpec:
    return ordered(key, ts).rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, key: str = "series", ts: str = "ts") -> WindowSpec:
    return ordered(key, ts).rowsBetween(-(n - 1), 0)


def normalize_field(name: str) -> str:
    """CamelCase, blanks and hyphens to snake_case."""
    s = re.sub(r"[\s\-]+", "_", name.strip())
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", s)
    s = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", "_", s)
    return re.sub(r"_+", "_", s).lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_field(c) for c in df.columns])


def canonical_order(df: DataFrame) -> DataFrame:
    """ts and asset, then OHLCV, then the rest in their order."""
    lead = [c for c in ("ts", "asset", *OHLCV) if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def to_prices(bars: DataFrame, field: str = "close") -> DataFrame:
    return bars.select("ts", "asset", F.col(field).cast("double").alias("price"))


def to_returns(prices: DataFrame, *, field: str = "price", key: str = "asset", method: str = "simple", dropna: bool = True) -> DataFrame:
    """(series, ts, ret) by the previous row's price, without filling."""
    if method not in ("simple", "log"):
        raise ValueError("method is 'simple' or 'log'")
    ratio = F.try_divide(F.col(field), F.lag(field).over(ordered(key)))
    ret = ratio - 1 if method == "simple" else F.when(ratio > 0, F.ln(ratio))
    out = prices.select(F.col(key).alias("series"), "ts", ret.alias("ret"))
    return out.filter(F.col("ret").isNotNull()) if dropna else out


def to_log_returns(prices: DataFrame, **options) -> DataFrame:
    return to_returns(prices, method="log", **options)


def align(*frames: DataFrame, how: str = "inner", keys: tuple[str, str] = ("ts", "asset")) -> list[DataFrame]:
    """Frames on their common (or united) dates and assets, both axes apart.

    The axes are distinct dates and distinct assets; rows missing from a frame
    come with nulls, so all results have the same grid.
    """
    if how not in ("inner", "outer"):
        raise ValueError("how is 'inner' or 'outer'")
    axes = []
    for key in keys:
        parts = [f.select(key).distinct() for f in frames]
        axes.append(reduce(lambda a, b: a.intersect(b), parts) if how == "inner" else reduce(lambda a, b: a.union(b), parts).distinct())
    if how == "inner":
        return [reduce(lambda f, axis: f.join(axis[0], axis[1], "left_semi"), zip(axes, keys, strict=True), f) for f in frames]
    # the grid of an outer alignment is the answer's own size: every date for every asset
    assets = axes[1].agg(F.collect_set(keys[1]).alias("__all"))
    grid = axes[0].join(F.broadcast(assets)).select(keys[0], F.explode("__all").alias(keys[1]))
    return [grid.join(f, list(keys), "left") for f in frames]


def resample(bars: DataFrame, rule: str, *, agg: dict[str, str] | None = None) -> DataFrame:
    """Downsample bars; ``rule`` is a unit of date_trunc, or a duration such as '6 hours'.

    open first, high max, low min, close last, volume sum, others last; first and
    last skip nulls, empty bins don't appear.
    """
    default = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    names = {c: (agg or {}).get(c, default.get(c, "last")) for c in bars.columns if c not in ("ts", "asset")}

    def column(c: str, how: str) -> Column:
        if how == "first":
            return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
        if how == "last":
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
        return {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count}[how](c)

    bin_ = F.window("ts", rule)["start"] if re.match(r"\d", rule) else F.date_trunc(rule, F.col("ts"))
    out = bars.groupBy("asset", bin_.alias("bin")).agg(*[column(c, h).alias(c) for c, h in names.items()])
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names])
    return out.filter(some).select(F.col("bin").alias("ts"), "asset", *names)


def as_long(wide: DataFrame, *, value_name: str = "value", ts: str = "ts") -> DataFrame:
    cols = [c for c in wide.columns if c != ts]
    return wide.unpivot(ts, cols, "asset", value_name)


def as_wide(long: DataFrame, *, ts: str = "ts", asset: str = "asset", value: str = "value", assets: list[str] | None = None) -> DataFrame:
    """Date by asset; a repeated (ts, asset) raises when the result is computed."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated (ts, asset)"))).otherwise(F.first(value))
    single = long.groupBy(ts, asset).agg(once.cast(dict(long.dtypes)[value]).alias(value))
    pivot = single.groupBy(ts)
    return (pivot.pivot(asset, assets) if assets else pivot.pivot(asset)).agg(F.first(value))


def forward_fill(bars: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Last known prices onward, volume untouched."""
    w = running("asset")
    return bars.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in fields if c in bars.columns})


def resolve_benchmark(returns: DataFrame, benchmark: DataFrame | str | None) -> DataFrame | None:
    """(ts, bench) from a frame of returns, or from one of the series."""
    if benchmark is None:
        return None
    if isinstance(benchmark, str):
        return returns.filter(F.col("series") == benchmark).select("ts", F.col("ret").alias("bench"))
    name = "bench" if "bench" in benchmark.columns else "ret"
    return benchmark.select("ts", F.col(name).alias("bench"))


def staged(returns: DataFrame, *, alpha: float = 0.95, key: str = "series") -> DataFrame:
    """Returns with wealth, peak, drawdown, lags and value at risk: one shuffle, one sort by series."""
    w = running(key)
    out = returns.withColumn("wealth", F.product(1 + F.coalesce(F.col("ret"), F.lit(0.0))).over(w))
    out = out.withColumn("peak", F.max("wealth").over(w))
    out = out.withColumns({"dd": F.try_divide(F.col("wealth"), F.col("peak")) - 1} | {f"lag{k}": F.lag("ret", k).over(ordered(key)) for k in (1, 2, 3)})
    return out.withColumn("var", F.percentile("ret", F.lit(1 - alpha)).over(Window.partitionBy(key)))
