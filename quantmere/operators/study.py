"""Event study: what prices did after events, by horizon, asset, quality and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .eda import numbered, ranks_of
from .indicators import wilder_atr

HORIZONS = (5, 10, 20, 60)


def event_paths(events: DataFrame, bars: DataFrame, *, horizons: tuple[int, ...] = HORIZONS, atr_window: int = 14, trade_direction: str = "long", throwback_window: int = 10) -> DataFrame:
    """One row per event and horizon with enough bars after it.

    entry is the breakout price (else the entry price), risk |entry - stop| or the
    ATR of the bar.  The window after each bar is aggregated once per bar by
    window functions, then the events pick their bars by an equi-join: the
    forward path is never expanded into rows.
    """
    if trade_direction not in ("long", "short"):
        raise ValueError("trade_direction is 'long' or 'short'")
    sign = 1 if trade_direction == "long" else -1
    w = Window.partitionBy("asset").orderBy("ts")
    full = bars.dropna(subset=["open", "high", "low", "close"])
    cols: dict[str, Column] = {"left": F.count("*").over(w.rowsBetween(1, Window.unboundedFollowing))}
    for h in horizons:
        ahead = w.rowsBetween(1, h)
        cols |= {f"close_{h}": F.lead("close", h).over(w), f"high_{h}": F.max("high").over(ahead), f"low_{h}": F.min("low").over(ahead)}
    near = w.rowsBetween(1, throwback_window)
    cols |= {"back_low": F.min("low").over(near), "back_high": F.max("high").over(near)}
    b = full.withColumns(cols).join(wilder_atr(full, atr_window), ["asset", "ts"])
    e = events.join(b.select("asset", F.col("ts").alias("breakout_ts"), "atr", *cols), ["asset", "breakout_ts"])
    entry = F.coalesce("breakout_price", "entry_price")
    risk = F.coalesce(F.abs(entry - F.col("stop_price")), F.col("atr"))
    e = e.withColumns({"entry": entry, "risk": risk}).filter((F.col("entry") > 0) & (F.col("risk") > 0))
    per = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"close_{h}").alias("close_h"), F.col(f"high_{h}").alias("high_h"), F.col(f"low_{h}").alias("low_h")) for h in horizons])
    x = e.withColumn("h", F.explode(per)).filter(F.col("left") >= F.col("h.horizon"))
    best, worst = (F.col("h.high_h"), F.col("h.low_h")) if sign > 0 else (F.col("h.low_h"), F.col("h.high_h"))
    touch = F.col("back_low") <= F.col("entry") if sign > 0 else F.col("back_high") >= F.col("entry")
    return x.select(
        "asset", "breakout_ts", "quality", "entry", "risk", F.col("h.horizon").alias("horizon"),
        (sign * (F.try_divide(F.col("h.close_h"), F.col("entry")) - 1)).alias("fwd"),
        (sign * (F.col("h.close_h") - F.col("entry")) / F.col("risk")).alias("r_multiple"),
        F.greatest(F.lit(0.0), sign * (best - F.col("entry")) / F.col("risk")).alias("mfe"),
        F.greatest(F.lit(0.0), -sign * (worst - F.col("entry")) / F.col("risk")).alias("mae"),
        touch.alias("throwback"),
    )


def path_metrics() -> dict[str, Column]:
    mfe, mae = F.avg("mfe"), F.avg("mae")
    return {
        "n_events": F.count("*"),
        "hit_rate": F.avg((F.col("fwd") > 0).cast("double")),
        "expectancy": F.avg("r_multiple"),
        "edge_ratio": F.when(mae > 0, mfe / mae),
        "mfe_atr": mfe,
        "mae_atr": mae,
        "mae_p95_atr": F.percentile("mae", F.lit(0.95)),
        "throwback": F.avg(F.col("throwback").cast("double")),
    }


def _ranked(paths: DataFrame, *keys: str) -> DataFrame:
    """Average ranks of quality and forward return inside the keys, by two-level prefix sums: a key may hold all events."""
    p = paths.select(*keys, "quality", "fwd")
    out = p
    for c in ("quality", "fwd"):
        out = out.join(ranks_of(p.select(*keys, c), c, *keys), [*keys, c])
    return out.withColumnsRenamed({"quality__rank": "rq", "fwd__rank": "rf"})


def information_coefficient(paths: DataFrame, least: int = 5) -> DataFrame:
    """(horizon, ic): Spearman of quality and forward return; null below five events."""
    r = _ranked(paths.filter("quality IS NOT NULL AND fwd IS NOT NULL"), "horizon")
    ic = F.corr("rq", "rf")
    return r.groupBy("horizon").agg(F.when((F.count("*") >= least) & ~F.isnan(ic), ic).alias("ic"))


def icir(paths: DataFrame, *, period: str = "year", least: int = 5, periods: int = 3) -> DataFrame:
    """(horizon, icir): mean over deviation (population) of the periods' coefficients."""
    p = paths.filter("quality IS NOT NULL AND fwd IS NOT NULL").withColumn("period", F.date_trunc(period, "breakout_ts"))
    ic = F.corr("rq", "rf")
    by = _ranked(p, "horizon", "period").groupBy("horizon", "period").agg(F.when((F.count("*") >= least) & ~F.isnan(ic), ic).alias("ic")).filter("ic IS NOT NULL")
    return by.groupBy("horizon").agg(F.when(F.count("*") >= periods, F.try_divide(F.avg("ic"), F.stddev_pop("ic"))).alias("icir"))


def baseline_hit(events: DataFrame, bars: DataFrame, *, horizons: tuple[int, ...] = HORIZONS, trade_direction: str = "long") -> DataFrame:
    """(horizon, baseline_hit): each asset's share of bars that moved the right way, weighted by its events."""
    sign = 1 if trade_direction == "long" else -1
    w = Window.partitionBy("asset").orderBy("ts")
    ahead = bars.filter("close IS NOT NULL").withColumns({f"d{h}": sign * (F.lead("close", h).over(w) - F.col("close")) for h in horizons})
    per = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"d{h}").alias("d")) for h in horizons])
    moves = ahead.withColumn("h", F.explode(per)).select("asset", "h.*").filter("d IS NOT NULL")
    share = moves.groupBy("asset", "horizon").agg(F.avg((F.col("d") > 0).cast("double")).alias("p"))
    n = events.groupBy("asset").agg(F.count("*").alias("n"))
    return share.join(n, "asset").groupBy("horizon").agg(F.try_divide(F.sum(F.col("p") * F.col("n")), F.sum("n")).alias("baseline_hit"))


def evaluate(events: DataFrame, bars: DataFrame, *, horizons: tuple[int, ...] = HORIZONS, atr_window: int = 14, trade_direction: str = "long", baseline: bool = True) -> DataFrame:
    """One row per horizon: counts, hit rates, expectancy, excursions, coefficients."""
    paths = event_paths(events, bars, horizons=horizons, atr_window=atr_window, trade_direction=trade_direction)
    out = paths.groupBy("horizon").agg(*[c.alias(n) for n, c in path_metrics().items()])
    out = out.join(information_coefficient(paths), "horizon", "left").join(icir(paths), "horizon", "left")
    if baseline:
        out = out.join(baseline_hit(events, bars, horizons=horizons, trade_direction=trade_direction), "horizon", "left")
    return out


def quality_buckets(events: DataFrame, bars: DataFrame, *, horizon: int = 20, n_buckets: int = 5, **options) -> DataFrame:
    """Metrics of quantile buckets of quality: linear edges, equal edges once, closed on the right."""
    paths = event_paths(events, bars, horizons=(horizon,), **options).filter("quality IS NOT NULL")
    edges = paths.agg(F.array_distinct(F.percentile("quality", F.array(*[F.lit(k / n_buckets) for k in range(n_buckets + 1)]))).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    bucket = F.size(F.filter(inner, lambda x: x < F.col("quality"))) + 1
    placed = paths.join(F.broadcast(edges)).withColumn("bucket", bucket)  # a single row of edges
    return placed.groupBy("bucket").agg(*[c.alias(n) for n, c in path_metrics().items()], F.min("quality").alias("quality_min"), F.max("quality").alias("quality_max"))


def per_asset(events: DataFrame, bars: DataFrame, *, horizon: int = 20, **options) -> DataFrame:
    paths = event_paths(events, bars, horizons=(horizon,), **options)
    return paths.groupBy("asset").agg(*[c.alias(n) for n, c in path_metrics().items()])


def time_stability(events: DataFrame, bars: DataFrame, *, horizon: int = 20, n_folds: int = 5, **options) -> DataFrame:
    """Metrics of folds of equal counts in time; the last takes the remainder."""
    paths = event_paths(events, bars, horizons=(horizon,), **options)
    placed = numbered(paths, "breakout_ts", "asset", name="pos")
    whole = paths.agg(F.count("*").alias("all"))  # one row
    size = F.greatest(F.floor(F.col("all") / n_folds), F.lit(1))
    fold = F.least(F.floor(F.col("pos") / size), F.lit(n_folds - 1)).cast("int") + 1
    paths = placed.join(F.broadcast(whole))
    return paths.withColumn("fold", fold).groupBy("fold").agg(*[c.alias(n) for n, c in path_metrics().items()], F.min("breakout_ts").alias("from_ts"), F.max("breakout_ts").alias("to_ts"))
