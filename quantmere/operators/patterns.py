"""Pattern events: grouped scans, signals, and price levels from conditions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formations as L
from .indicators import wilder_atr

EVENT_SCHEMA = (
    "pattern string, asset string, formation_start timestamp, formation_end timestamp, breakout_ts timestamp, entry_price double, breakout_price double, "
    "target_price double, stop_price double, quality double, variant string, direction string, pivots array<struct<ts:timestamp,price:double,kind:string>>, "
    "features map<string,double>, lines array<struct<first:int,last:int,slope:double,intercept:double,r2:double,touches:int,role:string>>"
)

EVENT_COLUMNS = (
    "pattern", "asset", "formation_start", "formation_end", "breakout_ts", "entry_price", "breakout_price", "target_price", "stop_price",
    "quality", "variant", "direction", "pivots", "features", "lines",
)


def pattern_events(bars: DataFrame, patterns: str | list[str], *, min_quality: float | None = None, tiers: tuple[tuple[int, ...], ...] = L.TIERS) -> DataFrame:
    """Events of the named formations; one sequential scan per asset, assets in parallel.

    Bars with a missing field are left out, as are assets without bars.
    """
    names = [patterns] if isinstance(patterns, str) else list(patterns)
    for n in names:
        if n not in L.FORMATIONS:
            raise ValueError(f"unknown formation {n!r}; known are {', '.join(L.FORMATIONS)}")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        f = {c: rows[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}
        good = np.isfinite(np.stack(list(f.values()))).all(0)
        f = {c: v[good] for c, v in f.items()}
        ts = rows["ts"].to_numpy()[good]
        out = []
        for name in names:
            for e in L.scan(name, f["high"], f["low"], f["close"], f["volume"], tiers=tiers, min_quality=min_quality):
                pivots = [{"ts": pd.Timestamp(ts[i]), "price": float(x), "kind": "HIGH" if k > 0 else "LOW"} for i, x, k in zip(e.at, e.price, e.kind, strict=True)]
                lines = [{"first": x.first, "last": x.last, "slope": x.slope, "intercept": x.intercept, "r2": x.r2, "touches": x.touches, "role": "upper" if x.upper else "lower"} for x in e.lines]
                out.append((name, key[0], ts[e.start], ts[e.end], ts[e.end], e.entry, e.entry, None, None, e.quality, e.variant, e.direction, pivots, e.features, lines))
        return pd.DataFrame(out, columns=EVENT_COLUMNS)

    rows = bars.select("asset", "ts", "open", "high", "low", "close", "volume")
    return rows.groupBy("asset").applyInPandas(run, EVENT_SCHEMA)


def swing_points(bars: DataFrame, order: int) -> DataFrame:
    """(asset, ts, kind, price): bars at least as extreme as all within ``order`` bars; windows only."""
    near = Window.partitionBy("asset").orderBy("ts").rowsBetween(-order, order)
    enough = F.count("*").over(Window.partitionBy("asset")) >= 2 * order + 1
    b = bars.withColumns({"top": F.col("high") >= F.max("high").over(near), "bottom": F.col("low") <= F.min("low").over(near), "enough": enough}).filter("enough")
    kinds = F.array(F.when(F.col("top"), F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("price"))), F.when(F.col("bottom"), F.struct(F.lit("LOW").alias("kind"), F.col("low").alias("price"))))
    return b.select("asset", "ts", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("p")).select("asset", "ts", "p.kind", "p.price")


def events_to_signal(events: DataFrame, bars: DataFrame, *, mode: str = "breakout", decay_bars: int = 5) -> DataFrame:
    """(asset, ts, signal) on every bar.

    breakout: 1 on the breakout bar; formation: 1 from start to end; decay: from 1
    on the breakout bar down to 0 over ``decay_bars`` bars, the larger where events
    overlap.  Events whose times are no bars don't count.
    """
    w = Window.partitionBy("asset").orderBy("ts")
    grid = bars.select("asset", "ts", F.row_number().over(w).alias("pos"))
    at = lambda c: events.filter(F.col(c).isNotNull()).select("asset", F.col(c).alias("ts")).distinct()
    if mode == "breakout":
        hit = at("breakout_ts").withColumn("signal", F.lit(1.0))
        return grid.join(hit, ["asset", "ts"], "left").select("asset", "ts", F.coalesce("signal", F.lit(0.0)).alias("signal"))
    if mode == "formation":
        # +1 at the start and -1 after the end; a running sum says whether a bar is inside any
        spans = events.join(grid.select("asset", F.col("ts").alias("formation_start"), F.col("pos").alias("p0")), ["asset", "formation_start"]).join(
            grid.select("asset", F.col("ts").alias("formation_end"), F.col("pos").alias("p1")), ["asset", "formation_end"]
        )
        edges = spans.select("asset", F.explode(F.array(F.struct(F.col("p0").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("p1") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
        steps = edges.groupBy("asset", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
        inside = grid.join(steps, ["asset", "pos"], "left").withColumn("n", F.sum(F.coalesce("d", F.lit(0))).over(w))
        return inside.select("asset", "ts", F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("signal"))
    if mode != "decay":
        raise ValueError("mode is 'breakout', 'formation' or 'decay'")
    if decay_bars <= 0:
        raise ValueError("decay_bars must be positive")
    hit = at("breakout_ts").withColumn("here", F.lit(True))
    marked = grid.join(hit, ["asset", "ts"], "left")
    last = F.max(F.when(F.col("here"), F.col("pos"))).over(w)  # the latest event decays least
    age = F.col("pos") - last
    value = F.when(age < decay_bars, 1 - age / max(decay_bars - 1, 1)).otherwise(0.0)
    return marked.select("asset", "ts", F.coalesce(value, F.lit(0.0)).alias("signal"))


class Direction(str, Enum):
    BULLISH = "bullish"
    BEARISH = "bearish"
    NEUTRAL = "neutral"


@dataclass(frozen=True)
class Condition:
    """Entry and exit rules of a pattern trade."""

    direction: str = "neutral"
    target_method: str = "measured_move"
    stop_method: str = "below_pivot"
    time_stop_bars: int | None = None
    atr_window: int = 14
    atr_multiple: float = 2.0
    fixed_pct: float = 0.05
    fib_multiple: float = 1.618

    def __post_init__(self) -> None:
        for value, allowed in ((self.direction, ("bullish", "bearish", "neutral")), (self.target_method, ("measured_move", "fixed_atr", "fibonacci")), (self.stop_method, ("below_pivot", "atr_multiple", "fixed_pct"))):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {allowed}")
        if self.atr_window < 1 or self.atr_multiple <= 0 or not 0 < self.fixed_pct < 1 or (self.time_stop_bars is not None and self.time_stop_bars < 1):
            raise ValueError("condition values out of range")

    def override(self, **changes) -> Condition:
        return replace(self, **changes)


def apply_condition(events: DataFrame, condition: Condition, bars: DataFrame) -> DataFrame:
    """Events with target_price and stop_price by the condition; both null where either can't be had.

    Needs pivots (array of kind and price).  The ATR of the breakout bar comes by
    an equi-join on (asset, time).
    """
    sign = {"bullish": 1, "bearish": -1}.get(condition.direction, 0)
    none = F.lit(None).cast("double")
    if not sign:
        return events.withColumn("target_price", none).withColumn("stop_price", none)
    atr = wilder_atr(bars, condition.atr_window).select("asset", F.col("ts").alias("breakout_ts"), F.lit(True).alias("__bar"), "atr")
    e = events.drop("target_price", "stop_price").join(atr, ["asset", "breakout_ts"], "left")
    entry = F.coalesce("breakout_price", "entry_price")
    valid = F.col("atr") > 0
    usable = F.when(valid, F.col("atr"))
    kind = "LOW" if sign > 0 else "HIGH"
    prices = F.transform(F.filter("pivots", lambda p: (p["kind"] == kind) & p["price"].isNotNull()), lambda p: p["price"])
    extreme = F.array_min(prices) if sign > 0 else F.array_max(prices)
    height = F.coalesce((entry - extreme) * sign, usable)
    target: Column = {
        "measured_move": entry + sign * height,
        "fibonacci": entry + sign * height * condition.fib_multiple,
        "fixed_atr": entry + sign * condition.atr_multiple * usable,
    }[condition.target_method]
    stop: Column = {
        "below_pivot": F.coalesce(extreme, entry - sign * condition.atr_multiple * usable),
        "atr_multiple": entry - sign * condition.atr_multiple * usable,
        "fixed_pct": entry * (1 - sign * condition.fixed_pct),
    }[condition.stop_method]
    ok = F.col("__bar") & (entry > 0) & (height > 0) & (target > 0) & (stop > 0)
    if "fixed_atr" in (condition.target_method,) or condition.stop_method == "atr_multiple":
        ok = ok & valid
    ok = F.coalesce(ok, F.lit(False))
    return e.withColumns({"target_price": F.when(ok, target), "stop_price": F.when(ok, stop)}).drop("__bar", "atr")
