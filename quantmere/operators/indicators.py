"""Technical indicators from their published definitions, and feature pipelines.

Fixed windows are window expressions; recursive smoothers run per asset in a
grouped map, or as a fold over the asset's ordered array where only the last
step is needed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import ordered, running, trailing

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register_indicator(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _REGISTRY[name] = f
        return f

    return add


def list_indicators() -> list[str]:
    return sorted(_REGISTRY)


def indicator(name: str, bars: DataFrame, **params) -> DataFrame:
    """(asset, ts, <outputs>) of a registered indicator."""
    return _REGISTRY[name](bars, **params)


def _full(n: int, value, col: str = "close"):
    return F.when(F.count(col).over(trailing(n, "asset")) == n, value)


def _keep(bars: DataFrame, **cols) -> DataFrame:
    return bars.select("asset", "ts", *[c.alias(k) for k, c in cols.items()])


@register_indicator("sma")
def sma(bars: DataFrame, n: int = 20) -> DataFrame:
    return _keep(bars, sma=_full(n, F.avg("close").over(trailing(n, "asset"))))


@register_indicator("wma")
def wma(bars: DataFrame, n: int = 20) -> DataFrame:
    w = ordered("asset")
    total = sum((F.lag("close", k).over(w) * (n - k) for k in range(1, n)), F.col("close") * n)
    return _keep(bars, wma=_full(n, total / (n * (n + 1) / 2)))


@register_indicator("bbands")
def bbands(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    w = trailing(n, "asset")
    mid, sd = F.avg("close").over(w), F.stddev_pop("close").over(w)
    return _keep(bars, upper=_full(n, mid + k * sd), middle=_full(n, mid), lower=_full(n, mid - k * sd))


@register_indicator("mom")
def mom(bars: DataFrame, n: int = 10) -> DataFrame:
    return _keep(bars, mom=F.col("close") - F.lag("close", n).over(ordered("asset")))


@register_indicator("roc")
def roc(bars: DataFrame, n: int = 10) -> DataFrame:
    return _keep(bars, roc=(F.try_divide(F.col("close"), F.lag("close", n).over(ordered("asset"))) - 1) * 100)


@register_indicator("stoch")
def stoch(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    w = trailing(n, "asset")
    lo, hi = F.min("low").over(w), F.max("high").over(w)
    k = _full(n, F.try_divide(F.col("close") - lo, hi - lo) * 100)
    b = bars.withColumn("k", k)
    return _keep(b, k=F.col("k"), d=F.when(F.count("k").over(trailing(d, "asset")) == d, F.avg("k").over(trailing(d, "asset"))))


@register_indicator("willr")
def willr(bars: DataFrame, n: int = 14) -> DataFrame:
    w = trailing(n, "asset")
    lo, hi = F.min("low").over(w), F.max("high").over(w)
    return _keep(bars, willr=_full(n, F.try_divide(hi - F.col("close"), hi - lo) * -100))


@register_indicator("cci")
def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    b = bars.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    w = trailing(n, "asset")
    b = b.withColumns({"m": F.avg("tp").over(w), "all": F.collect_list("tp").over(w)})
    dev = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("m"))) / n
    return _keep(b, cci=_full(n, F.try_divide(F.col("tp") - F.col("m"), dev * 0.015), "tp"))


@register_indicator("obv")
def obv(bars: DataFrame) -> DataFrame:
    w = ordered("asset")
    b = bars.withColumn("step", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume"))
    return _keep(b, obv=F.sum("step").over(running("asset")))


@register_indicator("tr")
def true_range(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(ordered("asset"))
    return _keep(bars, tr=F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def _grouped(bars: DataFrame, outputs: tuple[str, ...], compute: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """One recursive pass per asset."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts").reset_index(drop=True)
        out = rows[["asset", "ts"]].copy()
        for k, v in compute(rows).items():
            out[k] = v
        return out

    schema = "asset string, ts timestamp, " + ", ".join(f"{o} double" for o in outputs)
    return bars.select("asset", "ts", "open", "high", "low", "close", "volume").groupBy("asset").applyInPandas(run, schema)


def _smooth(x: np.ndarray, n: int, rate: float) -> np.ndarray:
    """Mean of the first n finite values, then x * rate + previous * (1 - rate)."""
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(np.isfinite(x))
    if len(ok) < n or n < 1:
        return out
    start = ok[n - 1]
    value = x[ok[:n]].mean()
    out[start] = value
    for t in range(start + 1, len(x)):
        if np.isfinite(x[t]):
            value += rate * (x[t] - value)
        out[t] = value
    return out


def _true_range(r: pd.DataFrame) -> np.ndarray:
    h, lo, c = (r[k].to_numpy(float) for k in ("high", "low", "close"))
    prev = np.concatenate([[np.nan], c[:-1]])
    return np.fmax(h - lo, np.fmax(np.abs(h - prev), np.abs(lo - prev)))


def wilder_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """(asset, ts, atr): mean true range of the first n bars, then Wilder's smoothing.

    Rows with a missing price are left out.
    """
    full = bars.dropna(subset=["open", "high", "low", "close"])
    return _grouped(full, ("atr",), lambda r: {"atr": _smooth(_true_range(r), n, 1 / n)})


register_indicator("atr")(wilder_atr)


@register_indicator("ema")
def ema(bars: DataFrame, n: int = 20) -> DataFrame:
    return _grouped(bars, ("ema",), lambda r: {"ema": _smooth(r["close"].to_numpy(float), n, 2 / (n + 1))})


@register_indicator("rsi")
def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    def compute(r: pd.DataFrame) -> dict[str, np.ndarray]:
        d = np.diff(r["close"].to_numpy(float), prepend=np.nan)
        up, down = _smooth(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n, 1 / n), _smooth(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n, 1 / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            return {"rsi": np.where(up + down > 0, 100 * up / (up + down), np.where(np.isnan(up), np.nan, 50.0))}

    return _grouped(bars, ("rsi",), compute)


@register_indicator("macd")
def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def compute(r: pd.DataFrame) -> dict[str, np.ndarray]:
        c = r["close"].to_numpy(float)
        line = _smooth(c, fast, 2 / (fast + 1)) - _smooth(c, slow, 2 / (slow + 1))
        sig = _smooth(line, signal, 2 / (signal + 1))
        return {"macd": line, "signal": sig, "hist": line - sig}

    return _grouped(bars, ("macd", "signal", "hist"), compute)


@register_indicator("adx")
def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    def compute(r: pd.DataFrame) -> dict[str, np.ndarray]:
        h, lo = r["high"].to_numpy(float), r["low"].to_numpy(float)
        up, down = np.diff(h, prepend=np.nan), -np.diff(lo, prepend=np.nan)
        plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
        minus = np.where(np.isnan(up), np.nan, np.where((down > up) & (down > 0), down, 0.0))
        tr = np.where(np.arange(len(h)) == 0, np.nan, _true_range(r))
        atr = _smooth(tr, n, 1 / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            p, m = 100 * _smooth(plus, n, 1 / n) / atr, 100 * _smooth(minus, n, 1 / n) / atr
            dx = np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.where(np.isnan(p), np.nan, 0.0))
        return {"adx": _smooth(dx, n, 1 / n), "plus_di": p, "minus_di": m}

    return _grouped(bars, ("adx", "plus_di", "minus_di"), compute)


class FeaturePipeline:
    """Named indicators over one frame of bars; columns are prefixed with the step's name."""

    def __init__(self, steps: list[tuple[str, str, dict]]) -> None:
        self.steps = steps

    def transform(self, bars: DataFrame) -> DataFrame:
        out = bars.select("asset", "ts")
        for name, kind, params in self.steps:
            f = indicator(kind, bars, **params)
            cols = [c for c in f.columns if c not in ("asset", "ts")]
            out = out.join(f.select("asset", "ts", *[F.col(c).alias(f"{name}__{c}") for c in cols]), ["asset", "ts"])
        return out

    def pipeline_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.steps, sort_keys=True).encode()).hexdigest()[:16]


class FeatureStore:
    """Features cached in a store under prefix/dataset/hash."""

    def __init__(self, store, prefix: str = "features") -> None:
        self.store, self.prefix = store, prefix

    def key(self, dataset: str, pipeline: FeaturePipeline) -> str:
        return f"{self.prefix}/{dataset}/{pipeline.pipeline_hash()}"

    def get_or_compute(self, dataset: str, pipeline: FeaturePipeline, bars: DataFrame, *, force: bool = False) -> DataFrame:
        key = self.key(dataset, pipeline)
        if force or not self.store.exists(key):
            self.store.write(key, pipeline.transform(bars))
        return self.store.read(key)

    def invalidate(self, dataset: str, pipeline: FeaturePipeline) -> None:
        self.store.delete(self.key(dataset, pipeline))

    def list(self, dataset: str | None = None) -> list[str]:
        lead = self.prefix + "/" + (dataset + "/" if dataset else "")
        return [k for k in self.store.keys() if k.startswith(lead)]


