"""More indicators: window expressions where a window is enough, one pass per asset where a value feeds on the last."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import ordered, running, trailing
from .indicators import _grouped, _keep, _smooth, _true_range, register_indicator

# columns are made when they are used: there may be no session yet
def O() -> Column:
    return F.col("open")


def H() -> Column:
    return F.col("high")


def L() -> Column:
    return F.col("low")


def C() -> Column:
    return F.col("close")


def V() -> Column:
    return F.col("volume")



def _over(n: int, value: Column, of: str = "close") -> Column:
    """A window value where all n rows have ``of``."""
    return F.when(F.count(of).over(trailing(n, "asset")) == n, value)


def _sma(n: int, c: str = "close") -> Column:
    return _over(n, F.avg(c).over(trailing(n, "asset")), c)


def _numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pos", F.row_number().over(ordered("asset")))


def _simple(name: str, value) -> None:
    register_indicator(name)(lambda bars: _keep(bars, **{name: value()}))


_simple("avgprice", lambda: (O() + H() + L() + C()) / 4)
_simple("medprice", lambda: (H() + L()) / 2)
_simple("typprice", lambda: (H() + L() + C()) / 3)
_simple("wclprice", lambda: (H() + L() + 2 * C()) / 4)
_simple("bop", lambda: F.coalesce(F.try_divide(C() - O(), H() - L()), F.lit(0.0)))


@register_indicator("midpoint")
def midpoint(bars: DataFrame, n: int = 14) -> DataFrame:
    w = trailing(n, "asset")
    return _keep(bars, midpoint=_over(n, (F.max("close").over(w) + F.min("close").over(w)) / 2))


@register_indicator("midprice")
def midprice(bars: DataFrame, n: int = 14) -> DataFrame:
    w = trailing(n, "asset")
    return _keep(bars, midprice=_over(n, (F.max("high").over(w) + F.min("low").over(w)) / 2))


@register_indicator("minmax")
def minmax(bars: DataFrame, n: int = 30) -> DataFrame:
    w = trailing(n, "asset")
    return _keep(bars, min=_over(n, F.min("close").over(w)), max=_over(n, F.max("close").over(w)))


@register_indicator("sum")
def rolling_sum(bars: DataFrame, n: int = 30) -> DataFrame:
    return _keep(bars, sum=_over(n, F.sum("close").over(trailing(n, "asset"))))


@register_indicator("stddev")
def stddev(bars: DataFrame, n: int = 5, k: float = 1.0) -> DataFrame:
    return _keep(bars, stddev=_over(n, k * F.stddev_pop("close").over(trailing(n, "asset"))))


@register_indicator("var")
def var(bars: DataFrame, n: int = 5) -> DataFrame:
    return _keep(bars, var=_over(n, F.var_pop("close").over(trailing(n, "asset"))))


def _rate(name: str, of) -> None:
    def f(bars: DataFrame, n: int = 10) -> DataFrame:
        return _keep(bars, **{name: of(C(), F.lag("close", n).over(ordered("asset")))})

    register_indicator(name)(f)


_rate("rocp", lambda c, p: F.try_divide(c - p, p))
_rate("rocr", lambda c, p: F.try_divide(c, p))
_rate("rocr100", lambda c, p: F.try_divide(c, p) * 100)


def _aroon(bars: DataFrame, n: int) -> tuple[DataFrame, Column, Column]:
    """Of n + 1 bars, how near the latest highest high and lowest low are."""
    w = trailing(n + 1, "asset")
    b = _numbered(bars)
    top = F.max(F.struct(H(), "pos")).over(w)["pos"]
    bottom = -F.min(F.struct(L(), (-F.col("pos")).alias("back"))).over(w)["back"]
    share = lambda at: _over(n + 1, (F.lit(n) - (F.col("pos") - at)) * 100.0 / n)
    return b, share(top), share(bottom)


@register_indicator("aroon")
def aroon(bars: DataFrame, n: int = 14) -> DataFrame:
    b, up, down = _aroon(bars, n)
    return _keep(b, aroon_up=up, aroon_down=down)


@register_indicator("aroonosc")
def aroonosc(bars: DataFrame, n: int = 14) -> DataFrame:
    b, up, down = _aroon(bars, n)
    return _keep(b, aroonosc=up - down)


@register_indicator("cmo")
def cmo(bars: DataFrame, n: int = 14) -> DataFrame:
    """Chande's oscillator: sums of rises and falls of n steps."""
    b = bars.withColumn("step", C() - F.lag("close").over(ordered("asset")))
    w = trailing(n, "asset")
    up, down = (F.sum(F.greatest(F.lit(0.0), s * F.col("step"))).over(w) for s in (1, -1))
    return _keep(b, cmo=_over(n, F.coalesce(F.try_divide(100 * (up - down), up + down), F.lit(0.0)), "step"))


@register_indicator("mfi")
def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index: flow of rising typical prices against all flow."""
    b = bars.withColumn("tp", (H() + L() + C()) / 3)
    b = b.withColumn("step", F.col("tp") - F.lag("tp").over(ordered("asset")))
    w, flow = trailing(n, "asset"), F.col("tp") * V()
    up, down = (F.sum(F.when(on, flow).otherwise(0.0)).over(w) for on in (F.col("step") > 0, F.col("step") < 0))
    return _keep(b, mfi=_over(n, F.coalesce(F.try_divide(100 * up, up + down), F.lit(50.0)), "step"))


@register_indicator("ultosc")
def ultosc(bars: DataFrame, a: int = 7, b: int = 14, c: int = 28) -> DataFrame:
    """Ultimate oscillator: buying pressure over true range in three windows, weighted 4, 2, 1."""
    x = bars.withColumn("pc", F.lag("close").over(ordered("asset")))
    x = x.withColumns({"bp": C() - F.least(L(), F.col("pc")), "rng": F.greatest(H(), F.col("pc")) - F.least(L(), F.col("pc"))})
    x = x.withColumns({k: F.when(F.col("pc").isNotNull(), F.col(k)) for k in ("bp", "rng")})
    part = lambda n: F.try_divide(F.sum("bp").over(trailing(n, "asset")), F.sum("rng").over(trailing(n, "asset")))
    return _keep(x, ultosc=_over(c, 100 * (4 * part(a) + 2 * part(b) + part(c)) / 7, "pc"))


def _regression(name: str, of) -> None:
    """Least-squares line of the last n closes over the bar number."""

    def f(bars: DataFrame, n: int = 14) -> DataFrame:
        w = trailing(n, "asset")
        slope, mean = F.regr_slope("close", "pos").over(w), F.avg("close").over(w)
        return _keep(_numbered(bars), **{name: _over(n, of(slope, mean, n))})

    register_indicator(name)(f)


_regression("linearreg", lambda s, m, n: m + s * ((n - 1) / 2))
_regression("linearreg_slope", lambda s, m, n: s)
_regression("linearreg_intercept", lambda s, m, n: m - s * ((n - 1) / 2))
_regression("linearreg_angle", lambda s, m, n: F.degrees(F.atan(s)))
_regression("tsf", lambda s, m, n: m + s * ((n + 1) / 2))


@register_indicator("trima")
def trima(bars: DataFrame, n: int = 30) -> DataFrame:
    """Mean of a mean: triangular weights."""
    a, b = (n + 1) // 2, n // 2 + 1
    return _keep(bars.withColumn("inner", _sma(a)), trima=_sma(b, "inner"))


def _location() -> Column:
    return F.coalesce(F.try_divide((C() - L()) - (H() - C()), H() - L()), F.lit(0.0))


@register_indicator("ad")
def ad(bars: DataFrame) -> DataFrame:
    """Accumulation and distribution line."""
    return _keep(bars.withColumn("flow", _location() * V()), ad=F.sum("flow").over(running("asset")))


@register_indicator("cmf")
def cmf(bars: DataFrame, n: int = 20) -> DataFrame:
    """Chaikin money flow."""
    b, w = bars.withColumn("flow", _location() * V()), trailing(n, "asset")
    return _keep(b, cmf=_over(n, F.try_divide(F.sum("flow").over(w), F.sum("volume").over(w))))


@register_indicator("donchian")
def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    w = trailing(n, "asset")
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    return _keep(bars, upper=_over(n, hi), middle=_over(n, (hi + lo) / 2), lower=_over(n, lo))


@register_indicator("stochf")
def stochf(bars: DataFrame, n: int = 5, d: int = 3) -> DataFrame:
    w = trailing(n, "asset")
    lo, hi = F.min("low").over(w), F.max("high").over(w)
    return _keep(bars.withColumn("k", _over(n, F.try_divide(C() - lo, hi - lo) * 100)), fastk=F.col("k"), fastd=_sma(d, "k"))


@register_indicator("correl")
def correl(bars: DataFrame, n: int = 30) -> DataFrame:
    """Correlation of highs and lows."""
    return _keep(bars, correl=_over(n, F.corr("high", "low").over(trailing(n, "asset"))))


@register_indicator("beta")
def beta(bars: DataFrame, n: int = 5) -> DataFrame:
    """Slope of the changes of lows over the changes of highs."""
    w = ordered("asset")
    b = bars.withColumns({f"d{c}": F.try_divide(F.col(c), F.lag(c).over(w)) - 1 for c in ("high", "low")})
    return _keep(b, beta=_over(n, F.regr_slope("dlow", "dhigh").over(trailing(n, "asset")), "dhigh"))


@register_indicator("apo")
def apo(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    return _keep(bars, apo=_sma(fast) - _sma(slow))


@register_indicator("ppo")
def ppo(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    return _keep(bars, ppo=F.try_divide(_sma(fast) - _sma(slow), _sma(slow)) * 100)


@register_indicator("vwap")
def vwap(bars: DataFrame, n: int = 14) -> DataFrame:
    b, w = bars.withColumn("flow", (H() + L() + C()) / 3 * V()), trailing(n, "asset")
    return _keep(b, vwap=_over(n, F.try_divide(F.sum("flow").over(w), F.sum("volume").over(w))))


@register_indicator("accbands")
def accbands(bars: DataFrame, n: int = 20) -> DataFrame:
    """Acceleration bands."""
    spread = F.coalesce(F.try_divide(4 * (H() - L()), H() + L()), F.lit(0.0))
    b = bars.withColumns({"hi": H() * (1 + spread), "lo": L() * (1 - spread)})
    return _keep(b, upper=_sma(n, "hi"), middle=_sma(n), lower=_sma(n, "lo"))


@register_indicator("force")
def force(bars: DataFrame) -> DataFrame:
    return _keep(bars, force=(C() - F.lag("close").over(ordered("asset"))) * V())


@register_indicator("hlc_range")
def hlc_range(bars: DataFrame, n: int = 10) -> DataFrame:
    """Mean and widest bar range of a window."""
    b, w = bars.withColumn("rng", H() - L()), trailing(n, "asset")
    return _keep(b, mean_range=_over(n, F.avg("rng").over(w)), max_range=_over(n, F.max("rng").over(w)))


# --- candles: 100 bullish, -100 bearish, 0 none ------------------------------------------------------------
@dataclass
class Candle:
    """A bar's parts and the bar before it."""

    o: Column
    c: Column
    body: Column
    range: Column
    upper: Column
    lower: Column
    po: Column
    pc: Column


def _parts() -> Candle:
    o, c = O(), C()
    return Candle(o, c, F.abs(c - o), H() - L(), H() - F.greatest(o, c), F.least(o, c) - L(), F.col("popen"), F.col("pclose"))


def _candle(name: str, bullish=None, bearish=None) -> None:
    def f(bars: DataFrame) -> DataFrame:
        w, k = ordered("asset"), _parts()
        b = bars.withColumns({f"p{c}": F.lag(c).over(w) for c in ("open", "close")})
        found = F.when(bullish(k) if bullish else F.lit(False), 100.0).when(bearish(k) if bearish else F.lit(False), -100.0).otherwise(0.0)
        return _keep(b, **{name: found})

    register_indicator(name)(f)


_candle("cdl_doji", lambda k: k.body <= 0.1 * k.range)
_candle(
    "cdl_engulfing",
    lambda k: (k.pc < k.po) & (k.c > k.o) & (k.o <= k.pc) & (k.c >= k.po),
    lambda k: (k.pc > k.po) & (k.c < k.o) & (k.o >= k.pc) & (k.c <= k.po),
)
_candle(
    "cdl_harami",
    lambda k: (k.pc < k.po) & (k.c > k.o) & (k.o >= k.pc) & (k.c <= k.po),
    lambda k: (k.pc > k.po) & (k.c < k.o) & (k.o <= k.pc) & (k.c >= k.po),
)
_candle("cdl_hammer", lambda k: (k.body > 0) & (k.lower >= 2 * k.body) & (k.upper <= 0.1 * k.range))
_candle("cdl_shooting_star", None, lambda k: (k.body > 0) & (k.upper >= 2 * k.body) & (k.lower <= 0.1 * k.range))
_candle("cdl_marubozu", lambda k: (k.c > k.o) & (k.body >= 0.9 * k.range), lambda k: (k.c < k.o) & (k.body >= 0.9 * k.range))


# --- values that feed on the last one ----------------------------------------------------------------------
def _ema(x: np.ndarray, n: int) -> np.ndarray:
    return _smooth(x, n, 2 / (n + 1))


def _recursive(name: str, outputs: tuple[str, ...], compute) -> None:
    def f(bars: DataFrame, **params) -> DataFrame:
        def run(r: pd.DataFrame) -> dict[str, np.ndarray]:
            with np.errstate(divide="ignore", invalid="ignore"):
                out = compute(r, **params)
            return out if isinstance(out, dict) else {outputs[0]: out}

        return _grouped(bars, outputs, run)

    register_indicator(name)(f)


def _close(r: pd.DataFrame) -> np.ndarray:
    return r["close"].to_numpy(float)


def _dema(r, n: int = 20):
    one = _ema(_close(r), n)
    return 2 * one - _ema(one, n)


def _tema(r, n: int = 20):
    one = _ema(_close(r), n)
    two = _ema(one, n)
    return 3 * one - 3 * two + _ema(two, n)


def _t3(r, n: int = 5, v: float = 0.7):
    e = [_close(r)]
    for _ in range(6):
        e.append(_ema(e[-1], n))
    return -(v**3) * e[6] + 3 * (v**2 + v**3) * e[5] - 3 * (2 * v**2 + v + v**3) * e[4] + (1 + 3 * v + v**3 + 3 * v**2) * e[3]


def _trix(r, n: int = 15):
    x = _close(r)
    for _ in range(3):
        x = _ema(x, n)
    before = np.concatenate([[np.nan], x[:-1]])
    return 100 * (x / before - 1)


def _kama(r, n: int = 10, fast: int = 2, slow: int = 30):
    """Kaufman's average: the rate follows the path's efficiency."""
    x = _close(r)
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    value = x[n - 1]
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    path = np.abs(np.diff(x, prepend=np.nan))
    for t in range(n, len(x)):
        whole = path[t - n + 1 : t + 1].sum()
        efficiency = abs(x[t] - x[t - n]) / whole if whole else 0.0
        value += (efficiency * (a - b) + b) ** 2 * (x[t] - value)
        out[t] = value
    return out


def _natr(r, n: int = 14):
    return 100 * _smooth(_true_range(r), n, 1 / n) / _close(r)


def _directional(r, n: int):
    h, lo = r["high"].to_numpy(float), r["low"].to_numpy(float)
    up, down = np.diff(h, prepend=np.nan), -np.diff(lo, prepend=np.nan)
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(up), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    return _smooth(plus, n, 1 / n), _smooth(minus, n, 1 / n)


def _dm(r, n: int = 14):
    plus, minus = _directional(r, n)
    return {"plus_dm": plus, "minus_dm": minus}


def _di(r, n: int = 14):
    plus, minus = _directional(r, n)
    tr = np.where(np.arange(len(r)) == 0, np.nan, _true_range(r))
    atr = _smooth(tr, n, 1 / n)
    p, m = 100 * plus / atr, 100 * minus / atr
    return {"plus_di": p, "minus_di": m, "dx": np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.where(np.isnan(p), np.nan, 0.0))}


def _adosc(r, fast: int = 3, slow: int = 10):
    h, lo, c, v = (r[k].to_numpy(float) for k in ("high", "low", "close", "volume"))
    width = h - lo
    line = np.cumsum(np.where(width > 0, ((c - lo) - (h - c)) / np.where(width > 0, width, 1), 0.0) * v)
    return _ema(line, fast) - _ema(line, slow)


def _rsi(x: np.ndarray, n: int) -> np.ndarray:
    d = np.diff(x, prepend=np.nan)
    up, down = (_smooth(np.where(np.isnan(d), np.nan, np.maximum(s * d, 0)), n, 1 / n) for s in (1, -1))
    return np.where(up + down > 0, 100 * up / (up + down), np.where(np.isnan(up), np.nan, 50.0))


def _stochrsi(r, n: int = 14, k: int = 14, d: int = 3):
    s = pd.Series(_rsi(_close(r), n))
    lo, hi = s.rolling(k).min(), s.rolling(k).max()
    fast = ((s - lo) / (hi - lo).where(hi > lo) * 100).where(lo.isna() | (hi > lo), 0.0)
    return {"fastk": fast.to_numpy(), "fastd": fast.rolling(d).mean().to_numpy()}


def _sar(r, step: float = 0.02, most: float = 0.2):
    """Parabolic stop and reverse: the stop closes in on the extreme and turns when it is touched."""
    h, lo = r["high"].to_numpy(float), r["low"].to_numpy(float)
    out = np.full(len(h), np.nan)
    if len(h) < 2:
        return out
    rising = not (lo[0] - lo[1] > h[1] - h[0] and lo[0] - lo[1] > 0)
    extreme, stop, rate = (h[1], lo[0], step) if rising else (lo[1], h[0], step)
    for t in range(1, len(h)):
        touched = lo[t] <= stop if rising else h[t] >= stop
        if touched:
            rising = not rising
            stop = max(extreme, h[t], h[t - 1]) if not rising else min(extreme, lo[t], lo[t - 1])
            out[t] = stop
            extreme, rate = (h[t], step) if rising else (lo[t], step)
        else:
            out[t] = stop
            if (h[t] > extreme) if rising else (lo[t] < extreme):
                extreme, rate = (h[t] if rising else lo[t]), min(rate + step, most)
        stop += rate * (extreme - stop)
        stop = min(stop, lo[t], lo[t - 1]) if rising else max(stop, h[t], h[t - 1])
    return out


def _keltner(r, n: int = 20, k: float = 2.0):
    mid, atr = _ema(_close(r), n), _smooth(_true_range(r), n, 1 / n)
    return {"upper": mid + k * atr, "middle": mid, "lower": mid - k * atr}


def _hma(r, n: int = 16):
    def wma(x: np.ndarray, k: int) -> np.ndarray:
        weights = np.arange(1, k + 1)
        out = np.full(len(x), np.nan)
        if len(x) >= k:
            out[k - 1 :] = np.lib.stride_tricks.sliding_window_view(x, k) @ weights / weights.sum()
        return out

    x = _close(r)
    return wma(2 * wma(x, n // 2) - wma(x, n), max(1, int(math.sqrt(n))))


for _name, _outputs, _f in (
    ("dema", ("dema",), _dema), ("tema", ("tema",), _tema), ("t3", ("t3",), _t3), ("trix", ("trix",), _trix), ("kama", ("kama",), _kama), ("natr", ("natr",), _natr),
    ("dm", ("plus_dm", "minus_dm"), _dm), ("di", ("plus_di", "minus_di", "dx"), _di), ("adosc", ("adosc",), _adosc), ("stochrsi", ("fastk", "fastd"), _stochrsi),
    ("sar", ("sar",), _sar), ("keltner", ("upper", "middle", "lower"), _keltner), ("hma", ("hma",), _hma),
):
    _recursive(_name, _outputs, _f)
