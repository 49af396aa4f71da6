"""Queries of the further indicators, with their DuckDB statements."""

from __future__ import annotations

from ..operators import indicators as I
from ..operators import indicators_more  # noqa: F401  (registers them)
from . import views as V
from .core_queries import register

_W = "(PARTITION BY asset ORDER BY ts)"
BARS = V.with_ctes(V.SQL_TICKS, V.SQL_BARS) + f""", x AS (SELECT *, (high + low + close) / 3 AS tp, row_number() OVER {_W} AS pos, lag(close) OVER {_W} AS pc, lag(open) OVER {_W} AS po,
    close - lag(close) OVER {_W} AS step, (high + low + close) / 3 - lag((high + low + close) / 3) OVER {_W} AS tstep, high / lag(high) OVER {_W} - 1 AS dhigh, low / lag(low) OVER {_W} - 1 AS dlow,
    coalesce(((close - low) - (high - close)) / NULLIF(high - low, 0), 0) * volume AS flow, coalesce(4 * (high - low) / NULLIF(high + low, 0), 0) AS spread FROM bars)"""


def w(n: int) -> str:
    return f"OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, value: str, of: str = "close") -> str:
    return f"CASE WHEN count({of}) {w(n)} = {n} THEN {value} END"


def sma(n: int, c: str = "close") -> str:
    return full(n, f"avg({c}) {w(n)}", c)


def aroon(of: str) -> str:
    return full(15, f"(14 - (pos - {of})) * 100.0 / 14")


_top = f"(max(struct_pack(h := high, p := pos)) {w(15)}).p"
_bottom = f"(-(min(struct_pack(l := low, p := -pos)) {w(15)}).p)"
_up, _down = (f"sum(greatest(0, {s}step)) {w(14)}" for s in ("", "-"))
_fup, _fdown = (f"sum(CASE WHEN tstep {s} 0 THEN tp * volume ELSE 0 END) {w(14)}" for s in (">", "<"))
_part = lambda n: f"(sum(CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END) {w(n)} / NULLIF(sum(CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END) {w(n)}, 0))"
_slope, _mean = f"regr_slope(close, pos) {w(14)}", f"avg(close) {w(14)}"
_fk = f"CASE WHEN count(close) {w(5)} = 5 THEN (close - min(low) {w(5)}) / NULLIF(max(high) {w(5)} - min(low) {w(5)}, 0) * 100 END"
_body, _range, _upper, _lower = "abs(close - open)", "(high - low)", "(high - greatest(open, close))", "(least(open, close) - low)"


def candle(bullish: str, bearish: str = "false") -> str:
    return f"CASE WHEN {bullish} THEN 100.0 WHEN {bearish} THEN -100.0 ELSE 0.0 END"


#: indicator -> output -> value over x
SQL: dict[str, dict[str, str]] = {
    "avgprice": {"avgprice": "(open + high + low + close) / 4"},
    "medprice": {"medprice": "(high + low) / 2"},
    "typprice": {"typprice": "tp"},
    "wclprice": {"wclprice": "(high + low + 2 * close) / 4"},
    "bop": {"bop": "coalesce((close - open) / NULLIF(high - low, 0), 0)"},
    "midpoint": {"midpoint": full(14, f"(max(close) {w(14)} + min(close) {w(14)}) / 2")},
    "midprice": {"midprice": full(14, f"(max(high) {w(14)} + min(low) {w(14)}) / 2")},
    "minmax": {"min": full(30, f"min(close) {w(30)}"), "max": full(30, f"max(close) {w(30)}")},
    "sum": {"sum": full(30, f"sum(close) {w(30)}")},
    "stddev": {"stddev": full(5, f"stddev_pop(close) {w(5)}")},
    "var": {"var": full(5, f"var_pop(close) {w(5)}")},
    "rocp": {"rocp": f"(close - lag(close, 10) OVER {_W}) / lag(close, 10) OVER {_W}"},
    "rocr": {"rocr": f"close / lag(close, 10) OVER {_W}"},
    "rocr100": {"rocr100": f"close / lag(close, 10) OVER {_W} * 100"},
    "aroon": {"aroon_up": aroon(_top), "aroon_down": aroon(_bottom)},
    "aroonosc": {"aroonosc": f"{aroon(_top)} - {aroon(_bottom)}"},
    "cmo": {"cmo": full(14, f"coalesce(100 * ({_up} - {_down}) / NULLIF({_up} + {_down}, 0), 0)", "step")},
    "mfi": {"mfi": full(14, f"coalesce(100 * {_fup} / NULLIF({_fup} + {_fdown}, 0), 50)", "tstep")},
    "ultosc": {"ultosc": full(28, f"100 * (4 * {_part(7)} + 2 * {_part(14)} + {_part(28)}) / 7", "pc")},
    "linearreg": {"linearreg": full(14, f"{_mean} + {_slope} * 6.5")},
    "linearreg_slope": {"linearreg_slope": full(14, _slope)},
    "linearreg_intercept": {"linearreg_intercept": full(14, f"{_mean} - {_slope} * 6.5")},
    "linearreg_angle": {"linearreg_angle": full(14, f"degrees(atan({_slope}))")},
    "tsf": {"tsf": full(14, f"{_mean} + {_slope} * 7.5")},
    "ad": {"ad": f"sum(flow) OVER {_W}"},
    "cmf": {"cmf": full(20, f"sum(flow) {w(20)} / NULLIF(sum(volume) {w(20)}, 0)")},
    "donchian": {"upper": full(20, f"max(high) {w(20)}"), "middle": full(20, f"(max(high) {w(20)} + min(low) {w(20)}) / 2"), "lower": full(20, f"min(low) {w(20)}")},
    "correl": {"correl": full(30, f"corr(high, low) {w(30)}")},
    "beta": {"beta": full(5, f"regr_slope(dlow, dhigh) {w(5)}", "dhigh")},
    "apo": {"apo": f"{sma(12)} - {sma(26)}"},
    "ppo": {"ppo": f"({sma(12)} - {sma(26)}) / {sma(26)} * 100"},
    "vwap": {"vwap": full(14, f"sum(tp * volume) {w(14)} / NULLIF(sum(volume) {w(14)}, 0)")},
    "accbands": {"upper": full(20, f"avg(high * (1 + spread)) {w(20)}"), "middle": sma(20), "lower": full(20, f"avg(low * (1 - spread)) {w(20)}")},
    "force": {"force": "step * volume"},
    "hlc_range": {"mean_range": full(10, f"avg(high - low) {w(10)}"), "max_range": full(10, f"max(high - low) {w(10)}")},
    "cdl_doji": {"cdl_doji": candle(f"{_body} <= 0.1 * {_range}")},
    "cdl_engulfing": {"cdl_engulfing": candle("pc < po AND close > open AND open <= pc AND close >= po", "pc > po AND close < open AND open >= pc AND close <= po")},
    "cdl_harami": {"cdl_harami": candle("pc < po AND close > open AND open >= pc AND close <= po", "pc > po AND close < open AND open <= pc AND close >= po")},
    "cdl_hammer": {"cdl_hammer": candle(f"{_body} > 0 AND {_lower} >= 2 * {_body} AND {_upper} <= 0.1 * {_range}")},
    "cdl_shooting_star": {"cdl_shooting_star": candle("false", f"{_body} > 0 AND {_upper} >= 2 * {_body} AND {_lower} <= 0.1 * {_range}")},
    "cdl_marubozu": {"cdl_marubozu": candle(f"close > open AND {_body} >= 0.9 * {_range}", f"close < open AND {_body} >= 0.9 * {_range}")},
}
#: Values that stay steady when the engines add in different orders.
DIGITS = {"midpoint": 5, "midprice": 5, "correl": 4, "beta": 3, "var": 5, "linearreg_angle": 4, "cmo": 4, "mfi": 4, "ad": 4, "ppo": 5}

for _n, _outputs in SQL.items():
    _digits = DIGITS.get(_n, 6)
    _cols = ", ".join(f'round(({v})::DOUBLE, {_digits}) + 0.0::DOUBLE AS "{o}"' for o, v in _outputs.items())
    register(f"ind_{_n}", f"{BARS} SELECT asset, ts, {_cols} FROM x", _digits)(lambda s, d, n=_n: I.indicator(n, V.bars(s, d)))
register("ind_stochf", f"{BARS}, k AS (SELECT asset, ts, {_fk} AS fastk FROM x) SELECT asset, ts, round(fastk, 5) + 0.0::DOUBLE AS fastk, round({full(3, f'avg(fastk) {w(3)}', 'fastk')}, 5) + 0.0::DOUBLE AS fastd FROM k", 5)(
    lambda s, d: I.indicator("stochf", V.bars(s, d))
)
register("ind_trima", f"{BARS}, k AS (SELECT asset, ts, {sma(15)} AS inn FROM x) SELECT asset, ts, round({full(16, f'avg(inn) {w(16)}', 'inn')}, 6) + 0.0::DOUBLE AS trima FROM k", 6)(lambda s, d: I.indicator("trima", V.bars(s, d)))
register("ind_cci", f"{BARS}, k AS (SELECT *, list(tp) {w(20)} AS near, avg(tp) {w(20)} AS m FROM x) SELECT asset, ts, round(CASE WHEN len(near) = 20 THEN (tp - m) / NULLIF(list_sum(list_transform(near, lambda v: abs(v - m))) / 20 * 0.015, 0) END, 4) + 0.0::DOUBLE AS cci FROM k", 4)(
    lambda s, d: I.indicator("cci", V.bars(s, d))
)


def smoothed(name: str, source: str, value: str, first: int, n: int, rate: str) -> str:
    """A recursive CTE: mean of n values from bar ``first`` on, then value * rate + last * (1 - rate)."""
    seed = first + n - 1
    return f"""{name} AS (SELECT asset, CAST({seed} AS BIGINT) AS pos, avg({value}) AS v FROM {source} WHERE pos BETWEEN {first} AND {seed} GROUP BY asset HAVING count({value}) = {n}
    UNION ALL SELECT r.asset, r.pos + 1, r.v + {rate} * (q.{value} - r.v) FROM {name} r JOIN {source} q ON q.asset = r.asset AND q.pos = r.pos + 1)"""


REC = BARS.replace("WITH ", "WITH RECURSIVE ", 1) + """, y AS MATERIALIZED (SELECT asset, ts, pos, close, greatest(step, 0) AS up, greatest(-step, 0) AS down, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN high - ph > pl - low AND high > ph THEN high - ph WHEN ph IS NOT NULL THEN 0 END AS plus, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low WHEN ph IS NOT NULL THEN 0 END AS minus
    FROM (SELECT *, lag(high) OVER (PARTITION BY asset ORDER BY ts) AS ph, lag(low) OVER (PARTITION BY asset ORDER BY ts) AS pl FROM x)), """
_wild = "(1.0 / 14)"
_ud = f"{smoothed('u', 'y', 'up', 2, 14, _wild)}, {smoothed('dn', 'y', 'down', 2, 14, _wild)}"
register("ind_rsi", f"{REC}{_ud} SELECT y.asset, y.ts, round(CASE WHEN u.v + dn.v > 0 THEN 100 * u.v / (u.v + dn.v) WHEN u.v IS NOT NULL THEN 50 END, 6) AS rsi FROM y LEFT JOIN u USING (asset, pos) LEFT JOIN dn USING (asset, pos)", 6)(
    lambda s, d: I.indicator("rsi", V.bars(s, d))
)
_em = lambda n: f"(2.0 / {n + 1})"
register(
    "ind_macd",
    f"{REC}{smoothed('f', 'y', 'close', 1, 12, _em(12))}, {smoothed('sl', 'y', 'close', 1, 26, _em(26))}, ln AS MATERIALIZED (SELECT asset, pos, f.v - sl.v AS m FROM f JOIN sl USING (asset, pos)), {smoothed('sg', 'ln', 'm', 26, 9, _em(9))} "
    "SELECT y.asset, y.ts, round(ln.m, 6) + 0.0::DOUBLE AS macd, round(sg.v, 6) + 0.0::DOUBLE AS signal, round(ln.m - sg.v, 6) + 0.0::DOUBLE AS hist FROM y LEFT JOIN ln USING (asset, pos) LEFT JOIN sg USING (asset, pos)",
    6,
)(lambda s, d: I.indicator("macd", V.bars(s, d)))
_dirs = f"{smoothed('pl2', 'y', 'plus', 2, 14, _wild)}, {smoothed('mi2', 'y', 'minus', 2, 14, _wild)}, {smoothed('tr2', 'y', 'tr', 2, 14, _wild)}, di AS MATERIALIZED (SELECT asset, pos, 100 * pl2.v / tr2.v AS p, 100 * mi2.v / tr2.v AS m, CASE WHEN pl2.v + mi2.v > 0 THEN 100 * abs(pl2.v - mi2.v) / (pl2.v + mi2.v) ELSE 0 END AS dx FROM pl2 JOIN mi2 USING (asset, pos) JOIN tr2 USING (asset, pos))"
register("ind_adx", f"{REC}{_dirs}, {smoothed('ax', 'di', 'dx', 15, 14, _wild)} SELECT y.asset, y.ts, round(ax.v, 6) AS adx, round(di.p, 6) AS plus_di, round(di.m, 6) AS minus_di FROM y LEFT JOIN di USING (asset, pos) LEFT JOIN ax USING (asset, pos)", 6)(
    lambda s, d: I.indicator("adx", V.bars(s, d))
)
register("ind_di", f"{REC}{_dirs} SELECT y.asset, y.ts, round(di.p, 6) AS plus_di, round(di.m, 6) AS minus_di, round(di.dx, 6) AS dx FROM y LEFT JOIN di USING (asset, pos)", 6)(lambda s, d: I.indicator("di", V.bars(s, d)))
register("ind_dm", f"{REC}{smoothed('pl2', 'y', 'plus', 2, 14, _wild)}, {smoothed('mi2', 'y', 'minus', 2, 14, _wild)} SELECT y.asset, y.ts, round(pl2.v, 6) AS plus_dm, round(mi2.v, 6) AS minus_dm FROM y LEFT JOIN pl2 USING (asset, pos) LEFT JOIN mi2 USING (asset, pos)", 6)(
    lambda s, d: I.indicator("dm", V.bars(s, d))
)
_e = _em(20)
_one = smoothed("e1", "y", "close", 1, 20, _e) + ", e1m AS MATERIALIZED (SELECT * FROM e1), " + smoothed("e2", "e1m", "v", 20, 20, _e)
register("ind_dema", f"{REC}{_one} SELECT y.asset, y.ts, round(2 * e1.v - e2.v, 6) AS dema FROM y LEFT JOIN e1 USING (asset, pos) LEFT JOIN e2 USING (asset, pos)", 6)(lambda s, d: I.indicator("dema", V.bars(s, d)))
register("ind_tema", f"{REC}{_one}, e2m AS MATERIALIZED (SELECT * FROM e2), {smoothed('e3', 'e2m', 'v', 39, 20, _e)} SELECT y.asset, y.ts, round(3 * e1.v - 3 * e2.v + e3.v, 6) AS tema FROM y LEFT JOIN e1 USING (asset, pos) LEFT JOIN e2 USING (asset, pos) LEFT JOIN e3 USING (asset, pos)", 6)(
    lambda s, d: I.indicator("tema", V.bars(s, d))
)
for _n in ("t3", "trix", "kama", "natr", "adosc", "stochrsi", "sar", "keltner", "hma"):
    register(f"ind_{_n}", None, 6)(lambda s, d, n=_n: I.indicator(n, V.bars(s, d)))
_bb = lambda sign: full(20, f"avg(close) {w(20)} {sign} 2 * stddev_pop(close) {w(20)}")
register(
    "feature_pipeline",
    f"{BARS} SELECT asset, ts, round({sma(5)}, 6) AS fast__sma, round({_bb('+')}, 6) AS bands__upper, round({sma(20)}, 6) AS bands__middle, round({_bb('-')}, 6) AS bands__lower FROM x",
    6,
)(lambda s, d: I.FeaturePipeline([("fast", "sma", {"n": 5}), ("bands", "bbands", {"n": 20})]).transform(V.bars(s, d)))
