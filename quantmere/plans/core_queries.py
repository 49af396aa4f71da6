"""Queries of scalar, benchmark, window and calendar operators, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import benchmark as B
from ..operators import calendar as C
from ..operators import rolling as R
from ..operators import summary as S
from ..operators.frames import staged
from . import views as V

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded: the two engines add in different orders."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def register(name: str, sql: str | None = None, digits: int = 8):
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir, f=f: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = sql
        return f

    return add


BASE = V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS, V.SQL_STAGED)
NEG, POS = "least(ret, 0)", "greatest(ret, 0)"
CAGR = "power(product(1 + ret), 252.0 / count(*)) - 1"
SHARPE = "avg(ret) / NULLIF(stddev_samp(ret), 0) * sqrt(252)"
SORTINO = "avg(ret) / NULLIF(sqrt(avg(power(least(ret, 0), 2))), 0) * sqrt(252)"
WIN = "avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)"
PAYOFF = "avg(ret) FILTER (WHERE ret > 0) / NULLIF(abs(avg(ret) FILTER (WHERE ret < 0)), 0)"
PF = f"sum({POS}) / NULLIF(-sum({NEG}), 0)"
TAIL = "abs(quantile_cont(ret, 0.95)) / NULLIF(abs(quantile_cont(ret, 0.05)), 0)"
PAIN = "avg(abs(dd))"
ULCER = "sqrt(avg(power(dd * 100, 2)))"
PENALTY = "CASE WHEN count(ret) < 5 THEN 1.0 ELSE 1 / sqrt(greatest(1 + 2 * (coalesce(corr(ret, lag1), 0) + coalesce(corr(ret, lag2), 0) + coalesce(corr(ret, lag3), 0)), 1e-8)) END"
SR = "avg(ret) / NULLIF(stddev_samp(ret), 0)"
#: metric -> aggregate over the staged view
SCALAR_SQL = {
    "total_return": "product(1 + ret) - 1",
    "cagr": CAGR,
    "volatility": "stddev_samp(ret) * sqrt(252)",
    "downside_volatility": f"sqrt(avg(power({NEG}, 2))) * sqrt(252)",
    "avg_return": "avg(ret)",
    "best": "max(ret)",
    "worst": "min(ret)",
    "win_rate": WIN,
    "avg_win": "avg(ret) FILTER (WHERE ret > 0)",
    "avg_loss": "avg(ret) FILTER (WHERE ret < 0)",
    "payoff_ratio": PAYOFF,
    "profit_factor": PF,
    "exposure": "avg(CASE WHEN ret IS NULL OR ret <> 0 THEN 1.0 ELSE 0.0 END)",
    "kelly_criterion": f"{WIN} - (1 - {WIN}) / NULLIF({PAYOFF}, 0)",
    "risk_of_ruin": "avg(CASE WHEN wealth < 1 THEN 1.0 ELSE 0.0 END)",
    "skew": "skewness(ret)",
    "kurtosis": "kurtosis(ret)",
    "sharpe": SHARPE,
    "sortino": SORTINO,
    "adjusted_sortino": f"({SORTINO}) / sqrt(2)",
    "calmar": f"({CAGR}) / NULLIF(abs(min(dd)), 0)",
    "omega": f"sum({POS}) / NULLIF(sum(greatest(-ret, 0)), 0)",
    "value_at_risk": "quantile_cont(ret, 0.05)",
    "cvar": "avg(ret) FILTER (WHERE ret <= v)",
    "tail_ratio": TAIL,
    "common_sense_ratio": f"({TAIL}) * ({PF})",
    "max_drawdown": "min(dd)",
    "ulcer_index": ULCER,
    "pain_index": PAIN,
    "pain_ratio": f"({CAGR}) / NULLIF({PAIN}, 0)",
    "gain_to_pain_ratio": f"sum(ret) / NULLIF(abs(sum({NEG})), 0)",
    "ulcer_performance_index": f"({CAGR}) / NULLIF({ULCER} / 100, 0)",
    "smart_sharpe": f"({SHARPE}) * ({PENALTY})",
    "smart_sortino": f"({SORTINO}) * ({PENALTY})",
    "probabilistic_sharpe_z": f"({SR}) * sqrt(count(ret) - 1) / sqrt(1 - skewness(ret) * ({SR}) + kurtosis(ret) / 4 * power({SR}, 2))",
}
for _name, _sql in SCALAR_SQL.items():
    # the annualised growth of hourly returns is large: six digits
    _digits = 4 if any(k in _name for k in ("cagr", "calmar", "pain_ratio", "performance")) else 7
    register(_name, f"{BASE}SELECT series, round({_sql}, {_digits}) AS {_name} FROM staged GROUP BY series", _digits)(
        lambda spark, sf_dir, n=_name: S.metric(V.returns(spark, sf_dir), n)
    )

_sum_sql = {"periods": "CAST(count(ret) AS DOUBLE)"} | {n: SCALAR_SQL[n] for n in M.SUMMARY if n != "periods"}
_cols = ", ".join(f"round({s}, 4) AS {n}" for n, s in _sum_sql.items())
register("batch_summary", f"{BASE}SELECT series, {_cols} FROM staged GROUP BY series", 4)(lambda spark, sf_dir: S.batch_summary(V.returns(spark, sf_dir)))
register("returns_stats", f"{BASE}, w AS (SELECT series, {_cols} FROM staged GROUP BY series) SELECT series, metric, value FROM (UNPIVOT w ON {', '.join(_sum_sql)} INTO NAME metric VALUE value)", 4)(
    lambda spark, sf_dir: S.returns_stats(V.returns(spark, sf_dir))
)

STREAK_CTES = """, s AS (SELECT *, CASE WHEN ret > 0 THEN 1 WHEN ret < 0 THEN -1 ELSE 0 END AS sg FROM staged),
  i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - row_number() OVER (PARTITION BY series, sg ORDER BY ts) AS isl FROM s),
  r AS (SELECT series, sg, isl, count(*) AS n FROM i GROUP BY ALL)"""
register(
    "streaks",
    BASE
    + STREAK_CTES
    + """
SELECT series, CAST(coalesce(max(n) FILTER (WHERE sg = 1), 0) AS BIGINT) AS consecutive_wins, CAST(coalesce(max(n) FILTER (WHERE sg = -1), 0) AS BIGINT) AS consecutive_losses FROM r GROUP BY series""",
)(lambda spark, sf_dir: S.streaks(V.returns(spark, sf_dir)))

#: Normal distribution function of z: the series of erf.
CDF = "0.5 * (1 + sign(z) * least(1.0, exp(-z * z / 2) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(NULLIF(abs(z), 0) / sqrt(2.0)) - lgamma(k + 1.5))))))"
register("probabilistic_sharpe_ratio", f"{BASE}, zz AS (SELECT series, {SCALAR_SQL['probabilistic_sharpe_z']} AS z FROM staged GROUP BY series) SELECT series, round({CDF}, 8) AS probabilistic_sharpe_ratio FROM zz")(
    lambda spark, sf_dir: staged(V.returns(spark, sf_dir)).groupBy("series").agg(M.probabilistic_sharpe_z().alias("z")).select("series", M.normal_cdf(F.col("z")).alias("probabilistic_sharpe_ratio"))
)

REL = V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS, V.SQL_BENCH, "p AS (SELECT r.series, r.ts, r.ret, b.bench FROM returns r JOIN bench b USING (ts))")
BETA = "covar_samp(ret, bench) / NULLIF(var_samp(bench), 0)"
UP = "avg(ret) FILTER (WHERE bench > 0) / NULLIF(avg(bench) FILTER (WHERE bench > 0), 0)"
DOWN = "avg(ret) FILTER (WHERE bench < 0) / NULLIF(avg(bench) FILTER (WHERE bench < 0), 0)"
RELATIVE_SQL = {
    "alpha": f"avg(ret) * 252 - ({BETA}) * avg(bench) * 252",
    "beta": BETA,
    "correlation": "corr(ret, bench)",
    "r_squared": "power(corr(ret, bench), 2)",
    "information_ratio": "avg(ret - bench) / NULLIF(stddev_samp(ret - bench), 0)",
    "tracking_error": "stddev_samp(ret - bench) * sqrt(252)",
    "up_capture": UP,
    "down_capture": DOWN,
    "capture_ratio": f"({UP}) / NULLIF({DOWN}, 0)",
    "treynor_ratio": f"avg(ret) * 252 / NULLIF({BETA}, 0)",
}
for _name, _sql in RELATIVE_SQL.items():
    register(_name, f"{REL}SELECT series, round({_sql}, 7) AS {_name} FROM p GROUP BY series", 7)(
        lambda spark, sf_dir, n=_name: B.with_benchmark(V.returns(spark, sf_dir), V.benchmark(spark, sf_dir)).groupBy("series").agg(B.RELATIVE[n]().alias(n))
    )
register("benchmark_aggregates", f"{REL}SELECT series, {', '.join(f'round({s}, 7) AS {n}' for n, s in RELATIVE_SQL.items())} FROM p GROUP BY series", 7)(
    lambda spark, sf_dir: B.benchmark_aggregates(B.with_benchmark(V.returns(spark, sf_dir), V.benchmark(spark, sf_dir)))
)

MONTHLY = "m AS (SELECT series, year(ts) AS y, month(ts) AS mo, product(1 + ret) - 1 AS ret FROM returns GROUP BY ALL), yy AS (SELECT series, year(ts) AS y, product(1 + ret) - 1 AS ret FROM returns GROUP BY ALL)"
CAL = V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS, MONTHLY)
register("monthly_returns", CAL + "SELECT series, CAST(y AS INTEGER) AS year, CAST(mo AS INTEGER) AS month, round(ret, 7) AS ret FROM m", 7)(lambda spark, sf_dir: C.monthly_returns(V.returns(spark, sf_dir)))
register("monthly_table", CAL + f"SELECT series, CAST(y AS INTEGER) AS year, {', '.join(f'round(max(ret) FILTER (WHERE mo = {k}), 7) AS {m}' for k, m in enumerate(C.MONTHS, 1))} FROM m GROUP BY ALL", 7)(
    lambda spark, sf_dir: C.monthly_table(V.returns(spark, sf_dir))
)
register("yearly_returns", CAL + "SELECT series, CAST(y AS INTEGER) AS year, round(ret, 7) AS ret FROM yy", 7)(lambda spark, sf_dir: C.yearly_returns(V.returns(spark, sf_dir)))
CAL_STATS = {"best_month": "max(ret)", "worst_month": "min(ret)", "positive_months": "count(*) FILTER (WHERE ret > 0)", "negative_months": "count(*) FILTER (WHERE ret < 0)", "best_year": "max(ret)", "worst_year": "min(ret)"}
for _name, _sql in CAL_STATS.items():
    _of = "yy" if "year" in _name else "m"
    _out = f"round({_sql}, 7)" if "_months" not in _name else _sql
    register(_name, CAL + f"SELECT series, {_out} AS {_name} FROM {_of} GROUP BY series", 7)(lambda spark, sf_dir, n=_name: C.calendar_stats(V.returns(spark, sf_dir)).select("series", n))

_cut = {"MTD": "date_trunc('month', a)", "3M": "a - INTERVAL 3 MONTH", "6M": "a - INTERVAL 6 MONTH", "YTD": "date_trunc('year', a)", "1Y": "a - INTERVAL 1 YEAR", "3Y": "a - INTERVAL 3 YEAR", "5Y": "a - INTERVAL 5 YEAR", "10Y": "a - INTERVAL 10 YEAR", "All": "a - INTERVAL 1000 YEAR"}
_per = " UNION ALL ".join(
    f"SELECT series, '{k}' AS period, round({'power(product(1 + ret), 252.0 / count(*)) - 1' if k in ('3Y', '5Y', '10Y', 'All') else 'product(1 + ret) - 1'}, 4) AS ret FROM an WHERE ts >= {v} GROUP BY series" for k, v in _cut.items()
)
register("period_returns", V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS, "an AS (SELECT *, max(ts) OVER (PARTITION BY series) AS a FROM returns)") + _per, 4)(lambda spark, sf_dir: C.period_returns(V.returns(spark, sf_dir)))

_dates = "d AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS ts FROM orders)"
_step = "b AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p, min(ts) OVER () AS lo FROM d) SELECT ts FROM b WHERE p IS NULL OR floor((epoch(ts) - epoch(lo)) / ({n} * 86400.0)) > floor((epoch(p) - epoch(lo)) / ({n} * 86400.0))"
_month = "mm AS (SELECT date_trunc('month', ts) AS m, max(ts) FILTER (WHERE day(ts) <= 1) AS upto, max(ts) AS en FROM d GROUP BY 1), f AS (SELECT min(m) AS f0 FROM mm) SELECT coalesce(upto, en) AS ts FROM mm, f WHERE date_diff('month', f0, m) % {n} = 0"
for _name, _body in {"daily": _step.format(n=1), "weekly": _step.format(n=7), "monthly": _month.format(n=1), "quarterly": _month.format(n=3)}.items():
    register(f"cadence_{_name}", f"WITH {_dates}, {_body}")(
        lambda spark, sf_dir, n=_name: C.cadence_triggers(V.read(spark, sf_dir, "orders").select(F.date_trunc("day", "o_orderdate").alias("ts")), n)
    )

register("drawdown_series", BASE + "SELECT series, ts, round(dd, 7) AS dd FROM staged", 7)(lambda spark, sf_dir: S.drawdown_series(V.returns(spark, sf_dir)))
_w = "OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
ROLL = V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS)
for _name, _sql in {
    "rolling_mean": f"avg(ret) {_w}",
    "rolling_std": f"stddev_samp(ret) {_w}",
    "rolling_sharpe": f"avg(ret) {_w} / NULLIF(stddev_samp(ret) {_w}, 0) * sqrt(252)",
    "rolling_sortino": f"avg(ret) {_w} / NULLIF(sqrt(avg(power(least(ret, 0), 2)) {_w}), 0) * sqrt(252)",
    "rolling_volatility": f"stddev_samp(ret) {_w} * sqrt(252)",
}.items():
    register(_name, ROLL + f"SELECT series, ts, round(CASE WHEN count(ret) {_w} = 63 THEN {_sql} END, 7) AS {_name} FROM returns", 7)(
        lambda spark, sf_dir, n=_name: getattr(R, n)(V.returns(spark, sf_dir)).select("series", "ts", n)
    )
_rb = f"covar_samp(ret, bench) {_w} / NULLIF(var_samp(bench) {_w}, 0)"
for _name, _sql in {"rolling_beta": _rb, "rolling_alpha": f"(avg(ret) {_w} - {_rb} * avg(bench) {_w}) * 252"}.items():
    register(_name, REL + f"SELECT series, ts, round(CASE WHEN count(ret) {_w} = 63 THEN {_sql} END, 6) AS {_name} FROM p", 6)(
        lambda spark, sf_dir, n=_name: getattr(R, n)(V.returns(spark, sf_dir), V.benchmark(spark, sf_dir))
    )

EPISODES = """, e1 AS (SELECT *, lag(ts) OVER w AS pts, lead(ts) OVER w AS nts, CASE WHEN lag(dd) OVER w IS NULL OR (dd < 0) <> (lag(dd) OVER w < 0) THEN 1 ELSE 0 END AS ch FROM staged WINDOW w AS (PARTITION BY series ORDER BY ts)),
  e2 AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY ts) AS ep FROM e1),
  dd AS (SELECT series, coalesce(arg_min(pts, ts), min(ts)) AS start, arg_min(ts, (dd, ts)) AS valley, arg_max(nts, ts) FILTER (WHERE nts IS NOT NULL AND nxt) AS recovery0, max(ts) AS lst, min(dd) AS max_drawdown
         FROM (SELECT *, ts = max(ts) OVER (PARTITION BY series, ep) AS nxt FROM e2) WHERE dd < 0 GROUP BY series, ep),
  det AS (SELECT series, start, valley, recovery0 AS recovery, max_drawdown, CAST(date_diff('day', start, valley) AS BIGINT) AS days_to_valley, CAST(date_diff('day', start, coalesce(recovery0, lst)) AS BIGINT) AS days FROM dd)"""
register("drawdown_details", BASE + EPISODES + " SELECT series, start, valley, recovery, round(max_drawdown, 7) AS max_drawdown, days_to_valley, days FROM det", 7)(lambda spark, sf_dir: S.drawdown_details(V.returns(spark, sf_dir)))
register("worst_drawdowns", BASE + EPISODES + " SELECT * FROM (SELECT series, start, valley, recovery, round(max_drawdown, 7) AS max_drawdown, days_to_valley, days, CAST(row_number() OVER (PARTITION BY series ORDER BY det.max_drawdown, start) AS INTEGER) AS rank FROM det) WHERE rank <= 10", 7)(
    lambda spark, sf_dir: S.worst_drawdowns(V.returns(spark, sf_dir))
)
RUNUPS = """, bd AS (SELECT series, min(ts) AS t0, max(ts) AS t1 FROM staged GROUP BY series),
  sp AS (SELECT d.series, valley AS fr, coalesce(lead(start) OVER (PARTITION BY d.series ORDER BY start), t1) AS un FROM det d JOIN bd USING (series)
         UNION ALL SELECT bd.series, t0, coalesce(min(start), t1) FROM bd LEFT JOIN det d ON d.series = bd.series GROUP BY bd.series, t0, t1),
  rn AS (SELECT p.series, fr, un, arg_min(wealth, ts) AS w0, max(wealth) AS w1, arg_min(ts, (-wealth, ts)) AS peak FROM sp p JOIN staged s ON s.series = p.series AND s.ts BETWEEN fr AND un GROUP BY p.series, fr, un),
  ru AS (SELECT series, fr AS start, peak, w1 / w0 - 1 AS max_runup, CAST(date_diff('day', fr, peak) AS BIGINT) AS days FROM rn WHERE peak > fr)"""
register("runup_details", BASE + EPISODES + RUNUPS + " SELECT series, start, peak, round(max_runup, 7) AS max_runup, days FROM ru", 7)(lambda spark, sf_dir: S.runup_details(V.returns(spark, sf_dir)))
register("worst_runups", BASE + EPISODES + RUNUPS + " SELECT * FROM (SELECT series, start, peak, round(max_runup, 7) AS max_runup, days, CAST(row_number() OVER (PARTITION BY series ORDER BY ru.max_runup DESC, start) AS INTEGER) AS rank FROM ru) WHERE rank <= 10", 7)(
    lambda spark, sf_dir: S.worst_runups(V.returns(spark, sf_dir))
)


METRICS_SQL = f"""{BASE}, {MONTHLY}, bench AS (SELECT date_trunc('hour', ts) AS ts, avg(ret) AS bench FROM ticks GROUP BY 1), p AS (SELECT r.series, r.ts, r.ret, b.bench FROM returns r JOIN bench b USING (ts)){STREAK_CTES},
  one AS (SELECT series, min(ts) AS start_ts, max(ts) AS end_ts, {', '.join(f'round({s}, 4) AS {n}' for n, s in SCALAR_SQL.items() if n in M.SCALARS)}, count(ret) AS periods, {SCALAR_SQL['probabilistic_sharpe_z']} AS z FROM staged GROUP BY series),
  two AS (SELECT series, CAST(coalesce(max(n) FILTER (WHERE sg = 1), 0) AS BIGINT) AS consecutive_wins, CAST(coalesce(max(n) FILTER (WHERE sg = -1), 0) AS BIGINT) AS consecutive_losses FROM r GROUP BY series),
  three AS (SELECT series, {', '.join((f'round({s}, 4)' if '_months' not in n else s) + f' AS {n}' for n, s in CAL_STATS.items() if 'year' not in n)} FROM m GROUP BY series),
  four AS (SELECT series, {', '.join(f'round({s}, 4) AS {n}' for n, s in CAL_STATS.items() if 'year' in n)} FROM yy GROUP BY series),
  five AS (SELECT series, {', '.join(f'round({s}, 4) AS {n}' for n, s in RELATIVE_SQL.items())} FROM p GROUP BY series)
SELECT one.* EXCLUDE (z), round({CDF}, 4) AS probabilistic_sharpe_ratio, two.* EXCLUDE (series), three.* EXCLUDE (series), four.* EXCLUDE (series), five.* EXCLUDE (series) FROM one JOIN two USING (series) JOIN three USING (series) JOIN four USING (series) JOIN five USING (series)"""


@register("metrics_summary", METRICS_SQL, 4)
def metrics_summary(spark, sf_dir) -> DataFrame:
    return S.metrics_bundle(V.returns(spark, sf_dir), V.benchmark(spark, sf_dir))
