"""Queries of reshapes, NAV, EDA, allocation, studies, indicators and patterns, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocate as A
from ..operators import eda as E
from ..operators import frames as FR
from ..operators import indicators as I
from ..operators import nav as N
from ..operators import patterns as P
from ..operators import portfolio as PF
from ..operators import study as ST
from . import views as V
from .core_queries import ORACLES, register

BARS = V.with_ctes(V.SQL_TICKS, V.SQL_BARS)
RETS = V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS)

# --- reshapes -------------------------------------------------------------------------------------------
register("to_prices", BARS + "SELECT ts, asset, round(close, 6) AS price FROM bars", 6)(lambda s, d: FR.to_prices(V.bars(s, d)))
_lag = "lag(close) OVER (PARTITION BY asset ORDER BY ts)"
register("to_returns", BARS + f"SELECT * FROM (SELECT asset AS series, ts, round(close / {_lag} - 1, 7) AS ret FROM bars) WHERE ret IS NOT NULL", 7)(lambda s, d: FR.to_returns(FR.to_prices(V.bars(s, d))))
register("log_returns", BARS + f"SELECT * FROM (SELECT asset AS series, ts, round(ln(close / {_lag}), 7) AS ret FROM bars) WHERE ret IS NOT NULL", 7)(lambda s, d: FR.to_log_returns(FR.to_prices(V.bars(s, d))))
register(
    "resample",
    BARS + "SELECT date_trunc('day', ts) AS ts, asset, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2",
    6,
)(lambda s, d: FR.resample(V.bars(s, d), "day"))


def _halves(s, d) -> tuple[DataFrame, DataFrame]:
    r = V.returns(s, d).select("ts", F.col("series").alias("asset"), "ret")
    return r.filter("hour(ts) < 16"), r.filter("hour(ts) >= 8 AND asset <> 'error'")


_two = RETS + ", a AS (SELECT ts, series AS asset, ret FROM returns WHERE hour(ts) < 16), b AS (SELECT ts, series AS asset, ret FROM returns WHERE hour(ts) >= 8 AND series <> 'error')"
register("align_inner", _two + " SELECT ts, asset, round(ret, 8) AS ret FROM a WHERE ts IN (SELECT ts FROM b) AND asset IN (SELECT asset FROM b)")(lambda s, d: FR.align(*_halves(s, d))[0])
register(
    "align_outer",
    _two + ", t AS (SELECT ts FROM a UNION SELECT ts FROM b), n AS (SELECT asset FROM a UNION SELECT asset FROM b) SELECT t.ts, n.asset, round(a.ret, 8) AS ret FROM t CROSS JOIN n LEFT JOIN a ON a.ts = t.ts AND a.asset = n.asset",
)(lambda s, d: FR.align(*_halves(s, d), how="outer")[0])
_types = ("click", "error", "purchase", "signup", "view")
register("as_wide", RETS + f"SELECT ts, {', '.join(f'''round(max(ret) FILTER (WHERE series = '{t}'), 8) AS \"{t}\"''' for t in _types)} FROM returns GROUP BY ts")(
    lambda s, d: FR.as_wide(V.returns(s, d), asset="series", value="ret", assets=list(_types))
)
register("as_long", BARS + "SELECT ts, asset, round(value, 6) AS value FROM (UNPIVOT (SELECT ts || '|' || asset AS k, ts AS ts0, asset AS a0, open, close FROM bars) ON open, close INTO NAME asset VALUE value) x(k, ts, a0, asset, value) WHERE a0 = 'view'", 6)(
    lambda s, d: FR.as_long(V.bars(s, d).filter("asset = 'view'").select("ts", "open", "close"))
)


def _gappy(s, d) -> DataFrame:
    return V.bars(s, d).withColumn("close", F.when(F.hour("ts") % 3 != 0, F.col("close")))


register("forward_fill", BARS + ", g AS (SELECT ts, asset, CASE WHEN hour(ts) % 3 <> 0 THEN close END AS close FROM bars) SELECT ts, asset, round(last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts), 6) AS close FROM g", 6)(
    lambda s, d: FR.forward_fill(_gappy(s, d)).select("ts", "asset", "close")
)

# --- NAV and flows --------------------------------------------------------------------------------------
NAVS = V.with_ctes(V.SQL_NAV)
_pn = "lag(nav) OVER (PARTITION BY account ORDER BY ts)"
for _m, _sql in {"none": f"(nav - {_pn}) / {_pn}", "total_return": f"(nav - {_pn} + dist) / {_pn}", "modified_dietz": f"(nav - {_pn} - flow) / ({_pn} + flow / 2)", "daily_twr": f"(nav - {_pn} - flow) / {_pn}"}.items():
    register(f"nav_returns_{_m}", NAVS + f"SELECT series, ts, ret FROM (SELECT account AS series, ts, round({_sql}, 8) AS ret, row_number() OVER (PARTITION BY account ORDER BY ts) AS n FROM nav) WHERE n > 1")(
        lambda s, d, m=_m: N.returns_from_nav(V.nav(s, d), method=m)
    )
register(
    "nav_synthetic",
    NAVS + f", r AS (SELECT *, coalesce((nav - {_pn} - flow) / {_pn}, 0) AS rr, first_value(nav) OVER (PARTITION BY account ORDER BY ts) AS base FROM nav) SELECT account, ts, round(base * product(1 + rr) OVER (PARTITION BY account ORDER BY ts), 2) AS nav FROM r",
    2,
)(lambda s, d: N.synthetic_nav(V.nav(s, d)))


def _late_flows(s, d) -> DataFrame:
    """Flows half a day after NAV dates, so that each goes to a later one."""
    return V.flows(s, d).withColumn("ts", F.col("ts") + F.expr("INTERVAL 12 HOURS"))


_late = V.with_ctes(V.SQL_NAV, V.SQL_FLOWS) + ", late AS (SELECT account, ts + INTERVAL 12 HOUR AS ts, flow_type, amount FROM flows), att AS (SELECT f.account, n.ts AS nts, f.amount, f.flow_type FROM late f ASOF JOIN nav n ON f.account = n.account AND f.ts <= n.ts)"
register("asof_flows", _late + " SELECT account, nts AS ts, round(sum(amount), 4) AS amount FROM att GROUP BY 1, 2", 4)(lambda s, d: N.attribute_to_next(_late_flows(s, d), V.nav(s, d)))
register(
    "signed_flows",
    _late + ", g AS (SELECT account, nts AS ts, sum(CASE flow_type WHEN 'INJECTION' THEN amount ELSE -amount END) AS flow FROM att GROUP BY 1, 2) SELECT s.account, s.ts, round(coalesce(g.flow, 0), 4) AS flow FROM nav s LEFT JOIN g USING (account, ts)",
    4,
)(lambda s, d: N.signed_flows(_late_flows(s, d), V.nav(s, d)))
register(
    "per_share_dist",
    _late + ", g AS (SELECT account, nts AS ts, sum(amount) AS a FROM att WHERE flow_type = 'DISTRIBUTION' GROUP BY 1, 2) SELECT account, ts, round(a / (nav / 1000), 8) AS dist_per_share FROM g JOIN nav USING (account, ts)",
)(lambda s, d: N.per_share_distributions(_late_flows(s, d), V.nav(s, d).select("account", "ts", (F.col("nav") / 1000).alias("shares"))))

# --- portfolios -----------------------------------------------------------------------------------------
register("portfolio_equal", RETS + "SELECT 'portfolio' AS series, ts, round(sum(ret) / (SELECT count(DISTINCT series) FROM returns), 8) AS ret FROM returns GROUP BY ts")(lambda s, d: PF.combine(V.returns(s, d)))
register("reduce_mean", RETS + "SELECT 'mean' AS series, ts, round(avg(ret), 8) AS ret FROM returns GROUP BY ts")(lambda s, d: PF.reduce_returns(V.returns(s, d)))
register("cumulative_returns", RETS + "SELECT series, ts, round(product(1 + ret) OVER (PARTITION BY series ORDER BY ts) - 1, 7) AS cumulative FROM returns", 7)(lambda s, d: PF.cumulative_returns(V.returns(s, d)))
WTS = V.with_ctes(V.SQL_WEIGHTS)
register("turnover", WTS + ", x AS (SELECT ts, abs(weight - lag(weight) OVER (PARTITION BY asset ORDER BY ts)) AS dw FROM weights), y AS (SELECT ts, sum(dw) / 2 AS t FROM x WHERE dw IS NOT NULL GROUP BY ts) SELECT round(avg(t), 8) AS turnover FROM y")(
    lambda s, d: PF.turnover(V.weights(s, d))
)


def _daily(s, d) -> DataFrame:
    return PF.reduce_returns(V.returns(s, d).withColumn("ts", F.date_trunc("day", "ts")))


_attr = V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS, V.SQL_WEIGHTS, "dr AS (SELECT date_trunc('day', ts) AS ts, avg(ret) AS ret FROM returns GROUP BY 1)")
register("attribution", _attr + "SELECT ts, asset, round(weight * ret, 8) AS attribution FROM weights JOIN dr USING (ts)")(lambda s, d: PF.attribution(V.weights(s, d), _daily(s, d)))
register("contribution", _attr + "SELECT asset, round(avg(weight * ret), 8) AS contribution FROM weights JOIN dr USING (ts) GROUP BY asset")(lambda s, d: PF.contribution(V.weights(s, d), _daily(s, d)))
register("composition", WTS + "SELECT asset, round(weight, 8) AS weight FROM weights WHERE ts = (SELECT max(ts) FROM weights)")(lambda s, d: PF.composition(V.weights(s, d)))
register("equal_weight", RETS + ", s AS (SELECT DISTINCT series FROM returns) SELECT series, round(1.0 / count(*) OVER (), 8) AS weight FROM s")(lambda s, d: A.equal_weighted(V.returns(s, d)))
register("inverse_vol", RETS + ", v AS (SELECT series, 1 / stddev_samp(ret) AS i FROM returns GROUP BY series) SELECT series, round(i / sum(i) OVER (), 8) AS weight FROM v")(lambda s, d: A.inverse_volatility(V.returns(s, d)))
register("covariances", RETS + "SELECT a.series AS a, b.series AS b, round(covar_samp(a.ret, b.ret), 10) AS cov FROM returns a JOIN returns b USING (ts) GROUP BY 1, 2", 10)(lambda s, d: A.covariances(V.returns(s, d)))
register("mvo", None, 6)(lambda s, d: A.solve(V.returns(s, d), "mvo"))
register("hrp", None, 6)(lambda s, d: A.solve(V.returns(s, d), "hrp"))
for _n, _emb in (("purged_kfold", 0), ("embargoed_kfold", 5)):
    register(
        _n,
        RETS + f""", p AS (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM returns),
  f AS (SELECT *, k * (n // 5) + least(k, n % 5) AS a FROM p, (SELECT unnest(range(5)) AS k) q), g AS (SELECT *, a + n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS b FROM f),
  h AS (SELECT CAST(k AS INTEGER) AS fold, series, CASE WHEN pos >= a AND pos < b THEN 'test' WHEN pos >= a - 3 AND pos < b + {_emb} THEN NULL ELSE 'train' END AS role, pos FROM g)
SELECT series, fold, role, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM h WHERE role IS NOT NULL GROUP BY ALL""",
    )(lambda s, d, e=_emb: A.kfold(V.returns(s, d), 5, purge=3, embargo=e, key="series").groupBy("series", "fold", "role").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("pos_sum")))

# --- EDA ------------------------------------------------------------------------------------------------
_num = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax"}
_txt = ("l_returnflag", "l_linestatus")


def _lines(s, d) -> DataFrame:
    return V.read(s, d, "lineitem").select(*_num, *_txt)


_stats = " UNION ALL ".join(
    [
        f"""SELECT '{c}' AS "column", 'double' AS dtype, count({c}) AS count, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 5) AS missing_pct, count(DISTINCT {c}) AS "distinct", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) + 0.0::DOUBLE AS min, round(quantile_cont({c}, 0.25), 5) AS q25, round(quantile_cont({c}, 0.5), 5) AS median, round(quantile_cont({c}, 0.75), 5) AS q75, round(max({c}), 5) AS max, round(skewness({c}), 5) AS skew, round(kurtosis({c}), 5) AS kurt, round(count(*) FILTER (WHERE {c} = 0) * 100.0 / count(*), 5) AS zeros_pct, 0.0::DOUBLE AS inf_pct FROM lineitem"""
        for c in _num
    ]
    + [
        f"""SELECT '{c}', 'string', count({c}), count(*) - count({c}), round((count(*) - count({c})) * 100.0 / count(*), 5), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem"""
        for c in _txt
    ]
)
register("column_stats", _stats, 5)(lambda s, d: E.column_stats(_lines(s, d)))
register(
    "column_modes",
    "WITH x AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS v, count(*) AS n FROM orders GROUP BY {c}""" for c in ("o_orderstatus", "o_orderpriority")) + """)
SELECT "column", arg_min(v, (-n, v)) AS mode, round(max(n) * 100.0 / sum(n), 6) AS mode_pct FROM x GROUP BY "column" """,
    6,
)(lambda s, d: E.column_modes(V.read(s, d, "orders").select("o_orderstatus", "o_orderpriority")))
register("overview", "WITH d AS (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM events GROUP BY event_type, date_trunc('day', ts))) SELECT (SELECT count(*) FROM events) AS rows, CAST(2 AS BIGINT) AS columns, (SELECT 2 * count(*) FROM events) AS cells, CAST(0 AS BIGINT) AS missing_cells, CAST(dup AS BIGINT) AS duplicate_rows FROM d")(
    lambda s, d: E.overview(V.read(s, d, "events").select("event_type", F.date_trunc("day", "ts").alias("day")))
)
register(
    "describe",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{n}' AS stat, round({x}, 6) + 0.0::DOUBLE AS value FROM lineitem""" for c in _num for n, x in {"count": f"CAST(count({c}) AS DOUBLE)", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "25%": f"quantile_cont({c}, 0.25)", "50%": f"quantile_cont({c}, 0.5)", "75%": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}.items()),
    6,
)(lambda s, d: E.describe(_lines(s, d)))
_pairs = [(a, b) for k, a in enumerate(_num) for b in list(_num)[k + 1 :]]
register("corr_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM lineitem" for a, b in _pairs))(lambda s, d: E.pearson(_lines(s, d)))
_rk = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _num)
register("corr_spearman", f"WITH r AS (SELECT {_rk} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM r" for a, b in _pairs))(lambda s, d: E.spearman(_lines(s, d)))


def _two_periods(s, d) -> tuple[DataFrame, DataFrame]:
    o = V.read(s, d, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    cut = F.lit("1998-01-01").cast("timestamp")
    return o.filter(F.col("l_shipdate") < cut).drop("l_shipdate"), o.filter(F.col("l_shipdate") >= cut).drop("l_shipdate")


def _drift_sql(c: str) -> str:
    return f"""(WITH x AS (SELECT {c} AS x, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS w FROM lineitem),
  c AS (SELECT x, sum(w) AS na, sum(1 - w) AS nb FROM x GROUP BY x),
  e AS (SELECT x, abs(sum(na) OVER (ORDER BY x) / (SELECT sum(na) FROM c) - sum(nb) OVER (ORDER BY x) / (SELECT sum(nb) FROM c)) AS d, lead(x) OVER (ORDER BY x) - x AS g FROM c),
  m AS (SELECT avg(x) FILTER (WHERE w = 1) AS ma, avg(x) FILTER (WHERE w = 0) AS mb, stddev_samp(x) FILTER (WHERE w = 1) AS sa, stddev_samp(x) FILTER (WHERE w = 0) AS sb, count(*) FILTER (WHERE w = 1) AS n_a, count(*) FILTER (WHERE w = 0) AS n_b FROM x)
SELECT '{c}' AS "column", round(ma, 7) AS mean_a, round(mb, 7) AS mean_b, round((mb - ma) / NULLIF(sa, 0), 7) AS mean_shift, round(sb / NULLIF(sa, 0), 7) AS std_ratio, (SELECT round(max(d), 7) FROM e) AS ks_stat, (SELECT round(sum(d * g), 6) FROM e) AS wasserstein, 0.0::DOUBLE AS missing_delta, n_a, n_b FROM m)"""


register("drift", " UNION ALL ".join(_drift_sql(c).replace("round(sum(d * g), 6)", "round(sum(d * g), 5)") for c in ("l_quantity", "l_discount")), 5)(
    lambda s, d: E.drift(*[x.select("l_quantity", "l_discount") for x in _two_periods(s, d)])
)
ORACLES["drift"] = ORACLES["drift"].replace(", 7)", ", 5)")
_x = "ks_stat * sqrt(n_a * n_b / (n_a + n_b))"
_low = f"greatest(0, 1 - sqrt(2 * pi()) / ({_x}) * list_sum(list_transform(range(1, 20), lambda k: exp(-pow(pi() / ({_x}), 2) / 8 * pow(2 * k - 1, 2)))))"
_high = f"least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1, k - 1) * exp(-2 * pow(k * {_x}, 2))))))"
register(
    "ks_p_values",
    "WITH dr AS (" + " UNION ALL ".join(_drift_sql(c).replace("round(max(d), 7)", "max(d)") for c in ("l_quantity", "l_extendedprice", "l_discount")) + f""")
SELECT "column", round(ks_stat, 6) AS ks_stat, round((CASE WHEN {_x} < 1e-3 THEN 1.0 WHEN {_x} < 0.6 THEN {_low} ELSE {_high} END)::DOUBLE, 6) AS ks_p FROM dr""",
    6,
)(lambda s, d: E.with_ks_p(E.drift(*_two_periods(s, d))).select("column", "ks_stat", "ks_p"))
register(
    "target_shift",
    "WITH x AS (SELECT *, l_shipdate < TIMESTAMP '1998-01-01' AS a FROM lineitem) SELECT \"column\", corr_a, corr_b, round(cb - ca, 8) AS delta FROM ("
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", corr({c}, l_extendedprice) FILTER (WHERE a) AS ca, corr({c}, l_extendedprice) FILTER (WHERE NOT a) AS cb, round(corr({c}, l_extendedprice) FILTER (WHERE a), 8) AS corr_a, round(corr({c}, l_extendedprice) FILTER (WHERE NOT a), 8) AS corr_b FROM x""" for c in ("l_quantity", "l_discount"))
    + ")",
)(lambda s, d: E.target_shift(*_two_periods(s, d), "l_extendedprice", ["l_quantity", "l_discount"]))
register(
    "profile_alerts",
    """WITH s AS (SELECT 'documents' AS source, 'n_chars' AS c, stddev_samp(n_chars) AS sd, skewness(n_chars) AS sk, kurtosis(n_chars) AS ku, count(*) FILTER (WHERE n_chars = 0) * 100.0 / count(*) AS ze, (count(*) - count(n_chars)) * 100.0 / count(*) AS mi FROM documents
  UNION ALL SELECT 'labels', 'quality', stddev_samp(quality), skewness(quality), kurtosis(quality), count(*) FILTER (WHERE quality = 0) * 100.0 / count(*), (count(*) - count(quality)) * 100.0 / count(*) FROM labels
  UNION ALL SELECT 'labels', 'toxic', stddev_samp(toxic), skewness(toxic), kurtosis(toxic), count(*) FILTER (WHERE toxic = 0) * 100.0 / count(*), (count(*) - count(toxic)) * 100.0 / count(*) FROM labels)
SELECT source, c AS "column", alert, round(value, 5) AS value FROM (SELECT source, c, unnest([struct_pack(alert := 'zero_variance', value := CASE WHEN sd = 0 THEN sd END), struct_pack(alert := 'missing', value := CASE WHEN mi > 30 THEN mi END), struct_pack(alert := 'zeros', value := CASE WHEN ze > 50 THEN ze END),
  struct_pack(alert := 'skewed', value := CASE WHEN abs(sk) > 2 THEN sk END), struct_pack(alert := 'heavy_tails', value := CASE WHEN abs(ku) > 7 THEN ku END)], recursive := true) FROM s) WHERE value IS NOT NULL""",
    5,
)(lambda s, d: _alerts(s, d, "documents", "n_chars").unionByName(_alerts(s, d, "labels", "quality", "toxic")))


def _alerts(s, d, name: str, *columns: str) -> DataFrame:
    t = V.read(s, d, name).select(*columns)
    return E.profile_alerts(E.column_stats(t)).select(F.lit(name).alias("source"), "column", "alert", "value")


def _parties(s, d) -> tuple[DataFrame, DataFrame]:
    a = V.read(s, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return a, V.read(s, d, "supplier").select((F.col("s_acctbal") * 3).alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))


def _party_sql(c: str, x: str, y: str) -> str:
    return f"""SELECT '{c}' AS c, max(abs(d)) AS ks, (SELECT (avg({y}) - (SELECT avg({x}) FROM customer)) / (SELECT stddev_samp({x}) FROM customer) FROM supplier) AS shift FROM (SELECT sum(na) OVER (ORDER BY x) / (SELECT count(*) FROM customer) - sum(nb) OVER (ORDER BY x) / (SELECT count(*) FROM supplier) AS d FROM (SELECT x, sum(w) AS na, sum(1 - w) AS nb FROM (SELECT {x} AS x, 1 AS w FROM customer UNION ALL SELECT {y}, 0 FROM supplier) GROUP BY x))"""


register(
    "compare_alerts",
    f"""WITH s AS ({_party_sql('balance', 'c_acctbal', 's_acctbal * 3')} UNION ALL {_party_sql('nation', 'c_nationkey', 's_nationkey')})
SELECT 'segment' AS "column", 'column_removed' AS alert, CAST(NULL AS DOUBLE) AS value UNION ALL SELECT 'name', 'column_added', NULL
UNION ALL SELECT c, 'distribution_drift', round(ks, 5) FROM s WHERE ks > 0.2 UNION ALL SELECT c, 'mean_shift', round(shift, 5) FROM s WHERE abs(shift) > 1""",
    5,
)(lambda s, d: E.compare_alerts(E.drift(*_parties(s, d)), _parties(s, d)[0].columns, _parties(s, d)[1].columns))
register(
    "histogram",
    RETS + ", e AS (SELECT min(ret) AS a, max(ret) AS b FROM returns) SELECT CAST(least(floor((ret - a) / ((b - a) / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM returns, e GROUP BY 1",
)(lambda s, d: E.histogram(V.returns(s, d), "ret").select("bin", "n"))
register("sample_rows")(lambda s, d: E.sample_rows(V.read(s, d, "customer"), 100, "c_custkey"))

# --- indicators -----------------------------------------------------------------------------------------
def _win(n: int) -> str:
    return f"OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, x: str) -> str:
    return f"round(CASE WHEN count(close) {_win(n)} = {n} THEN {x} END, 6)"


_hl = f"(max(high) {_win(14)} - min(low) {_win(14)})"
INDICATOR_SQL = {
    "sma": f"{_full(20, f'avg(close) {_win(20)}')} AS sma",
    "wma": f"{_full(20, '(' + ' + '.join(f'coalesce(lag(close, {k}) OVER (PARTITION BY asset ORDER BY ts), 0) * {20 - k}' for k in range(20)) + ') / 210')} AS wma",
    "bbands": f"{_full(20, f'avg(close) {_win(20)} + 2 * stddev_pop(close) {_win(20)}')} AS upper, {_full(20, f'avg(close) {_win(20)}')} AS middle, {_full(20, f'avg(close) {_win(20)} - 2 * stddev_pop(close) {_win(20)}')} AS lower",
    "mom": "round(close - lag(close, 10) OVER (PARTITION BY asset ORDER BY ts), 6) AS mom",
    "roc": "round((close / lag(close, 10) OVER (PARTITION BY asset ORDER BY ts) - 1) * 100, 6) AS roc",
    "willr": f"{_full(14, f'(max(high) {_win(14)} - close) / NULLIF({_hl}, 0) * -100')} AS willr",
    "obv": "round(sum(sg * volume) OVER (PARTITION BY asset ORDER BY ts), 6) AS obv",
    "tr": "round(greatest(high - low, abs(high - pc), abs(low - pc)), 6) AS tr",
}
for _n, _sql in INDICATOR_SQL.items():
    register(f"ind_{_n}", BARS + f"SELECT asset, ts, {_sql} FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY ts) AS pc, coalesce(sign(close - lag(close) OVER (PARTITION BY asset ORDER BY ts)), 0) AS sg FROM bars)", 6)(
        lambda s, d, n=_n: I.indicator(n, V.bars(s, d))
    )
register("ind_stoch", BARS + f", x AS (SELECT *, CASE WHEN count(close) {_win(14)} = 14 THEN (close - min(low) {_win(14)}) / NULLIF({_hl}, 0) * 100 END AS k FROM bars) SELECT asset, ts, round(k, 6) AS k, round(CASE WHEN count(k) {_win(3)} = 3 THEN avg(k) {_win(3)} END, 6) AS d FROM x", 6)(
    lambda s, d: I.indicator("stoch", V.bars(s, d))
)


def _recursive(col: str, seed: int, rate: str, value: str, extra: str = "") -> str:
    """A smoother as a recursive CTE over each asset's numbered bars."""
    return BARS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", nb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS pos, lag(close) OVER (PARTITION BY asset ORDER BY ts) AS pc FROM bars),
  xs AS MATERIALIZED (SELECT asset, ts, pos, {value} AS x FROM nb),
  rec AS (SELECT asset, CAST({seed} AS BIGINT) AS pos, avg(x) AS v FROM xs WHERE pos <= {seed} GROUP BY asset HAVING count(*) = {seed}
    UNION ALL SELECT r.asset, r.pos + 1, r.v + {rate} * (n.x - r.v) FROM rec r JOIN xs n ON n.asset = r.asset AND n.pos = r.pos + 1)
SELECT xs.asset, xs.ts, round(rec.v, 6) AS {col} FROM xs LEFT JOIN rec USING (asset, pos)"""


register("ind_ema", _recursive("ema", 20, "(2.0 / 21)", "close"), 6)(lambda s, d: I.indicator("ema", V.bars(s, d)))
register("wilder_atr", _recursive("atr", 14, "(1.0 / 14)", "coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low)"), 6)(lambda s, d: I.wilder_atr(V.bars(s, d), 14))
# --- event study ----------------------------------------------------------------------------------------
H = ST.HORIZONS
STUDY = V.with_ctes(V.SQL_TICKS, V.SQL_BARS, V.SQL_EVENTS).replace("WITH ", "WITH RECURSIVE ", 1) + """, nb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS pos, count(*) OVER (PARTITION BY asset) AS cnt, lag(close) OVER (PARTITION BY asset ORDER BY ts) AS pc FROM bars),
  xs AS MATERIALIZED (SELECT asset, pos, coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) AS x FROM nb),
  rec AS (SELECT asset, CAST(14 AS BIGINT) AS pos, avg(x) AS atr FROM xs WHERE pos <= 14 GROUP BY asset HAVING count(*) = 14 UNION ALL SELECT r.asset, r.pos + 1, (r.atr * 13 + n.x) / 14 FROM rec r JOIN xs n ON n.asset = r.asset AND n.pos = r.pos + 1),
  e0 AS (SELECT ev.*, nb.pos, nb.cnt, rec.atr AS risk, ev.breakout_price AS entry FROM ev JOIN nb ON nb.asset = ev.asset AND nb.ts = ev.breakout_ts JOIN rec ON rec.asset = nb.asset AND rec.pos = nb.pos WHERE rec.atr > 0),
  hz AS (SELECT unnest([5, 10, 20, 60]) AS horizon),
  paths AS (SELECT e.asset, e.breakout_ts, e.quality, hz.horizon, (max(b.close) FILTER (WHERE b.pos = e.pos + hz.horizon)) / e.entry - 1 AS fwd, (max(b.close) FILTER (WHERE b.pos = e.pos + hz.horizon) - e.entry) / e.risk AS r_multiple,
    greatest(0, (max(b.high) - e.entry) / e.risk) AS mfe, greatest(0, (e.entry - min(b.low)) / e.risk) AS mae, (SELECT min(low) <= e.entry FROM nb t WHERE t.asset = e.asset AND t.pos BETWEEN e.pos + 1 AND e.pos + 10) AS throwback
    FROM e0 e JOIN hz ON e.pos + hz.horizon <= e.cnt JOIN nb b ON b.asset = e.asset AND b.pos BETWEEN e.pos + 1 AND e.pos + hz.horizon GROUP BY e.asset, e.breakout_ts, e.quality, hz.horizon, e.entry, e.risk, e.pos)"""
PM = "count(*) AS n_events, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(r_multiple), 6) AS expectancy, round(avg(mfe) / NULLIF(avg(mae), 0), 6) AS edge_ratio, round(avg(mfe), 6) AS mfe_atr, round(avg(mae), 6) AS mae_atr, round(quantile_cont(mae, 0.95), 6) AS mae_p95_atr, round(avg(CASE WHEN throwback THEN 1.0 ELSE 0 END), 6) AS throwback"


def _paths(s, d) -> DataFrame:
    return ST.event_paths(V.study_events(s, d), V.bars(s, d))


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in ST.path_metrics().items()])


register("study_horizons", STUDY + f" SELECT CAST(horizon AS INTEGER) AS horizon, {PM} FROM paths GROUP BY horizon", 6)(lambda s, d: _metrics(_paths(s, d), "horizon"))
for _n in ("hit_rate", "expectancy", "edge_ratio", "mfe_atr", "mae_atr", "mae_p95_atr", "throwback"):
    _x = dict(p.rsplit(" AS ", 1)[::-1] for p in PM.split(", round(")[0:1] + ["round(" + p for p in PM.split(", round(")[1:]])[_n]
    register(f"study_{_n}", STUDY + f" SELECT CAST(horizon AS INTEGER) AS horizon, {_x} AS {_n} FROM paths GROUP BY horizon", 6)(lambda s, d, n=_n: _paths(s, d).groupBy("horizon").agg(ST.path_metrics()[n].alias(n)))
_rank = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2"
register("study_ic", STUDY + f", r AS (SELECT horizon, {_rank.format(k='horizon', c='quality')} AS rq, {_rank.format(k='horizon', c='fwd')} AS rf FROM paths) SELECT CAST(horizon AS INTEGER) AS horizon, round(CASE WHEN count(*) >= 5 THEN corr(rq, rf) END, 6) AS ic FROM r GROUP BY horizon", 6)(
    lambda s, d: ST.information_coefficient(_paths(s, d))
)
_wk = "horizon, date_trunc('week', breakout_ts)"
register(
    "study_icir",
    STUDY + f", r AS (SELECT horizon, date_trunc('week', breakout_ts) AS p, {_rank.format(k=_wk, c='quality')} AS rq, {_rank.format(k=_wk, c='fwd')} AS rf FROM paths), i AS (SELECT horizon, p, corr(rq, rf) AS ic FROM r GROUP BY ALL HAVING count(*) >= 5) SELECT CAST(horizon AS INTEGER) AS horizon, round(CASE WHEN count(*) >= 3 THEN avg(ic) / NULLIF(stddev_pop(ic), 0) END, 6) AS icir FROM i WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY horizon",
    6,
)(lambda s, d: ST.icir(_paths(s, d), period="week"))
register(
    "study_baseline",
    STUDY + ", mv AS (SELECT b.asset, hz.horizon, CASE WHEN c.close > b.close THEN 1.0 ELSE 0 END AS up FROM nb b CROSS JOIN hz JOIN nb c ON c.asset = b.asset AND c.pos = b.pos + hz.horizon), sh AS (SELECT asset, horizon, avg(up) AS p FROM mv GROUP BY ALL), ne AS (SELECT asset, count(*) AS n FROM ev GROUP BY asset) SELECT CAST(horizon AS INTEGER) AS horizon, round(sum(p * n) / sum(n), 6) AS baseline_hit FROM sh JOIN ne USING (asset) GROUP BY horizon",
    6,
)(lambda s, d: ST.baseline_hit(V.study_events(s, d), V.bars(s, d)))
_yr = "horizon, date_trunc('year', breakout_ts)"
register(
    "study_evaluate",
    STUDY
    + f""", pm AS (SELECT horizon, {PM} FROM paths GROUP BY horizon), r AS (SELECT horizon, {_rank.format(k='horizon', c='quality')} AS rq, {_rank.format(k='horizon', c='fwd')} AS rf FROM paths),
  ic AS (SELECT horizon, round(CASE WHEN count(*) >= 5 THEN corr(rq, rf) END, 6) AS ic FROM r GROUP BY horizon),
  ry AS (SELECT horizon, date_trunc('year', breakout_ts) AS p, {_rank.format(k=_yr, c='quality')} AS rq, {_rank.format(k=_yr, c='fwd')} AS rf FROM paths), iy AS (SELECT horizon, p, corr(rq, rf) AS ic FROM ry GROUP BY ALL HAVING count(*) >= 5),
  ir AS (SELECT horizon, round(CASE WHEN count(*) >= 3 THEN avg(ic) / NULLIF(stddev_pop(ic), 0) END, 6) AS icir FROM iy WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY horizon),
  mv AS (SELECT b.asset, hz.horizon, CASE WHEN c.close > b.close THEN 1.0 ELSE 0 END AS up FROM nb b CROSS JOIN hz JOIN nb c ON c.asset = b.asset AND c.pos = b.pos + hz.horizon), sh AS (SELECT asset, horizon, avg(up) AS p FROM mv GROUP BY ALL), ne AS (SELECT asset, count(*) AS n FROM ev GROUP BY asset),
  bh AS (SELECT horizon, round(sum(p * n) / sum(n), 6) AS baseline_hit FROM sh JOIN ne USING (asset) GROUP BY horizon)
SELECT CAST(pm.horizon AS INTEGER) AS horizon, pm.* EXCLUDE (horizon), ic.ic, ir.icir, bh.baseline_hit FROM pm LEFT JOIN ic USING (horizon) LEFT JOIN ir USING (horizon) LEFT JOIN bh USING (horizon)""",
    6,
)(lambda s, d: ST.evaluate(V.study_events(s, d), V.bars(s, d)))
register("study_per_asset", STUDY + f" SELECT asset, {PM} FROM paths WHERE horizon = 20 GROUP BY asset", 6)(lambda s, d: ST.per_asset(V.study_events(s, d), V.bars(s, d)))
register(
    "study_buckets",
    STUDY + f", p20 AS (SELECT * FROM paths WHERE horizon = 20), eg AS (SELECT list_sort(list_distinct(quantile_cont(quality, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM p20), bk AS (SELECT p20.*, len(list_filter(e[2:len(e) - 1], lambda x: x < quality)) + 1 AS bucket FROM p20, eg) SELECT CAST(bucket AS INTEGER) AS bucket, {PM}, round(min(quality), 6) AS quality_min, round(max(quality), 6) AS quality_max FROM bk GROUP BY bucket",
    6,
)(lambda s, d: ST.quality_buckets(V.study_events(s, d), V.bars(s, d)))
register(
    "study_time_folds",
    STUDY + f", fo AS (SELECT *, least((row_number() OVER (ORDER BY breakout_ts, asset) - 1) // greatest(count(*) OVER () // 5, 1), 4) + 1 AS fold FROM paths WHERE horizon = 20) SELECT CAST(fold AS INTEGER) AS fold, {PM}, min(breakout_ts) AS from_ts, max(breakout_ts) AS to_ts FROM fo GROUP BY fold",
    6,
)(lambda s, d: ST.time_stability(V.study_events(s, d), V.bars(s, d)))

SIG = V.with_ctes(V.SQL_TICKS, V.SQL_BARS, V.SQL_EVENTS, "nb AS (SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS pos FROM bars), ep AS (SELECT ev.asset, a.pos AS p0, b.pos AS p1 FROM ev JOIN nb a ON a.asset = ev.asset AND a.ts = ev.formation_start JOIN nb b ON b.asset = ev.asset AND b.ts = ev.breakout_ts)")
for _m, _on, _v in (("breakout", "nb.pos = ep.p1", "1.0"), ("formation", "nb.pos BETWEEN ep.p0 AND ep.p1", "1.0"), ("decay", "nb.pos BETWEEN ep.p1 AND ep.p1 + 4", "1 - (nb.pos - ep.p1) / 4")):
    register(f"signal_{_m}", SIG + f"SELECT nb.asset, nb.ts, round(coalesce(max(CASE WHEN ep.asset IS NOT NULL THEN {_v} END), 0)::DOUBLE, 8) AS signal FROM nb LEFT JOIN ep ON ep.asset = nb.asset AND {_on} GROUP BY 1, 2")(
        lambda s, d, m=_m: P.events_to_signal(V.study_events(s, d), V.bars(s, d), mode=m)
    )


def _with_pivots(s, d) -> DataFrame:
    low, high = (F.struct(F.lit(k).alias("kind"), F.col(c).alias("price")) for k, c in (("LOW", "pivot_low"), ("HIGH", "pivot_high")))
    return V.study_events(s, d).withColumn("pivots", F.array(low, high))


_cond = STUDY + " SELECT e.asset, e.breakout_ts, round(CASE WHEN ok THEN t END, 6) AS target_price, round(CASE WHEN ok THEN st END, 6) AS stop_price FROM (SELECT ev.asset, ev.breakout_ts, {t} AS t, {st} AS st, ({g}) > 0 AND ({t}) > 0 AND ({st}) > 0 {need} AS ok FROM ev JOIN nb ON nb.asset = ev.asset AND nb.ts = ev.breakout_ts LEFT JOIN rec ON rec.asset = nb.asset AND rec.pos = nb.pos) e"
_g = "breakout_price - pivot_low"
for _n, _c, _q in (
    ("condition_measured", P.Condition("bullish"), dict(t=f"breakout_price + ({_g})", st="pivot_low", g=_g, need="")),
    ("condition_fib", P.Condition("bullish", target_method="fibonacci", stop_method="fixed_pct"), dict(t=f"breakout_price + ({_g}) * 1.618", st="breakout_price * 0.95", g=_g, need="")),
    ("condition_atr", P.Condition("bullish", target_method="fixed_atr", stop_method="atr_multiple"), dict(t="breakout_price + 2 * atr", st="breakout_price - 2 * atr", g=_g, need="AND atr > 0")),
):
    register(_n, _cond.format(**_q), 6)(lambda s, d, c=_c: P.apply_condition(_with_pivots(s, d), c, V.bars(s, d)).select("asset", "breakout_ts", "target_price", "stop_price"))

# --- patterns -------------------------------------------------------------------------------------------
for _k in (3, 5, 8):
    _f = f"OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN {_k} PRECEDING AND {_k} FOLLOWING)"
    register(
        f"pivots_order_{_k}",
        BARS + f", x AS (SELECT *, high >= max(high) {_f} AS t, low <= min(low) {_f} AS b, count(*) OVER (PARTITION BY asset) AS n FROM bars) SELECT asset, ts, 'HIGH' AS kind, round(high, 6) AS price FROM x WHERE t AND n >= {2 * _k + 1} UNION ALL SELECT asset, ts, 'LOW', round(low, 6) FROM x WHERE b AND n >= {2 * _k + 1}",
        6,
    )(lambda s, d, k=_k: P.swing_points(V.bars(s, d), k))
for _n in P.L.FORMATIONS:
    register(f"scan_{_n}", None, 6)(lambda s, d, n=_n: P.pattern_events(V.bars(s, d), n, min_quality=0.0).select("pattern", "asset", "formation_start", "formation_end", "entry_price", "quality", "variant", "direction"))

