"""Queries of stores, catalog, accounts, streams and report tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import eda as E
from ..operators import nav as N
from ..sources import accounts as AC
from ..sources.catalog import Catalog
from ..sources.stores import MemoryStore, ParquetStore, ServerTable
from ..streaming.streams import stream_bars
from . import report as RP
from . import views as V
from .core_queries import BASE, MONTHLY, SCALAR_SQL, register


def _old_new(s, d) -> tuple[DataFrame, DataFrame]:
    r = V.returns(s, d)
    return r.filter("day(ts) <= 15"), r.filter("day(ts) >= 10").withColumn("ret", F.col("ret") * 2)


RETS = V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS)
_two = RETS + ", a AS (SELECT * FROM returns WHERE day(ts) <= 15), b AS (SELECT series, ts, ret * 2 AS ret FROM returns WHERE day(ts) >= 10) "


def _store(s, d, mode: str) -> MemoryStore:
    old, new = _old_new(s, d)
    store = MemoryStore()
    store.write("x", old)
    store.write("x", new, mode=mode)
    return store


register("store_upsert", _two + "SELECT series, ts, round(ret, 8) AS ret FROM b UNION ALL SELECT series, ts, round(ret, 8) FROM a WHERE (series, ts) NOT IN (SELECT (series, ts) FROM b)")(lambda s, d: _store(s, d, "upsert").read("x").select("series", "ts", "ret"))
register("store_append", _two + "SELECT series, ts, round(ret, 8) AS ret FROM a UNION ALL SELECT series, ts, round(ret, 8) FROM b")(lambda s, d: _store(s, d, "append").read("x").select("series", "ts", "ret"))


def _files(s, d, mode: str) -> ParquetStore:
    old, new = _old_new(s, d)
    root = s.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/quantmere-{os.getpid()}"
    store = ParquetStore(s, f"{root}/stores/{uuid.uuid4().hex}")
    store.write("a/x", old)
    store.write("a/x", new, mode=mode)
    return store


register("store_files_upsert", _two + "SELECT series, ts, round(ret, 8) AS ret FROM b UNION ALL SELECT series, ts, round(ret, 8) FROM a WHERE (series, ts) NOT IN (SELECT (series, ts) FROM b)")(lambda s, d: _files(s, d, "upsert").read("a/x").select("series", "ts", "ret"))
register("store_files_append", _two + "SELECT series, ts, round(ret, 8) AS ret FROM a UNION ALL SELECT series, ts, round(ret, 8) FROM b")(lambda s, d: _files(s, d, "append").read("a/x").select("series", "ts", "ret"))
register("store_last_index", RETS + "SELECT max(ts) AS last FROM returns")(lambda s, d: s.createDataFrame([(_store(s, d, "upsert").last_index("x"),)], "last timestamp"))
register("store_range_read", "SELECT event_id, ts, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07 12:00:00'")(
    lambda s, d: MemoryStore({"e": V.read(s, d, "events")}).read("e", start="2024-01-05", end="2024-01-07 12:00:00", columns=["event_id", "event_type"])
)


def _server(s, d) -> ServerTable:
    e = V.read(s, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("prefix"), (F.col("user_id") % 3).cast("string").alias("code"), F.lit("1d").alias("tf"), F.col("value").alias("c"), F.col("user_id").alias("rank"))
    day = e.withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return ServerTable(s, "bars", asset_cols=("prefix", "code"), timeframe_col="tf", timeframe="1d", frame=day)


_srv = "e AS (SELECT date_trunc('day', ts) AS ts, event_type || ':' || (user_id % 3) AS asset, value AS c, user_id AS rank FROM events)"
register("server_keys", f"WITH {_srv} SELECT DISTINCT asset AS key FROM e")(lambda s, d: s.createDataFrame([(k,) for k in _server(s, d).keys()], "key string"))
register("server_assets", f"WITH {_srv} SELECT asset, min(ts) AS first, max(ts) AS last, count(*) AS rows FROM e GROUP BY asset")(lambda s, d: _server(s, d).asset_ranges())
register("server_read", f"WITH {_srv} SELECT ts, asset, round(c, 8) AS close, rank FROM (SELECT *, row_number() OVER (PARTITION BY ts, asset ORDER BY c DESC, rank DESC) AS n FROM e) WHERE n = 1")(
    lambda s, d: _server(s, d).read_all().select("ts", "asset", "close", "rank")
)


@register("catalog_refresh", _two + ", m AS (SELECT max(ts) - INTERVAL 1 DAY AS cut FROM a) SELECT series, ts, round(ret, 8) AS ret FROM returns WHERE ts >= (SELECT cut FROM m) UNION ALL SELECT series, ts, round(ret, 8) FROM a WHERE ts < (SELECT cut FROM m)")
def catalog_refresh(s, d) -> DataFrame:
    old, _ = _old_new(s, d)
    sink = MemoryStore({"x": old})
    catalog = Catalog(sink)
    catalog.register("x", MemoryStore({"all": V.returns(s, d)}), source_key="all", lookback=timedelta(days=1))
    catalog.refresh("x")
    return sink.read("x").select("series", "ts", "ret")


STATEMENT = """ClientAccountID,CurrencyPrimary,ReportDate,Cash,Total
A1,USD,20240102,10,1000
A1,USD,20240103,10,1510
A1,USD,20240104,10,1525.1
B2,EUR,20240102,0,200
B2,EUR,20240104,0,210
ClientAccountID,CurrencyPrimary,FXRateToBase,Date/Time,Amount,Type
A1,HKD,0.5,20240103;101500,1000,Deposits/Withdrawals
A1,USD,,20240103,3,Dividends
B2,EUR,1,20240103,-5,Deposits/Withdrawals
"""
_nav = "n(account, ts, nav) AS (VALUES ('A1', TIMESTAMP '2024-01-02', 1000.0), ('A1', TIMESTAMP '2024-01-03', 1510.0), ('A1', TIMESTAMP '2024-01-04', 1525.1), ('B2', TIMESTAMP '2024-01-02', 200.0), ('B2', TIMESTAMP '2024-01-04', 210.0)), f(account, ts, flow) AS (VALUES ('A1', TIMESTAMP '2024-01-03', 500.0), ('B2', TIMESTAMP '2024-01-04', -5.0))"
register("statement_flows", "SELECT * FROM (VALUES ('A1', TIMESTAMP '2024-01-03', 'INJECTION', 500.0::DOUBLE), ('B2', TIMESTAMP '2024-01-03', 'WITHDRAWAL', 5.0::DOUBLE)) t(account, ts, flow_type, amount)")(
    lambda s, d: AC.StatementAccounts(s, STATEMENT).flows().select("account", "ts", "flow_type", "amount")
)
_prev = "lag(nav) OVER (PARTITION BY account ORDER BY ts)"
register("statement_returns", f"WITH {_nav}, r AS (SELECT account AS series, n.ts, (nav - {_prev} - coalesce(flow, 0)) / {_prev} AS ret, row_number() OVER (PARTITION BY account ORDER BY n.ts) AS k FROM n LEFT JOIN f USING (account, ts)) SELECT series, ts, round(ret::DOUBLE, 8) AS ret FROM r WHERE k > 1")(
    lambda s, d: AC.StatementAccounts(s, STATEMENT).to_returns()
)
register("statement_nav", f"WITH {_nav}, r AS (SELECT account, n.ts, nav, coalesce((nav - {_prev} - coalesce(flow, 0)) / {_prev}, 0)::DOUBLE AS rr FROM n LEFT JOIN f USING (account, ts)) SELECT account, ts, round(first_value(nav::DOUBLE) OVER (PARTITION BY account ORDER BY ts) * product(1 + rr) OVER (PARTITION BY account ORDER BY ts), 8) AS nav FROM r")(lambda s, d: AC.StatementAccounts(s, STATEMENT).nav())
register("statement_accounts", "SELECT * FROM (VALUES ('A1', 'USD', TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04'), ('B2', 'EUR', TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04')) t(account, currency, first, last)")(lambda s, d: AC.StatementAccounts(s, STATEMENT).list_accounts())
_pn = "lag(nav) OVER (PARTITION BY account ORDER BY ts)"
register(
    "account_returns_aum",
    V.with_ctes(V.SQL_NAV, V.SQL_FLOWS)
    + f", g AS (SELECT account, ts, sum(CASE flow_type WHEN 'INJECTION' THEN amount ELSE -amount END) AS fl FROM flows GROUP BY 1, 2), r AS (SELECT account AS series, n.ts, (nav - {_pn} - coalesce(fl, 0)) / ({_pn} + coalesce(fl, 0) / 2) AS ret, row_number() OVER (PARTITION BY account ORDER BY n.ts) AS k FROM nav n LEFT JOIN g USING (account, ts)) SELECT series, ts, round(ret, 8) + 0.0::DOUBLE AS ret FROM r WHERE k > 1",
)(lambda s, d: AC.account_returns(V.nav(s, d).drop("flow", "dist"), V.flows(s, d), basis="aum", method="modified_dietz"))
register("attribute_to_next_exact", V.with_ctes(V.SQL_NAV, V.SQL_FLOWS) + "SELECT account, ts, round(sum(amount), 4) AS amount FROM flows GROUP BY 1, 2", 4)(lambda s, d: N.attribute_to_next(V.flows(s, d), V.nav(s, d)))

register(
    "stream_bars",
    "SELECT date_trunc('hour', ts) AS ts, event_type AS asset, round(arg_min(value, ts), 8) AS open, round(max(value), 8) AS high, round(min(value), 8) AS low, round(arg_max(value, ts), 8) AS close, count(*) AS volume FROM events GROUP BY 1, 2",
)(lambda s, d: stream_bars(V.read(s, d, "events").select("ts", F.col("event_type").alias("asset"), F.col("value").alias("price"), F.lit(1).alias("volume"))))

register("report_overview", BASE + "SELECT series, " + ", ".join(f"round({SCALAR_SQL[n]}, 4) AS {n}" for n in ("total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar")) + " FROM staged GROUP BY series", 4)(lambda s, d: RP.overview_table(V.returns(s, d)))
register("report_returns_sheet", BASE + "SELECT series, ts, round(ret, 7) AS ret, round(wealth - 1, 7) AS cumulative FROM staged", 7)(lambda s, d: RP.returns_sheet(V.returns(s, d)))
register(
    "report_heatmap",
    V.with_ctes(V.SQL_TICKS, V.SQL_RETURNS, MONTHLY)
    + ", g AS (SELECT series, unnest(generate_series(date_trunc('month', min(ts))::TIMESTAMP, date_trunc('month', max(ts))::TIMESTAMP, INTERVAL 1 MONTH)) AS t FROM returns GROUP BY series) SELECT g.series, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, round(coalesce(ret, 0), 6) + 0.0::DOUBLE AS ret FROM g LEFT JOIN m ON m.series = g.series AND m.y = year(t) AND m.mo = month(t)",
    6,
)(lambda s, d: RP.heatmap_table(V.returns(s, d)))
register(
    "report_drawdown_pill",
    BASE + ", pk AS (SELECT *, max(CASE WHEN dd = 0 THEN ts END) OVER (PARTITION BY series ORDER BY ts) AS peak FROM staged) SELECT series, round(min(dd), 6) + 0.0::DOUBLE AS max_drawdown, arg_min(peak, (dd, ts)) AS peak_ts, round(avg(dd) FILTER (WHERE dd < 0), 6) AS avg_drawdown FROM pk GROUP BY series",
    6,
)(lambda s, d: RP.drawdown_pill(V.returns(s, d)))
register(
    "report_distribution",
    RETS + ", e AS (SELECT min(ret) AS a, max(ret) AS b FROM returns), k AS (SELECT a, b, CAST(least(floor((ret - a) / ((b - a) / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM returns, e GROUP BY ALL) SELECT bin, round(a + bin * ((b - a) / 60), 6) + 0.0::DOUBLE AS lo, round(a + (bin + 1) * ((b - a) / 60), 6) + 0.0::DOUBLE AS hi, n FROM k",
    6,
)(lambda s, d: E.histogram(V.returns(s, d), "ret", 60))
