"""The supplied tables seen as returns, bars, NAV and weights, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", ((F.col("value") - 50) / 2500).alias("ret"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean return of each event type."""
    t = ticks(spark, sf_dir)
    return t.groupBy("series", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("ret").alias("ret"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("ret").alias("bench"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    hour = t.groupBy(F.col("series").alias("asset"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.avg("ret").alias("ret"), F.max("ret").alias("hi"), F.min("ret").alias("lo"), F.count("*").cast("double").alias("volume")
    )
    w = Window.partitionBy("asset").orderBy("ts")
    close = F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100.0
    b = hour.withColumn("close", close).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return b.select(
        "ts", "asset", "open",
        (F.greatest("open", "close") * (1 + F.abs("hi") / 10)).alias("high"),
        (F.least("open", "close") * (1 - F.abs("lo") / 10)).alias("low"),
        "close", "volume",
    )


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, ts, nav, flow, dist): order totals by date and priority, their running sum as NAV."""
    o = read(spark, sf_dir, "orders")
    day = o.groupBy(F.col("o_orderpriority").alias("account"), F.date_trunc("day", "o_orderdate").alias("ts")).agg(
        F.sum("o_totalprice").alias("total"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.lit(0.0)).alias("flow")
    )
    w = Window.partitionBy("account").orderBy("ts")
    return day.select("account", "ts", (F.sum("total").over(w) + 1_000_000.0).alias("nav"), (F.col("flow") / 10).alias("flow"), (F.col("total") / 1000).alias("dist"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capital flows of accounts, on dates that need not be NAV dates."""
    o = read(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "INJECTION").when(F.col("o_orderstatus") == "O", "WITHDRAWAL").otherwise("DISTRIBUTION")
    return o.select(F.col("o_orderpriority").alias("account"), F.date_trunc("day", "o_orderdate").alias("ts"), kind.alias("flow_type"), (F.col("o_totalprice") / 100).alias("amount"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weights of each event type: its share of the day's events."""
    e = read(spark, sf_dir, "events")
    day = e.groupBy(F.date_trunc("day", "ts").alias("ts"), F.col("event_type").alias("asset")).agg(F.count("*").alias("n"))
    return day.select("ts", "asset", (F.col("n") / F.sum("n").over(Window.partitionBy("ts"))).alias("weight"))


def study_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's events on the bars: every bar that closes above the highs of the five before it."""
    b = bars(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("ts")
    top = F.max("high").over(w.rowsBetween(-5, -1))
    e = b.withColumns({"top": top, "pos": F.row_number().over(w), "low5": F.min("low").over(w.rowsBetween(-5, -1)), "start": F.lag("ts", 5).over(w)})
    e = e.filter((F.col("close") > F.col("top")) & (F.col("pos") > 5))
    return e.select(
        F.lit("breakout5").alias("pattern"), "asset", F.col("start").alias("formation_start"), F.col("ts").alias("formation_end"), F.col("ts").alias("breakout_ts"),
        F.col("top").alias("entry_price"), F.col("close").alias("breakout_price"), F.lit(None).cast("double").alias("target_price"), F.lit(None).cast("double").alias("stop_price"),
        (F.lit(50) + F.least(F.lit(50.0), (F.col("close") / F.col("top") - 1) * 10000)).alias("quality"), F.col("low5").alias("pivot_low"), F.col("top").alias("pivot_high"),
    )


#: The same views as common table expressions.
SQL_TICKS = "ticks AS (SELECT event_type AS series, ts, (value - 50) / 2500 AS ret FROM events)"
SQL_RETURNS = "returns AS (SELECT series, date_trunc('hour', ts) AS ts, avg(ret) AS ret FROM ticks GROUP BY 1, 2)"
SQL_BENCH = "bench AS (SELECT date_trunc('hour', ts) AS ts, avg(ret) AS bench FROM ticks GROUP BY 1)"
SQL_STAGED = """st1 AS (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY ts) AS wealth,
    lag(ret, 1) OVER (PARTITION BY series ORDER BY ts) AS lag1, lag(ret, 2) OVER (PARTITION BY series ORDER BY ts) AS lag2,
    lag(ret, 3) OVER (PARTITION BY series ORDER BY ts) AS lag3, quantile_cont(ret, 0.05) OVER (PARTITION BY series) AS v FROM returns),
  staged AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY series ORDER BY ts) - 1 AS dd FROM st1)"""
SQL_BARS = """hours AS (SELECT series AS asset, date_trunc('hour', ts) AS ts, avg(ret) AS ret, max(ret) AS hi, min(ret) AS lo, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2),
  closes AS (SELECT *, 100 * product(1 + ret) OVER (PARTITION BY asset ORDER BY ts) AS close FROM hours),
  opens AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY asset ORDER BY ts), 100) AS open FROM closes),
  bars AS (SELECT ts, asset, open, greatest(open, close) * (1 + abs(hi) / 10) AS high, least(open, close) * (1 - abs(lo) / 10) AS low, close, volume FROM opens)"""
SQL_NAV = """days AS (SELECT o_orderpriority AS account, date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS total,
    coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) AS flow FROM orders GROUP BY 1, 2),
  nav AS (SELECT account, ts, sum(total) OVER (PARTITION BY account ORDER BY ts) + 1000000 AS nav, flow / 10 AS flow, total / 1000 AS dist FROM days)"""
SQL_FLOWS = """flows AS (SELECT o_orderpriority AS account, date_trunc('day', o_orderdate) AS ts,
    CASE o_orderstatus WHEN 'F' THEN 'INJECTION' WHEN 'O' THEN 'WITHDRAWAL' ELSE 'DISTRIBUTION' END AS flow_type, o_totalprice / 100 AS amount FROM orders)"""
SQL_WEIGHTS = """wdays AS (SELECT date_trunc('day', ts) AS ts, event_type AS asset, count(*) AS n FROM events GROUP BY 1, 2),
  weights AS (SELECT ts, asset, n / sum(n) OVER (PARTITION BY ts) AS weight FROM wdays)"""
SQL_EVENTS = """ev1 AS (SELECT *, max(high) OVER w5 AS top, min(low) OVER w5 AS low5, row_number() OVER w AS pos, lag(ts, 5) OVER w AS start FROM bars
    WINDOW w AS (PARTITION BY asset ORDER BY ts), w5 AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
  ev AS (SELECT asset, start AS formation_start, ts AS breakout_ts, top AS entry_price, close AS breakout_price, CAST(NULL AS DOUBLE) AS stop_price,
    50 + least(50.0, (close / top - 1) * 10000) AS quality, low5 AS pivot_low, top AS pivot_high FROM ev1 WHERE close > top AND pos > 5)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n  ".join(ctes) + "\n"
