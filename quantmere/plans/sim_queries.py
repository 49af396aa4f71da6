"""Queries of the simulator, its strategies, stores, accounts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sim as X
from ..operators.patterns import Condition
from ..operators.strategies import DCA, Hold, PatternStrategy
from . import views as V
from .core_queries import register

COST = dict(costs=X.FixedBps(5), slippage=X.HalfSpread(3))


def _sim(s, d, **options) -> X.Simulator:
    return X.Simulator(V.bars(s, d), **(COST | options))


def _weights(s, d) -> DataFrame:
    """Equal weights on the first bar of every tenth day."""
    b = V.bars(s, d)
    first = b.filter("day(ts) % 10 = 1").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.min("ts").alias("ts"))
    return b.join(first.select("ts"), "ts").select("ts", "asset", F.lit(0.2).alias("weight"))


def _signals(s, d) -> DataFrame:
    return V.bars(s, d).select("ts", "asset", (F.hour("ts") == 9).alias("entry"), (F.hour("ts") == 15).alias("exit"))


def _orders(s, d, brackets: bool = False) -> DataFrame:
    o = V.bars(s, d).filter("hour(ts) = 10 AND day(ts) % 3 = 0").select("ts", "asset", F.lit("buy").alias("side"), F.lit(10.0).alias("qty"))
    return o.withColumns({"sl_stop": F.lit(0.02), "tp_stop": F.lit(0.03), "tsl_stop": F.lit(0.025)}) if brackets else o


register("sim_weights", None, 6)(lambda s, d: _sim(s, d).run_weights(_weights(s, d)).equity)
register("sim_signals", None, 6)(lambda s, d: _sim(s, d).run_signals(_signals(s, d), size=0.1).trades)
register("sim_orders", None, 6)(lambda s, d: _sim(s, d).run_orders(_orders(s, d)).trades)
register("sim_brackets", None, 6)(lambda s, d: _sim(s, d).run_orders(_orders(s, d, True)).trades)
register("sim_hold", None, 6)(lambda s, d: _sim(s, d).run_strategy(Hold(horizon="weekly")).equity)
register("sim_dca", None, 6)(lambda s, d: _sim(s, d).run_strategy(DCA(amount=1000.0, horizon="weekly")).equity)
register("sim_pattern", None, 6)(lambda s, d: _sim(s, d).run_strategy(PatternStrategy("double_bottom", Condition("bullish"), min_quality=0.0)).trades)
register("sim_grid", None, 6)(lambda s, d: X.simulate(V.bars(s, d), _weights(s, d).withColumn("run_id", F.explode(F.array(*[F.lit(str(k)) for k in range(4)]))).withColumn("weight", F.col("weight") * (1 + F.col("run_id").cast("int")) / 4), X.weights_decider).equity)

#: buy and hold without costs has a closed form: cash + shares * price
_hold = """, fb AS (SELECT asset, ts, open, close, row_number() OVER (PARTITION BY asset ORDER BY ts) AS n FROM bars),
  q AS (SELECT b.asset, 1000000 * 0.2 / b.close AS qty, c.open AS px, c.ts AS fts FROM (SELECT * FROM bars WHERE ts = (SELECT min(ts) FROM bars)) b JOIN fb c ON c.asset = b.asset AND c.ts = (SELECT min(ts) FROM bars WHERE ts > (SELECT min(ts) FROM bars))),
  t AS (SELECT DISTINCT ts FROM bars),
  v AS (SELECT t.ts, q.asset, q.qty, q.px, (SELECT arg_max(close, x.ts) FROM bars x WHERE x.asset = q.asset AND x.ts <= t.ts) AS close FROM t, q WHERE t.ts >= q.fts)
SELECT ts, round(1000000 + sum(qty * (close - px)), 4) AS equity FROM v GROUP BY ts"""
register("sim_hold_closed_form", V.with_ctes(V.SQL_TICKS, V.SQL_BARS) .rstrip() + _hold, 4)(
    lambda s, d: _buy_once(s, d)  # noqa: PLW0108
)


def _buy_once(s, d) -> DataFrame:
    b = V.bars(s, d)
    first = b.agg(F.min("ts").alias("ts"))
    weights = b.join(F.broadcast(first), "ts").select("ts", "asset", F.lit(0.2).alias("weight"))
    second = b.join(F.broadcast(first.withColumnRenamed("ts", "t0"))).filter(F.col("ts") > F.col("t0")).agg(F.min("ts").alias("t1"))
    eq = X.Simulator(b, costs=X.NoCost()).run_weights(weights).equity
    return eq.join(F.broadcast(second)).filter(F.col("ts") >= F.col("t1")).select("ts", "equity")

