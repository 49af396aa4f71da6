"""Structured Streaming: bars with late data, upserts into stores, running drawdown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stores import Store


def stream_bars(ticks: DataFrame, width: str = "1 hour", *, late: str = "2 hours", key: str = "asset", price: str = "price", volume: str = "volume") -> DataFrame:
    """OHLCV bars of a stream of (ts, key, price, volume); state older than ``late`` is dropped."""
    marked = ticks.withWatermark("ts", late)
    agg = marked.groupBy(F.window("ts", width), key).agg(
        F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "ts").alias("close"), F.sum(volume).alias("volume")
    )
    return agg.select(F.col("window.start").alias("ts"), F.col(key).alias("asset"), "open", "high", "low", "close", "volume")


def stream_upsert(df: DataFrame, store: Store, key: str, checkpoint: str):
    """Each micro-batch is upserted under the key; a batch that runs twice changes nothing."""
    return df.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(lambda batch, _: store.write(key, batch, mode="upsert"))


STATE = "wealth double, peak double"
OUT = "series string, ts timestamp, wealth double, drawdown double"


def running_drawdown(returns: DataFrame) -> DataFrame:
    """Wealth and drawdown of each series as returns arrive, in time order within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wealth, peak = state.get if state.exists else (1.0, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, r in zip(rows["ts"], rows["ret"], strict=True):
            wealth *= 1 + (0.0 if pd.isna(r) else r)
            peak = wealth if peak is None else max(peak, wealth)
            out.append((key[0], ts, wealth, wealth / peak - 1))
        state.update((wealth, peak))
        yield pd.DataFrame(out, columns=["series", "ts", "wealth", "drawdown"])

    return returns.groupBy("series").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
