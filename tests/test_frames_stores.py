"""Reshapes, stores, catalog, accounts, REST parsing, streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantmere.errors import AmbiguousError, MalformedDataError, NotFoundError, ReadOnlyError
from quantmere.operators import allocate as A
from quantmere.operators import eda as E
from quantmere.operators import frames as FR
from quantmere.operators import indicators as I
from quantmere.sources import accounts as AC
from quantmere.sources import rest as RS
from quantmere.sources.catalog import Catalog
from quantmere.sources.stores import CsvStore, MemoryStore, ParquetStore, TableStore
from quantmere.streaming.streams import running_drawdown, stream_bars


def test_as_wide_refuses_repeats(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "ts int, asset string, value double")
    with pytest.raises(Exception, match="repeated"):
        FR.as_wide(df, assets=["a"]).collect()


def test_names():
    assert [FR.normalize_field(x) for x in ("AdjClose", "Open Price", "a-b", "RSI14")] == ["adj_close", "open_price", "a_b", "rsi14"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (1.0, 3)], "x double, k int")
    assert [r.x for r in FR.nan_to_null(df).orderBy("k").collect()] == [None, None, 1.0]


@pytest.mark.parametrize("kind", ["memory", "parquet", "table"])
def test_store_modes(spark, tmp_path, kind):
    store = {"memory": lambda: MemoryStore(), "parquet": lambda: ParquetStore(spark, f"file://{tmp_path}/s"), "table": lambda: TableStore(spark)}[kind]()
    key = f"a/{kind}"
    day = lambda k: datetime(2024, 1, k)
    frame = lambda rows: spark.createDataFrame(rows, "ts timestamp, x double")
    store.write(key, frame([(day(1), 1.0), (day(2), 2.0)]))
    store.write(key, frame([(day(2), 20.0), (day(3), 3.0)]), mode="upsert")
    assert [(r.ts.day, r.x) for r in store.read(key).orderBy("ts").collect()] == [(1, 1.0), (2, 20.0), (3, 3.0)]
    store.write(key, frame([(day(4), 4.0)]), mode="append")
    assert store.last_index(key) == day(4) and key in store.keys()
    assert [r.x for r in store.read(key, start=day(2), end=day(3), columns=["x"]).orderBy("ts").collect()] == [20.0, 3.0]
    with pytest.raises(FileExistsError):
        store.write(key, frame([(day(1), 1.0)]), mode="error")
    store.delete(key)
    with pytest.raises(NotFoundError):
        store.read(key)


def test_read_only_and_csv(spark, tmp_path):
    pd.DataFrame({"date": ["2024-01-01", "2024-01-02"], "close": [1.0, 2.0]}).to_csv(tmp_path / "AAA.csv", index=False)
    store = CsvStore(spark, str(tmp_path))
    assert {(r.asset, r.close) for r in store.read().collect()} == {("AAA", 1.0), ("AAA", 2.0)}
    with pytest.raises(ReadOnlyError):
        store.write("x", store.read())
    with pytest.raises(ReadOnlyError):
        MemoryStore(read_only=True).write("x", store.read())


def test_catalog_round_trip(spark, returns):
    cat = Catalog(MemoryStore())
    cat.register("r", MemoryStore({"k": returns}), source_key="k", lookback=timedelta(days=3), tags=("daily",), spec={"class": "quantmere.sources.stores.MemoryStore"})
    assert cat.load("r").count() == 756 and cat.store.exists("r")
    assert cat.refresh_all(tags=("daily",)) == ["r"] and cat.store.read("r").count() == 756
    with pytest.raises(AmbiguousError):
        cat.register("r", MemoryStore())
    again = Catalog.from_spec(MemoryStore(), cat.to_spec())
    assert again.datasets["r"].lookback == timedelta(days=3)
    assert cat.describe(spark).first().store_key == "r"


def test_statement_errors():
    with pytest.raises(MalformedDataError):
        AC.parse_statement("ClientAccountID,What\nA,1\n")
    with pytest.raises(MalformedDataError):
        AC.parse_statement("ClientAccountID,CurrencyPrimary,ReportDate,Total\nA,USD\n")


def test_rest_pages_and_errors():
    v = RS.VENDORS["candles"]
    answers = [{"candles": [{"t": "2024-01-01T00:00:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 3}], "has_next": True}, {"candles": [{"t": 1704153600, "o": 1, "h": 2, "l": 0.5, "c": 1.6, "v": None}]}]
    rows = list(RS.fetch(v, "AAA", "1d", None, None, get=lambda url, params, headers: answers[int(params["page"]) - 1]))
    assert [(r[1].day, r[5]) for r in rows] == [(1, 1.5), (2, 1.6)]
    with pytest.raises(MalformedDataError):
        list(RS.parse_rows({"candles": [{"t": "x"}]}, v, "AAA"))
    with pytest.raises(MalformedDataError):
        list(RS.parse_rows({}, v, "AAA"))


def test_indicators_by_hand(bars):
    pdf = bars.filter("asset = 'AAA'").toPandas().sort_values("ts").reset_index(drop=True)
    ema = I.indicator("ema", bars, n=5).filter("asset = 'AAA'").toPandas().sort_values("ts")["ema"].to_numpy(float)
    want = pdf["close"][:5].mean()
    for k in range(5, 50):
        want += (pdf["close"][k] - want) * 2 / 6
    assert ema[-1] == pytest.approx(want)
    rsi = I.indicator("rsi", bars).toPandas()["rsi"].dropna()
    assert rsi.between(0, 100).all() and set(I.list_indicators()) >= {"sma", "atr", "macd", "adx"}


def test_pipeline_and_feature_store(spark, bars):
    pipe = I.FeaturePipeline([("fast", "sma", {"n": 3}), ("m", "mom", {"n": 2})])
    fs = I.FeatureStore(MemoryStore())
    out = fs.get_or_compute("d", pipe, bars)
    assert out.columns == ["asset", "ts", "fast__sma", "m__mom"] and len(fs.list("d")) == 1
    fs.invalidate("d", pipe)
    assert not fs.list()


def test_allocations_sum_to_one(returns):
    for how in ("mvo", "hrp"):
        assert A.solve(returns, how).agg(F.sum("weight")).first()[0] == pytest.approx(1)
    assert A.inverse_volatility(returns).agg(F.sum("weight")).first()[0] == pytest.approx(1)


def test_folds_are_disjoint(returns):
    k = A.kfold(returns, 4, purge=2, embargo=3, key="series").filter("series = 'AAA'").toPandas()
    for fold, g in k.groupby("fold"):
        test, train = set(g[g.role == "test"].pos), set(g[g.role == "train"].pos)
        assert not test & train and not train & set(range(min(test) - 2, max(test) + 4)), fold
    assert k[k.role == "test"].pos.nunique() == 252


def test_ks_p_value():
    assert E.kolmogorov_p(0.0, 100, 100) == 1.0
    assert E.kolmogorov_p(0.3, 100, 100) == pytest.approx(0.00024, rel=0.1)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    ticks = spark.createDataFrame([(datetime(2024, 1, 1, 0, k * 7 % 60), "A", 100.0 + k, 1) for k in range(8)], "ts timestamp, asset string, price double, volume int")
    ticks.write.parquet(str(src))
    live = spark.readStream.schema(ticks.schema).parquet(str(src))
    q = stream_bars(live, "30 minutes").writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.ts.minute, r.open, r.close) for r in spark.table("bars_out").collect()}
    want = {(r.ts.minute, r.open, r.close) for r in stream_bars(ticks, "30 minutes").collect()}
    assert got == want
    rets = spark.createDataFrame([("s", datetime(2024, 1, k), r) for k, r in ((1, 0.1), (2, -0.5), (3, 0.2))], "series string, ts timestamp, ret double")
    rets.write.parquet(str(tmp_path / "r"))
    q = running_drawdown(spark.readStream.schema(rets.schema).parquet(str(tmp_path / "r"))).writeStream.format("memory").queryName("dd_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [round(r.drawdown, 6) for r in spark.table("dd_out").orderBy("ts").collect()] == [0.0, -0.5, -0.4]
