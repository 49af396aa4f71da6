"""One small local session for all tests; frames seeded like the survey's fixtures."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel() -> pd.DataFrame:
    """252 business days of three series."""
    rng = np.random.default_rng(42)
    days = pd.bdate_range("2021-01-04", periods=252)
    return pd.DataFrame(rng.normal(0.0005, 0.01, (252, 3)), index=days, columns=["AAA", "BBB", "CCC"])


@pytest.fixture(scope="session")
def returns(spark, panel):
    long = panel.rename_axis("ts").reset_index().melt("ts", var_name="series", value_name="ret")
    return spark.createDataFrame(long).cache()


@pytest.fixture(scope="session")
def bars(spark):
    """50 business days of two assets."""
    rng = np.random.default_rng(42)
    rows = []
    for asset in ("AAA", "BBB"):
        close = 100 + np.cumsum(rng.normal(0, 1, 50))
        for ts, c in zip(pd.bdate_range("2022-01-03", periods=50), close, strict=True):
            o = c + rng.normal(0, 0.3)
            rows.append((ts.to_pydatetime(), asset, float(o), float(max(o, c) + 0.5), float(min(o, c) - 0.5), float(c), float(rng.integers(1_000_000, 5_000_000))))
    return spark.createDataFrame(rows, "ts timestamp, asset string, open double, high double, low double, close double, volume double").cache()
