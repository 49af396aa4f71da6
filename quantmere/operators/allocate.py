"""Portfolio weights: equal, inverse volatility, maximum Sharpe, hierarchical risk parity; purged folds.

Moments are Spark aggregates (one row per pair of assets); the solvers run on
the driver over the covariance matrix, whose size is assets squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ASSETS = 5000


def equal_weighted(returns: DataFrame) -> DataFrame:
    s = returns.select("series").distinct()
    return s.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(F.lit(1))))


def inverse_volatility(returns: DataFrame) -> DataFrame:
    """1 / sigma, normalised; sigma 0 weighs 0, all 0 weigh the same."""
    vol = returns.groupBy("series").agg(F.stddev_samp("ret").alias("vol"))
    inv = vol.withColumn("inv", F.coalesce(F.try_divide(F.lit(1.0), F.col("vol")), F.lit(0.0)))
    everyone = Window.partitionBy(F.lit(1))  # one row per asset
    total, n = F.sum("inv").over(everyone), F.count("*").over(everyone)
    return inv.select("series", F.when(total > 0, F.col("inv") / total).otherwise(1 / n).alias("weight"))


def covariances(returns: DataFrame) -> DataFrame:
    """(a, b, cov) of all pairs of assets over their common dates."""
    left = returns.select("ts", F.col("series").alias("a"), F.col("ret").alias("ra"))
    right = returns.select("ts", F.col("series").alias("b"), F.col("ret").alias("rb"))
    return left.join(right, "ts").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("cov"))


def moments(returns: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, means and covariance matrix on the driver; refuses more than MAX_ASSETS assets."""
    means = returns.groupBy("series").agg(F.avg("ret").alias("m")).limit(MAX_ASSETS + 1).toPandas().sort_values("series")
    if len(means) > MAX_ASSETS:
        raise ValueError(f"more than {MAX_ASSETS} assets: the covariance matrix would not fit the driver")
    names = means["series"].tolist()
    at = {n: k for k, n in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for r in covariances(returns).toLocalIterator():
        cov[at[r.a], at[r.b]] = r.cov if r.cov is not None else 0.0
    return names, means["m"].to_numpy(float), cov


def max_sharpe(mean: np.ndarray, cov: np.ndarray, *, risk_free: float = 0.0, l2: float = 0.0, steps: int = 4000) -> np.ndarray:
    """Long-only weights of largest Sharpe ratio, by projected gradient from equal weights."""
    n = len(mean)
    cov = cov + l2 * np.eye(n)
    w = np.full(n, 1 / n)

    def project(v: np.ndarray) -> np.ndarray:
        u = np.sort(v)[::-1]
        css = (np.cumsum(u) - 1) / np.arange(1, n + 1)
        return np.maximum(v - css[np.flatnonzero(u > css)[-1]], 0)

    def value(x: np.ndarray) -> float:
        return float((mean @ x - risk_free) / np.sqrt(max(x @ cov @ x, 1e-300)))

    best, rate = value(w), 1.0
    for _ in range(steps):
        var = max(w @ cov @ w, 1e-300)
        grad = (mean * var - (mean @ w - risk_free) * (cov @ w)) / var**1.5
        norm = np.abs(grad).max()
        if not np.isfinite(norm) or norm == 0:
            break
        new = project(w + rate * grad / norm)
        now = value(new)
        if now > best + 1e-15:
            w, best, rate = new, now, min(rate * 1.5, 1.0)
        else:
            rate /= 2
            if rate < 1e-12:
                break
    return w if np.isfinite(best) else np.full(n, 1 / n)


def risk_parity_tree(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on correlation distance, then recursive bisection."""
    n = len(cov)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    dist = np.sqrt(np.maximum((1 - cov / np.outer(sd, sd)) / 2, 0))
    groups = {k: [k] for k in range(n)}
    gap = dist.copy()
    np.fill_diagonal(gap, np.inf)
    while len(groups) > 1:
        keys = list(groups)
        sub = gap[np.ix_(keys, keys)]
        i, j = divmod(int(np.argmin(sub)), len(keys))
        a, b = keys[min(i, j)], keys[max(i, j)]
        groups[a] += groups.pop(b)
        gap[a], gap[:, a] = np.minimum(gap[a], gap[b]), np.minimum(gap[:, a], gap[:, b])
        gap[a, a] = np.inf
    order = next(iter(groups.values())) if groups else []
    w = np.ones(n)

    def variance(ids: list[int]) -> float:
        c = cov[np.ix_(ids, ids)]
        iv = 1 / np.maximum(np.diag(c), 1e-300)
        iv /= iv.sum()
        return float(iv @ c @ iv)

    stack = [order]
    while stack:
        ids = stack.pop()
        if len(ids) < 2:
            continue
        left, right = ids[: len(ids) // 2], ids[len(ids) // 2 :]
        vl, vr = variance(left), variance(right)
        share = 1 - vl / (vl + vr) if vl + vr > 0 else 0.5
        w[left] *= share
        w[right] *= 1 - share
        stack += [left, right]
    return w


def solve(returns: DataFrame, how: str = "mvo", **options) -> DataFrame:
    """(series, weight) of 'mvo' or 'hrp'."""
    names, mean, cov = moments(returns)
    if not names:
        return returns.sparkSession.createDataFrame([], "series string, weight double")
    w = max_sharpe(mean, cov, **options) if how == "mvo" else risk_parity_tree(cov)
    return returns.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(names, w, strict=True)], "series string, weight double")


def predict(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Returns of the weighted portfolio."""
    return returns.join(weights, "series").groupBy("ts").agg(F.sum(F.coalesce(F.col("ret") * F.col("weight"), F.lit(0.0))).alias("ret"))


def kfold(rows: DataFrame, n_splits: int = 5, *, purge: int = 0, embargo: int = 0, key: str | None = None, ts: str = "ts") -> DataFrame:
    """(fold, role) of every row: contiguous test folds, the first n % k one longer.

    Training leaves out ``purge`` rows before the test fold and ``embargo`` rows
    after it; such rows don't appear for that fold.
    """
    part = Window.partitionBy(key) if key else Window.partitionBy(F.lit(1))
    pos = rows.withColumn("pos", F.row_number().over(part.orderBy(ts)) - 1).withColumn("n", F.count("*").over(part))
    size, extra = F.floor(F.col("n") / n_splits), F.col("n") % n_splits
    folds = pos.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(n_splits)])))
    start = F.col("fold") * size + F.least(F.col("fold"), extra)
    stop = start + size + (F.col("fold") < extra).cast("int")
    role = F.when((F.col("pos") >= start) & (F.col("pos") < stop), "test").when((F.col("pos") >= start - purge) & (F.col("pos") < stop + embargo), None).otherwise("train")
    return folds.withColumn("role", role).filter("role IS NOT NULL").drop("n")
