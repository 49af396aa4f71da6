"""Exploratory statistics, drift between two frames and alerts."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k in NUMERIC or k.startswith("decimal")]


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: counts, moments, quartiles, zeros and infinities in one pass, distinct values in another.

    Quantiles are exact and linear, of a column all at once; text columns have nulls
    in the numeric fields.  Distinct values are counted in two levels over all
    columns together, so no row is expanded by the aggregation.
    """
    numeric = set(numeric_columns(df))
    n = F.count(F.lit(1))
    per = []
    for c, kind in df.dtypes:
        x, isnum = _finite(c) if c in numeric else F.lit(None).cast("double"), c in numeric
        raw = F.col(c).cast("double") if isnum else F.lit(None).cast("double")
        k = F.count(x)
        num = lambda v, on=isnum: v if on else F.lit(None).cast("double")
        quartile = F.percentile(x, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))
        missing = F.count_if(F.col(c).isNull() | (F.isnan(F.col(c)) if kind in ("double", "float") else F.lit(False)))
        per.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("dtype"), (n - missing).alias("count"), missing.alias("missing"),
                F.try_divide(missing * 100.0, n).alias("missing_pct"),
                num(F.avg(x)).alias("mean"), num(F.stddev_samp(x)).alias("std"), num(F.min(x)).alias("min"),
                num(quartile[0]).alias("q25"), num(quartile[1]).alias("median"), num(quartile[2]).alias("q75"), num(F.max(x)).alias("max"),
                num(F.when(k > 2, F.skewness(x) * F.sqrt(k * (k - 1)) / (k - 2))).alias("skew"),
                num(F.when(k > 3, ((k + 1) * F.kurtosis(x) + 6) * (k - 1) / ((k - 2) * (k - 3)))).alias("kurt"),
                num(F.try_divide(F.count_if(raw == 0) * 100.0, n)).alias("zeros_pct"), num(F.try_divide(F.count_if(F.abs(raw) == float("inf")) * 100.0, n)).alias("inf_pct"),
            )
        )
    stats = df.agg(F.array(*per).alias("s")).select(F.inline("s"))
    values = _unpivoted(df).filter("v IS NOT NULL").groupBy("column", "v").count()
    distinct = values.groupBy("column").agg(F.count("*").alias("distinct"))
    first = stats.columns[: stats.columns.index("missing_pct") + 1]
    return stats.join(distinct, "column", "left").select(*first, F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"), *stats.columns[len(first) :])


def _unpivoted(df: DataFrame) -> DataFrame:
    """(column, v): every cell as text."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("e")).select("e.*")


def column_modes(df: DataFrame) -> DataFrame:
    """(column, mode, mode_pct): the most frequent value as text, ties to the smallest; by counts, one row per distinct value."""
    counts = _unpivoted(df).filter("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("o"), "v")).alias("b"), F.sum("n").alias("t"))
    return best.select("column", F.col("b.v").alias("mode"), (-F.col("b.o") * 100.0 / F.col("t")).alias("mode_pct"))


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells and repeated rows."""
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    distinct = df.groupBy(*df.columns).agg(F.count("*").alias("__n")).agg(F.sum(F.col("__n") - 1).alias("duplicate_rows"))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing_cells"))
    k = len(df.columns)
    return counts.join(F.broadcast(distinct)).select("rows", F.lit(k).cast("long").alias("columns"), (F.col("rows") * k).alias("cells"), "missing_cells", F.coalesce("duplicate_rows", F.lit(0)).cast("long").alias("duplicate_rows"))


def describe(df: DataFrame, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, stat, value) of the numeric columns."""
    per = []
    for c in numeric_columns(df):
        x = _finite(c)
        stats = {"count": F.count(x).cast("double"), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x)}
        stats |= {f"{100 * p:g}%": F.percentile(x, F.lit(p)) for p in percentiles} | {"max": F.max(x)}
        per += [F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), v.alias("value")) for s, v in stats.items()]
    return df.agg(F.array(*per).alias("s")).select(F.inline("s"))


def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, corr) of all pairs a < b in one pass."""
    cols = columns or numeric_columns(df)
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k + 1 :]]
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*items).alias("s")).select(F.inline("s"))


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, corr) of average ranks, over rows complete in all columns.

    Ranks are prefix counts of distinct values, summed over range partitions, so
    no column is sorted in one task.
    """
    cols = columns or numeric_columns(df)
    whole = base = df.select(*cols).dropna()
    for c in cols:
        base = base.join(ranks_of(whole.select(c), c), c)
    ranked = base.select(*[F.col(f"{c}__rank").alias(c) for c in cols])
    return pearson(ranked, cols)


def ranks_of(values: DataFrame, c: str, *keys: str) -> DataFrame:
    """(keys, value, average rank) of the distinct values of one column inside each key, by two-level prefix sums."""
    counts = values.groupBy(*keys, c).agg(F.count("*").alias("__n"))
    placed = prefix_sums(counts, (c,), {"__before": "__n"}, keys)
    return placed.select(*keys, c, (F.col("__before") + (F.col("__n") + 1) / 2).alias(f"{c}__rank"))


def prefix_sums(df: DataFrame, order: tuple[str, ...], sums: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds to each row, for each name: value of ``sums``, the value's sum over the rows of its key before it.

    Rows are dealt by ranges of keys and order; sums inside a range are windows,
    sums of the ranges before are windows over one row for each range and key.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("__p", F.spark_partition_id())
    own = Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__p", *keys).agg(*[F.sum(v).alias(f"__t_{k}") for k, v in enumerate(sums.values())])
    ahead = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *keys, *[F.coalesce(F.sum(f"__t_{k}").over(ahead), F.lit(0)).alias(f"__b_{k}") for k in range(len(sums))])
    placed = dealt.withColumns({f"__o_{k}": F.coalesce(F.sum(v).over(own), F.lit(0)) for k, v in enumerate(sums.values())})
    joined = placed.join(before, ["__p", *keys])
    return joined.select(*df.columns, *[(F.col(f"__o_{k}") + F.col(f"__b_{k}")).alias(name) for k, name in enumerate(sums)])


def numbered(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """Rows with their number (from 0) in an order over all of them, by two-level prefix sums."""
    return prefix_sums(df.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"}).drop("__one")


def drift(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per shared numeric column: means, spreads, missing shares, KS statistic and Wasserstein-1 distance; one scan of each frame."""
    shared = columns or [c for c in numeric_columns(a) if c in b.columns]

    def cells(df: DataFrame, w: int) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c).alias("column"), _finite(c).alias("x"), F.col(c).isNull().alias("m")) for c in shared])
        return df.select(F.inline(each)).withColumn("w", F.lit(w))

    both = cells(a, 1).unionByName(cells(b, 0))
    in_a, in_b = F.when(F.col("w") == 1, F.col("x")), F.when(F.col("w") == 0, F.col("x"))
    stats = both.groupBy("column").agg(
        F.avg(in_a).alias("mean_a"), F.avg(in_b).alias("mean_b"), F.stddev_samp(in_a).alias("std_a"), F.stddev_samp(in_b).alias("std_b"),
        (F.avg(F.when(F.col("w") == 1, F.col("m").cast("double"))) * 100).alias("missing_a"), (F.avg(F.when(F.col("w") == 0, F.col("m").cast("double"))) * 100).alias("missing_b"),
        F.count(in_a).alias("n_a"), F.count(in_b).alias("n_b"),
    )
    return stats.join(ecdf_distances(both, "column"), "column", "left").select(
        "column", "mean_a", "mean_b", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("std_a")).alias("mean_shift"),
        F.try_divide(F.col("std_b"), F.col("std_a")).alias("std_ratio"), "ks_stat", "wasserstein", (F.col("missing_b") - F.col("missing_a")).alias("missing_delta"), "n_a", "n_b",
    )


def ecdf_distances(both: DataFrame, *keys: str) -> DataFrame:
    """(keys, ks_stat, wasserstein) of two samples in (x, w: 1 or 0), over their merged distinct values.

    Cumulative counts are two-level prefix sums over range partitions.
    """
    counts = both.filter("x IS NOT NULL").groupBy(*keys, "x").agg(F.sum("w").alias("na"), F.sum(1 - F.col("w")).alias("nb"))
    dealt = counts.repartitionByRange(*[F.col(c) for c in (*keys, "x")]).withColumn("p", F.spark_partition_id())
    first = dealt.groupBy("p", *keys).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.min("x").alias("x0"))
    w = Window.partitionBy(*keys).orderBy("p")  # one row per partition and key
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = first.select(
        "p", *keys, F.coalesce(F.sum("ta").over(upto), F.lit(0)).alias("ba"), F.coalesce(F.sum("tb").over(upto), F.lit(0)).alias("bb"),
        F.lead("x0").over(w).alias("next_x0"), F.sum("ta").over(whole).alias("alla"), F.sum("tb").over(whole).alias("allb"),
    )
    own = Window.partitionBy("p", *keys).orderBy("x")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    c = dealt.join(edges, ["p", *keys])
    fa = F.try_divide(F.col("ba") + F.sum("na").over(run), F.col("alla"))
    fb = F.try_divide(F.col("bb") + F.sum("nb").over(run), F.col("allb"))
    gap = F.coalesce(F.lead("x").over(own), F.col("next_x0")) - F.col("x")
    steps = c.select(*keys, F.abs(fa - fb).alias("d"), gap.alias("gap"))
    return steps.groupBy(*keys).agg(F.max("d").alias("ks_stat"), F.sum(F.col("d") * F.col("gap")).alias("wasserstein"))


def kolmogorov_p(stat: float, n_a: int, n_b: int) -> float:
    """Asymptotic two-sided p-value."""
    if stat is None or not n_a or not n_b:
        return float("nan")
    en = math.sqrt(n_a * n_b / (n_a + n_b))
    x = stat * en
    if x < 1e-3:
        return 1.0
    if x < 0.6:  # the other form of the series converges fast here
        t = -((math.pi / x) ** 2) / 8
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * sum(math.exp(t * (2 * k - 1) ** 2) for k in range(1, 20)))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def with_ks_p(table: DataFrame) -> DataFrame:
    """A drift table with its KS p-values; one row per column."""

    @F.pandas_udf("double")
    def p(stat: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kolmogorov_p(*x) for x in zip(stat, a, b, strict=True)])

    return table.withColumn("ks_p", p("ks_stat", "n_a", "n_b"))


def target_shift(a: DataFrame, b: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, corr_a, corr_b, delta) of each column with the target."""

    def of(df: DataFrame, name: str) -> DataFrame:
        items = [F.struct(F.lit(c).alias("column"), F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(name)) for c in columns if c != target]
        return df.agg(F.array(*items).alias("s")).select(F.inline("s"))

    return of(a, "corr_a").join(of(b, "corr_b"), "column").withColumn("delta", F.col("corr_b") - F.col("corr_a"))


def profile_alerts(stats: DataFrame, modes: DataFrame | None = None, corr: DataFrame | None = None) -> DataFrame:
    """(column, alert, value) by the fixed rules on column statistics and correlations."""
    s = stats.join(modes, "column", "left") if modes is not None else stats.withColumn("mode_pct", F.lit(None).cast("double"))
    rules = {
        "zero_variance": (F.col("std") == 0, F.col("std")),
        "missing": (F.col("missing_pct") > 30, F.col("missing_pct")),
        "zeros": (F.col("zeros_pct") > 50, F.col("zeros_pct")),
        "skewed": (F.abs("skew") > 2, F.col("skew")),
        "heavy_tails": (F.abs("kurt") > 7, F.col("kurt")),
        "dominant_value": (F.col("mode_pct") > 95, F.col("mode_pct")),
        "infinite": (F.col("inf_pct") > 0, F.col("inf_pct")),
    }
    items = F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(n).alias("alert"), v.cast("double").alias("value"))) for n, (on, v) in rules.items()])
    out = s.select("column", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("a")).select("column", "a.alert", "a.value")
    if corr is not None:
        high = corr.filter(F.abs("corr") > 0.95).select(F.concat_ws(" ~ ", "a", "b").alias("column"), F.lit("high_correlation").alias("alert"), F.col("corr").alias("value"))
        out = out.unionByName(high)
    return out


def compare_alerts(table: DataFrame, columns_a: list[str], columns_b: list[str]) -> DataFrame:
    """(column, alert, value): columns added or removed, drift by KS or mean shift."""
    spark = table.sparkSession
    sets = [(c, "column_added", None) for c in columns_b if c not in columns_a] + [(c, "column_removed", None) for c in columns_a if c not in columns_b]
    rules = F.array(
        F.when(F.col("ks_stat") > 0.2, F.struct(F.lit("distribution_drift").alias("alert"), F.col("ks_stat").alias("value"))),
        F.when(F.abs("mean_shift") > 1, F.struct(F.lit("mean_shift").alias("alert"), F.col("mean_shift").alias("value"))),
    )
    out = table.select("column", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("a")).select("column", "a.alert", "a.value")
    return out.unionByName(spark.createDataFrame(sets, "column string, alert string, value double"))


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """(bin, lo, hi, n) of equal widths over the finite range; the last bin is closed."""
    x = df.select(_finite(column).alias("x")).filter("x IS NOT NULL")
    edge = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    step = (F.col("b") - F.col("a")) / bins
    k = F.when(step > 0, F.least(F.floor((F.col("x") - F.col("a")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    return x.join(F.broadcast(edge)).groupBy(k.alias("bin"), "a", "b").agg(F.count("*").alias("n")).select("bin", (F.col("a") + F.col("bin") * step).alias("lo"), (F.col("a") + (F.col("bin") + 1) * step).alias("hi"), "n")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the lowest by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
