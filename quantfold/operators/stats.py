"""Column statistics.

Everything is long ``(*by, column, ...)`` and computed with aggregates that
combine partially (moments, min/max, counts) plus the exact distributed
quantiles of :mod:`quantiles`.  Skewness and kurtosis are the bias-corrected
sample versions (G1, G2), zero for a constant column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import dagostino_k2, sample_kurt, sample_skew
from .quality import assert_no_nulls, numeric_columns
from .quantiles import quantile_wide_of

SUMMARY_STATS = ("mean", "median", "std", "var", "min", "max", "range", "q1", "q3", "iqr",
                 "skew", "kurt", "sum", "count")


def to_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return (df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(list(by), list(cols), "column", "x"))


def _moments(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    x = F.col("x")
    n = F.count(x).cast("double")
    return long.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("var"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.count(x).alias("count"),
        sample_skew(n, F.skewness(x), F.min(x) == F.max(x)).alias("skew"),
        sample_kurt(n, F.kurtosis(x), F.min(x) == F.max(x)).alias("kurt"),
        F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))


def summary_stats(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
                  method: str = "radix") -> DataFrame:
    """The 14 summary statistics per numeric column (and group)."""
    cols, by = numeric_columns(df, cols), list(by)
    long = to_long(df, cols, by).where(F.col("x").isNotNull() & ~F.isnan("x"))
    keys = by + ["column"]
    mom = _moments(long, keys).drop("_g1", "_g2")
    q = quantile_wide_of(long, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"], method)
    out = mom.join(q, on=keys, how="left")
    return out.select(*keys, "mean", "median", "std", "var", "min", "max",
                      (F.col("max") - F.col("min")).alias("range"), "q1", "q3",
                      (F.col("q3") - F.col("q1")).alias("iqr"), "skew", "kurt", "sum", "count")


def date_range_of(df: DataFrame, time: str = "time", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(time).alias("start"), F.max(time).alias("end"))


def normality_test(df: DataFrame, start=None, end=None, time: str = "time",
                   cols: Sequence[str] | None = None, by: Sequence[str] = (),
                   check_nulls: bool = True) -> DataFrame:
    """Skew, kurtosis and the D'Agostino-Pearson K^2 test per numeric column.

    NULLs in the selected range are an error (as in the reference).
    """
    rng = df
    if start is not None and end is not None:
        rng = df.where(F.col(time).between(F.lit(start), F.lit(end)))
    cols = [c for c in numeric_columns(rng, cols) if c not in by]
    if check_nulls:
        assert_no_nulls(rng, cols)
    keys = list(by) + ["column"]
    mom = _moments(to_long(rng, cols, by), keys)
    res = dagostino_k2(mom, "count", "_g1", "_g2")
    return res.select(*keys, "skew", "kurt", "z_skew", "z_kurt", "normaltest_stat", "normaltest_p")


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30,
              by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bin counts over [min, max] (last bin closed); all bins listed."""
    cols, by = numeric_columns(df, cols), list(by)
    keys = by + ["column"]
    long = to_long(df, cols, by).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = long.groupBy(*keys).agg(F.min("x").alias("_mn"), F.max("x").alias("_mx"))
    rng = rng.select(*keys,
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"))
    b = F.least(F.width_bucket("x", "lo", "hi", F.lit(bins)), F.lit(bins))
    counts = (long.join(F.broadcast(rng) if not by else rng, on=keys)
              .groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(counts, on=keys + ["bin"], how="left")
            .select(*keys, F.col("bin").cast("bigint").alias("bin"),
                    (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * width).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
              whis: float = 1.5, method: str = "radix") -> DataFrame:
    """Box-plot data: quartiles, whisker ends (last datum within whis*IQR), flier count."""
    cols, by = numeric_columns(df, cols), list(by)
    keys = by + ["column"]
    long = to_long(df, cols, by).where(F.col("x").isNotNull() & ~F.isnan("x"))
    q = quantile_wide_of(long, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"], method)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - whis * iqr, F.col("q3") + whis * iqr
    j = long.join(F.broadcast(q) if not by else q, on=keys)
    x = F.col("x")
    return j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo_f, x)).alias("whislo"), F.max(F.when(x <= hi_f, x)).alias("whishi"),
        F.count_if((x < lo_f) | (x > hi_f)).cast("bigint").alias("n_fliers"),
        F.count(F.lit(1)).cast("bigint").alias("n"))


def box_fliers(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), whis: float = 1.5,
               keep: Sequence[str] = (), method: str = "radix") -> DataFrame:
    """The points that a box plot draws singly: ``(*by, *keep, column, x)`` of rows beyond ``whis`` * IQR.

    The quartiles of a group meet its rows; the points stream to the output (no list a group)."""
    cols, by = [c for c in numeric_columns(df, cols) if c not in keep], list(by)
    keys = by + ["column"]
    ids = [*by, *[c for c in keep if c not in by]]
    long = to_long(df, cols, ids).where(F.col("x").isNotNull() & ~F.isnan("x"))
    q = quantile_wide_of(long, keys, [0.25, 0.75], ["_q1", "_q3"], method)
    q = q.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_q1", "_q3")
    reach = F.lit(whis) * (F.col("_q3") - F.col("_q1"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    beyond = long.join(F.broadcast(q) if not by else q, same).where((F.col("x") < F.col("_q1") - reach) | (F.col("x") > F.col("_q3") + reach))
    return beyond.select(*ids, "column", "x")


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line y = slope*x + intercept; NULL with two rows or fewer."""
    n = F.regr_count(y, x)
    ok = n > 2
    return df.groupBy(*by).agg(
        F.when(ok, F.regr_slope(y, x)).alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"),
        F.when(ok, F.regr_r2(y, x)).alias("r2"), n.cast("bigint").alias("n"))


def counts_by_year(df: DataFrame, date: str = "datadate") -> DataFrame:
    return (df.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy("year"))
