"""Data-quality operators.

Statistics are computed in one aggregate pass and attached back with a
broadcast of a one-row (or one-row-per-group) frame; no per-column jobs and
no driver loops over data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import quantile_wide


def columns(df: DataFrame) -> list[str]:
    return list(df.columns)


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Numeric columns among ``cols`` (all columns when None); booleans excluded."""
    names = list(cols) if cols is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in names if c in types and isinstance(types[c], T.NumericType)]


def require_columns(df: DataFrame, cols: Sequence[str], numeric: bool = False) -> None:
    """Raise if a column is missing (or not numeric when ``numeric``). Schema only, no job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    if numeric:
        bad = [c for c in cols if c not in numeric_columns(df, cols)]
        if bad:
            raise TypeError(f"columns are not numeric: {bad}")


def count_null(df: DataFrame, cols: str | Sequence[str] | None = None) -> DataFrame:
    """Null counts as tidy rows ``(column, null_count)``; one scan for all columns."""
    cols = [cols] if isinstance(cols, str) else list(cols or df.columns)
    require_columns(df, cols)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_count").withColumn(
        "null_count", F.col("null_count").cast("bigint"))


def assert_no_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> None:
    """Raise ValueError if any of ``cols`` contains NULL (one aggregate job)."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    bad = {c: row[c] for c in cols if row[c]}
    if bad:
        raise ValueError(f"Null values present: {bad}")


def null_matrix(df: DataFrame, time: str = "time", bucket: str = "day",
                cols: Sequence[str] | None = None) -> DataFrame:
    """Share of NULLs per time bucket and column: the data behind a null heatmap."""
    cols = [c for c in (cols or df.columns) if c != time]
    agg = df.groupBy(F.date_trunc(bucket, time).alias("bucket")).agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return agg.unpivot(["bucket"], cols, "column", "null_share")


def outliers_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5, by: Sequence[str] = (),
                 suffix: str = "__outlier", method: str = "radix") -> DataFrame:
    """Flag ``x < Q1 - k*IQR or x > Q3 + k*IQR`` per numeric column; NULL is not an outlier."""
    cols, by = numeric_columns(df, cols), list(by)
    if not cols:
        return df
    q = quantile_wide(df, cols, [0.25, 0.75], by, method, names=["q1", "q3"])
    bounds = q.groupBy(*by).agg(*[
        F.max(F.when(F.col("column") == c, F.struct("q1", "q3"))).alias(f"_b_{c}") for c in cols])
    out = _attach(df, bounds, by)
    for c in cols:
        q1, q3 = F.col(f"_b_{c}.q1"), F.col(f"_b_{c}.q3")
        iqr = q3 - q1
        flag = (F.col(c) < q1 - k * iqr) | (F.col(c) > q3 + k * iqr)
        out = out.withColumn(f"{c}{suffix}", F.coalesce(flag, F.lit(False)))
    return out.drop(*[f"_b_{c}" for c in cols])


def outliers_zscore(df: DataFrame, cols: Sequence[str], z: float = 3.0, by: Sequence[str] = (),
                    suffix: str = "__outlier") -> DataFrame:
    """Flag values outside ``[mean - z*std, mean + z*std]``; NULL counts as an outlier."""
    cols, by = numeric_columns(df, cols), list(by)
    if not cols:
        return df
    stats = df.groupBy(*by).agg(*[
        F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"_z_{c}") for c in cols])
    out = _attach(df, stats, by)
    for c in cols:
        m, s = F.col(f"_z_{c}.m"), F.col(f"_z_{c}.s")
        inside = F.col(c).between(m - z * s, m + z * s)
        out = out.withColumn(f"{c}{suffix}", ~F.coalesce(inside, F.lit(False)))
    return out.drop(*[f"_z_{c}" for c in cols])


def filter_outliers(df: DataFrame, flag_cols: Sequence[str] | None = None, drop_flags: bool = True,
                    suffix: str = "__outlier") -> DataFrame:
    """Drop rows where any flag is true."""
    flags = list(flag_cols or [c for c in df.columns if c.endswith(suffix)])
    if not flags:
        return df
    any_flag = F.greatest(*[F.col(c).cast("int") for c in flags]) if len(flags) > 1 else F.col(flags[0]).cast("int")
    out = df.where(F.coalesce(any_flag, F.lit(0)) == 0)
    return out.drop(*flags) if drop_flags else out


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])


def drop_null_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keep columns whose NULL share is <= threshold.

    The output schema depends on the data, so this one-row aggregate is the
    only place an operator reads a result on the driver.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("Threshold must be between 0 and 1")
    row = null_shares(df).first()
    if row is None:
        return df
    keep = [c for c in df.columns if row[c] is None or row[c] <= threshold]
    return df.select(*keep)


def _attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach per-group statistics: broadcast when there is one row (no ``by``)."""
    if not by:
        return df.crossJoin(F.broadcast(stats))
    return df.join(stats, on=list(by), how="left")
