"""Rate series in long form ``(date, series, value)``: complete cases, log
returns, horizon sums and cross-sectional rank labels (C07-C11, C26, C28).

Series stay long; every step is a window partitioned by the series (one row
per date per series, so a partition is bounded by the calendar) or by the
date (bounded by the number of series).  Wide frames are produced only at
the edge by :func:`to_wide`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import safe_ln


def complete_cases(long: DataFrame, date: str = "date", key: str = "ccy",
                   values: Sequence[str] = ("value",), n_series: int | None = None) -> DataFrame:
    """Keep only dates on which every series has non-NULL ``values``.

    The long-form equivalent of an outer join of all series on the date
    followed by dropping rows with a missing value.  Rows are unique per
    (date, series).  With ``n_series`` given the test is a window count per
    date (partition = one date, bounded by the number of series); otherwise
    the expected count is the number of distinct series (a one-row
    aggregate, broadcast).
    """
    ok = F.lit(True)
    for v in values:
        ok = ok & F.col(v).isNotNull()
    counted = long.withColumn("_n_ok", F.count(F.when(ok, F.lit(1))).over(Window.partitionBy(date)))
    if n_series is not None:
        return counted.where(F.col("_n_ok") == F.lit(n_series)).drop("_n_ok")
    total = long.agg(F.countDistinct(key).alias("_total"))
    return (counted.crossJoin(F.broadcast(total)).where(F.col("_n_ok") == F.col("_total"))
            .drop("_n_ok", "_total"))


def log_returns(long: DataFrame, date: str = "date", key: str = "ccy", value: str = "value",
                out: str = "ret", complete: bool = True, n_series: int | None = None) -> DataFrame:
    """``ln(v_t / v_{t-1})`` per series over consecutive (complete-case) dates.

    With ``complete=True`` the input is first restricted to complete-case
    dates (as the reference drops incomplete dates before shifting) and dates
    whose return is missing for any series are dropped afterwards.
    """
    src = complete_cases(long, date, key, (value,), n_series) if complete else long
    w = Window.partitionBy(key).orderBy(date)
    prev = F.lag(value).over(w)
    res = src.withColumn(out, safe_ln(F.try_divide(F.col(value), prev)))
    res = res.where(F.col(out).isNotNull()) if not complete else complete_cases(res, date, key, (out,), n_series)
    return res


def horizon_sums(long: DataFrame, date: str = "date", key: str = "ccy", ret: str = "ret",
                 n: int = 5, future: str = "future", past: str = "past",
                 n_series: int | None = None) -> DataFrame:
    """Sum of the next ``n`` returns (t+1..t+n) and the previous ``n`` (t-n..t-1).

    Only full windows count; dates where either side is missing for any
    series are dropped (inner join of the two horizons on the date).
    """
    w = Window.partitionBy(key).orderBy(date)
    fw, pw = w.rowsBetween(1, n), w.rowsBetween(-n, -1)
    res = (long
           .withColumn(future, F.when(F.count(ret).over(fw) == n, F.sum(ret).over(fw)))
           .withColumn(past, F.when(F.count(ret).over(pw) == n, F.sum(ret).over(pw))))
    return complete_cases(res, date, key, (future, past), n_series)


def rank_label(value: str, date: str, order_col: str, top: int = 3, bottom_from: int = 7):
    """Label by descending rank within the date: positions < top appreciate,
    positions >= bottom_from depreciate, the rest are unchanged (ties keep the
    fixed series order)."""
    w = Window.partitionBy(date).orderBy(F.col(value).desc(), F.col(order_col).asc())
    pos = F.row_number().over(w) - 1
    lab = (F.when(pos < top, F.lit("appreciation"))
           .when(pos >= bottom_from, F.lit("depreciation"))
           .otherwise(F.lit("unchanged")))
    return F.when(F.col(value).isNotNull(), lab)


def rank_labels(long: DataFrame, date: str = "date", key: str = "ccy", order_col: str = "ccy_ord",
                columns: Sequence[str] = ("future", "past"), top: int = 3,
                bottom_from: int = 7) -> DataFrame:
    """Cross-sectional labels per date for each horizon column (``<col>_label``).

    NULL values are not ranked (the reference skips missing returns), so
    with fewer valid series the bottom bucket shrinks.
    """
    # Descending order puts NULLs last, so they never shift a valid position;
    # all horizons share one exchange on the date.
    res = long
    for c in columns:
        res = res.withColumn(f"{c}_label", rank_label(c, date, order_col, top, bottom_from))
    return res


def series_order(codes: Sequence[str], key: str = "ccy", out: str = "ccy_ord"):
    """Column giving each code's position in ``codes`` (tie-break order)."""
    return F.array_position(F.array(*[F.lit(c) for c in codes]), F.col(key)).cast("int").alias(out)


def to_wide(long: DataFrame, date: str, key: str, value: str, codes: Sequence[str],
            suffix: str = "") -> DataFrame:
    """Pivot at the edge with an explicit value list (no extra distinct job)."""
    return (long.groupBy(date).pivot(key, list(codes)).agg(F.first(value))
            .select(date, *[F.col(c).alias(f"{c}{suffix}") for c in codes]))


def from_wide(wide: DataFrame, date: str, codes: Sequence[str], key: str = "ccy",
              value: str = "value") -> DataFrame:
    """Unpivot a date-indexed matrix (one column per code) to long form."""
    return wide.unpivot([date], list(codes), key, value)


def label_table(long_rates: DataFrame, date: str = "date", key: str = "ccy", value: str = "value",
                codes: Sequence[str] | None = None, n: int = 5, top: int = 3,
                bottom_from: int = 7) -> DataFrame:
    """Rates -> (date, ccy, ret, future, past, future_label, past_label).

    The whole labelling chain of the reference: complete cases, log returns,
    horizon sums, ranking.  ``codes`` fixes the tie order (default: sorted).
    """
    if codes is None:
        order = F.dense_rank().over(Window.orderBy(key))  # small: one row per series
        ordered = long_rates.join(
            long_rates.select(key).distinct().withColumn("ccy_ord", order), on=key)
    else:
        ordered = long_rates.withColumn("ccy_ord", series_order(codes, key))
    k = len(codes) if codes is not None else None
    rets = log_returns(ordered, date, key, value, n_series=k)
    sums = horizon_sums(rets, date, key, "ret", n, n_series=k)
    return rank_labels(sums, date, key, "ccy_ord", ("future", "past"), top, bottom_from)
