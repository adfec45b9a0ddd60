"""Cleaning operators (A13-A20): fills, interpolation, log, winsorising, slicing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import clip, safe_ln
from . import ordered
from .quality import numeric_columns
from .quantiles import quantile_wide

FILL_METHODS = ("mean", "median", "backfill", "forwardfill", "linear_interpolation",
                "time_interpolation", "nearest_interpolation")


def fill_null(df: DataFrame, cols: Sequence[str], method: str = "mean", time: str = "time",
              by: Sequence[str] = (), buckets: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs in ``cols``.

    ``mean`` / ``median``: numeric columns only, other columns untouched.
    ``forwardfill`` / ``backfill``: last / next non-NULL value in time order.
    ``linear_interpolation``: by row position; ``time_interpolation``: by
    timestamp; both leave leading NULLs and repeat the last value at the end.
    ``nearest_interpolation``: nearest neighbour in time (ties to the earlier
    point), NULL at both ends.  Unknown columns are ignored; if none is valid
    a ValueError is raised.  Ordered methods run per ``by`` group without a
    single-partition window (see :mod:`ordered`); ``tie`` columns give the
    order of rows with equal times (their file order, say).
    """
    todo = [c for c in cols if c in df.columns]
    if not todo:
        raise ValueError("No valid columns found in the provided list")
    if method not in FILL_METHODS:
        raise ValueError(f"Unknown method: {method}. Must be one of {', '.join(FILL_METHODS)}")
    if method in ("mean", "median"):
        num = numeric_columns(df, todo)
        if not num:
            return df
        if method == "mean":
            stats = df.agg(*[F.avg(c).alias(f"_f_{c}") for c in num])
        else:
            q = quantile_wide(df, num, [0.5], names=["m"])
            stats = q.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"_f_{c}") for c in num])
        out = df.crossJoin(F.broadcast(stats))
        for c in num:
            dtype = df.schema[c].dataType
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_f_{c}").cast(dtype)))
        return out.drop(*[f"_f_{c}" for c in num])

    by = list(by)
    original = df.columns
    b = ordered.bucketize(df, time, by, buckets)
    need_pos = method == "linear_interpolation"
    for c in todo:
        if method in ("forwardfill", "linear_interpolation", "time_interpolation", "nearest_interpolation"):
            b = ordered.carry(b, time, c, by, "forward", out_value=f"_pv_{c}", out_order=f"_pt_{c}",
                              position=need_pos, tie=tie)
            if need_pos:
                b = b.withColumnRenamed("_forward_p", f"_pp_{c}")
        if method in ("backfill", "linear_interpolation", "time_interpolation", "nearest_interpolation"):
            b = ordered.carry(b, time, c, by, "backward", out_value=f"_nv_{c}", out_order=f"_nt_{c}",
                              position=need_pos, tie=tie)
            if need_pos:
                b = b.withColumnRenamed("_backward_p", f"_np_{c}")
        x = F.col(c)
        pv, nv, pt, nt = F.col(f"_pv_{c}") if method != "backfill" else None, \
            F.col(f"_nv_{c}") if method != "forwardfill" else None, \
            F.col(f"_pt_{c}") if method != "backfill" else None, \
            F.col(f"_nt_{c}") if method != "forwardfill" else None
        if method == "forwardfill":
            filled = pv
        elif method == "backfill":
            filled = nv
        elif method == "linear_interpolation":
            pos = F.col("_pos").cast("double")
            filled = F.when(nv.isNull(), pv).otherwise(
                ordered.interp(pos, F.col(f"_pp_{c}").cast("double"), pv, F.col(f"_np_{c}").cast("double"), nv))
        elif method == "time_interpolation":
            t, t0, t1 = (F.unix_micros(e.cast("timestamp")).cast("double") for e in (F.col(time), pt, nt))
            filled = F.when(nv.isNull(), pv).otherwise(ordered.interp(t, t0, pv, t1, nv))
        else:
            t, t0, t1 = (F.unix_micros(e.cast("timestamp")) for e in (F.col(time), pt, nt))
            filled = F.when(pv.isNull() | nv.isNull(), F.lit(None)).when((t - t0) <= (t1 - t), pv).otherwise(nv)
        b = b.withColumn(c, F.coalesce(x, filled.cast(df.schema[c].dataType)))
        b = b.drop(*[f"_{k}_{c}" for k in ("pv", "nv", "pt", "nt", "pp", "np")])
    return b.select(*original)


def log_transform(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Natural log of numeric columns; x <= 0 gives NULL."""
    num = numeric_columns(df, cols)
    return df.select(*[safe_ln(c).alias(c) if c in num else F.col(c) for c in df.columns])


def winsorize(df: DataFrame, cols: Sequence[str], lower: float = 0.01, upper: float = 0.99,
              by: Sequence[str] = (), method: str = "radix") -> DataFrame:
    """Cap each column at its ``lower`` / ``upper`` quantiles; NULLs untouched."""
    cols, by = numeric_columns(df, cols), list(by)
    q = quantile_wide(df, cols, [lower, upper], by, method, names=["lo", "hi"])
    bounds = q.groupBy(*by).agg(*[
        F.max(F.when(F.col("column") == c, F.struct("lo", "hi"))).alias(f"_w_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(bounds)) if not by else df.join(bounds, on=by, how="left")
    for c in cols:
        out = out.withColumn(c, clip(c, F.col(f"_w_{c}.lo"), F.col(f"_w_{c}.hi")).cast(df.schema[c].dataType))
    return out.select(*df.columns)


def time_slice(df: DataFrame, start, end, time: str = "time") -> DataFrame:
    """Inclusive time range ``[start, end]`` (pushed down to the scan when possible)."""
    return df.where(F.col(time).between(F.lit(start), F.lit(end)))
