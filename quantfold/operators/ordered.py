"""Ordered operations without a single-partition window.

A window ordered by time with no (or a skewed) partition key puts all rows in
one task.  Here rows are first cut into contiguous, roughly equal-count
buckets of the order column (see :func:`bucketize`); a tiny per-bucket summary (one row per
bucket and key) carries values across bucket boundaries with a window over
that summary; the carried values are joined back and the remaining work is
a window *within* each bucket.  Memory per task is bounded by the bucket,
not by the key, and the result does not depend on the bucket count.

Used by forward/back fill, interpolation and position numbering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a number (microseconds for timestamps, days for dates)."""
    dtype = df.schema[order].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(order)).cast("bigint")
    return F.col(order)


def order_bounds(df: DataFrame, number: Column, n: int) -> list[float]:
    """At most ``n`` - 1 ascending numbers that cut the rows into parts of about equal count.

    One mergeable sketch aggregate; only the bounds reach the driver, and they are computed once, so later
    plans agree on them.  Outliers don't matter: the cuts follow counts, not the range."""
    if n < 2:
        return []
    probs = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(number.cast("double"), probs, max(10_000, 20 * n)).alias("b")).first()[0]
    return sorted(set(got or ()))


def assign_bucket(df: DataFrame, number: Column, bounds: Sequence[float], out: str = "_bk") -> DataFrame:
    """Add the number of bounds at or below ``number`` (a binary search per row); NULL goes last."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_number", outputCol="_cut", handleInvalid="keep")
    return cut.transform(df.withColumn("_number", number.cast("double"))).withColumn(out, F.col("_cut").cast("int")).drop("_number", "_cut")


def bucketize(df: DataFrame, order: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Add ``_bk``: contiguous buckets of the order column with about equal counts.

    Rows with equal order values share a bucket."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = order_number(df, order)
    return assign_bucket(df, t, order_bounds(df, t, n))


def carry(df: DataFrame, order: str, value: str, by: Sequence[str] = (), direction: str = "forward",
          buckets: int | None = None, out_value: str | None = None, out_order: str | None = None,
          position: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """For each row, the nearest non-NULL ``value`` at or before (forward) or at or
    after (backward) it within ``by``, together with that row's ``order`` value.

    Adds ``out_value`` / ``out_order`` (defaults ``_<direction>_v`` / ``_<direction>_t``).
    With ``position=True`` also numbers rows 0.. within ``by`` (``_pos``) and
    returns the position of the carried row (``_<direction>_p``), which row-position
    interpolation needs.  ``tie`` columns order rows of equal ``order``; without
    them ``order`` should be unique within ``by``.
    """
    by, seq = list(by), [order, *tie]
    fwd = direction == "forward"
    ov = out_value or f"_{direction}_v"
    ot = out_order or f"_{direction}_t"
    op = f"_{direction}_p"
    b = df if "_bk" in df.columns else bucketize(df, order, by, buckets)
    inner = Window.partitionBy("_bk", *by).orderBy(*seq)
    # Backward = forward over descending order: a running frame is linear,
    # an UNBOUNDED FOLLOWING frame is re-aggregated for every row.
    frame = (inner if fwd else Window.partitionBy("_bk", *by).orderBy(*[F.col(c).desc() for c in seq])) \
        .rowsBetween(Window.unboundedPreceding, 0)
    pick = F.last
    marker = F.struct(F.col(order).alias("t"), F.col(value).alias("v"),
                      *( [F.col("_lpos").alias("p")] if position else []))
    marked = F.when(F.col(value).isNotNull(), marker)

    if position:
        b = b.withColumn("_lpos", F.row_number().over(inner) - 1)

    # Per-bucket summary: last (first) non-NULL row, and row count for positions.
    at = F.when(F.col(value).isNotNull(), F.struct(*seq))
    summ_aggs = [(F.max_by(marked, at) if fwd else F.min_by(marked, at)).alias("_edge")]
    if position:
        summ_aggs.append(F.count(F.lit(1)).alias("_cnt"))
    summ = b.groupBy("_bk", *by).agg(*summ_aggs)
    sw = Window.partitionBy(*by).orderBy("_bk")
    sframe = (sw if fwd else Window.partitionBy(*by).orderBy(F.col("_bk").desc())) \
        .rowsBetween(Window.unboundedPreceding, -1)
    if position:
        summ = summ.withColumn(
            "_off", F.coalesce(F.sum("_cnt").over(sw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        summ = summ.withColumn("_edge", F.when(F.col("_edge").isNotNull(), F.struct(
            F.col("_edge.t").alias("t"), F.col("_edge.v").alias("v"),
            (F.col("_edge.p") + F.col("_off")).alias("p"))))
    summ = summ.withColumn("_carry", pick("_edge", ignorenulls=True).over(sframe))
    keep = ["_bk", *by, "_carry"] + (["_off"] if position else [])
    joined = b.join(summ.select(*keep), on=["_bk", *by], how="left")
    local = pick(marked, ignorenulls=True).over(frame)
    best = F.coalesce(local, F.col("_carry"))
    if position:
        best = F.coalesce(
            F.when(local.isNotNull(), F.struct(local["t"].alias("t"), local["v"].alias("v"),
                                                (local["p"] + F.col("_off")).alias("p"))),
            F.col("_carry"))
        joined = joined.withColumn("_pos", F.col("_lpos") + F.col("_off"))
    res = joined.withColumn("_best", best).withColumn(ov, F.col("_best.v")).withColumn(ot, F.col("_best.t"))
    if position:
        res = res.withColumn(op, F.col("_best.p"))
    return res.drop("_best", "_carry", "_edge", "_lpos", "_off")


def with_position(df: DataFrame, order: str, by: Sequence[str] = (), buckets: int | None = None,
                  out: str = "_pos", tie: Sequence[str] = ()) -> DataFrame:
    """Row number (0-based) within ``by`` in ``order`` without a global window."""
    by = list(by)
    b = df if "_bk" in df.columns else bucketize(df, order, by, buckets)
    inner = Window.partitionBy("_bk", *by).orderBy(order, *tie)
    b = b.withColumn("_lpos", F.row_number().over(inner) - 1)
    cnt = b.groupBy("_bk", *by).agg(F.count(F.lit(1)).alias("_cnt"))
    sw = Window.partitionBy(*by).orderBy("_bk")
    cnt = cnt.withColumn("_off", F.coalesce(F.sum("_cnt").over(sw.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0)))
    return (b.join(cnt.select("_bk", *by, "_off"), on=["_bk", *by], how="left")
            .withColumn(out, F.col("_lpos") + F.col("_off")).drop("_lpos", "_off"))


def interp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
