"""Exact quantiles with linear interpolation (pandas / ``quantile_cont`` rule).

Three physical strategies, same answer:

``method="radix"``  (default) selection by counted 16-bit cells (:mod:`radix`): up to four scans, each with
    one combined aggregate; no value is sorted, stored or held.

``method="percentile"``  Spark's ``percentile`` aggregate per group.  Its
    state keeps one counter per distinct value of the group, so it is only
    right when every group is bounded (a fold x feature, a window frame).

``method="sorted"``  a distributed order statistic that never
    holds a group in one task: count the distinct values, range-partition and
    sort them by (group, value), number the rows by partition offset and running
    count, find each group's start rank and size with two small aggregates, then
    pick the two neighbouring ranks of every requested probability.  A group holding
    a third of all rows is spread over many range partitions, and a value that
    many rows share is one row.

Output is long: ``(*by, column, p, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import radix

#: (group, probability, rank) rows up to which the last join broadcasts them (under 100 bytes each).
BROADCAST_PICKS = 500_000
_POS_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row position


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    if len(cols) == 1:
        return df.select(*by, F.lit(cols[0]).alias("column"), F.col(cols[0]).cast("double").alias("x"))
    return (df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(list(by), list(cols), "column", "x"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              method: str = "radix", partitions: int | None = None) -> DataFrame:
    cols, by = list(cols), list(by)
    return quantiles_of(_long(df, cols, by), by + ["column"], probs, method, partitions)


def quantiles_of(long: DataFrame, keys: Sequence[str], probs: Sequence[float], method: str = "radix",
                 partitions: int | None = None, value: str = "x") -> DataFrame:
    """Quantiles of ``value`` per ``keys`` on an already long frame -> (*keys, p, value)."""
    keys, probs = list(keys), [float(p) for p in probs]
    if value != "x":
        long = long.withColumnRenamed(value, "x")
    long = long.select(*keys, F.col("x").cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x"))
    if method == "percentile":
        agg = long.groupBy(*keys).agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("_q"))
        return (agg.select(*keys, F.posexplode("_q").alias("_i", "value"))
                .withColumn("p", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1))
                .select(*keys, "p", "value"))
    if method == "approx":
        agg = long.groupBy(*keys).agg(
            F.percentile_approx("x", F.array(*[F.lit(p) for p in probs]), 10000).alias("_q"))
        return (agg.select(*keys, F.posexplode("_q").alias("_i", "value"))
                .withColumn("p", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1))
                .select(*keys, "p", "value"))
    if method == "radix":
        return radix.interpolated(radix.select(long, keys, lambda n: radix.quantile_ranks(probs, n)), keys)
    if method != "sorted":
        raise ValueError(f"unknown quantile method {method!r}")

    spark = long.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Distinct values with their counts: a value that most rows share is one row after the map side.
    # The range partitioner samples its bounds afresh on every evaluation, so
    # the sorted, numbered frame is checkpointed once (reliable checkpoint in
    # spark.checkpoint.dir) and every later branch reads the same numbering.
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    counted = (long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_c"))
               .repartitionByRange(n_parts, *keys, "x").sortWithinPartitions(*keys, "x")
               .withColumn("_id", F.monotonically_increasing_id())
               .checkpoint(eager=True)
               .withColumn("_pid", F.shiftrightunsigned("_id", _POS_BITS)))
    # One row per partition: exclusive prefix sums give each partition's first rank.
    part = counted.groupBy("_pid").agg(F.sum("_c").alias("_cnt"))
    off = F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = F.sum("_c").over(Window.partitionBy("_pid").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    ranked = (counted.withColumn("_run", run).join(F.broadcast(part.select("_pid", off.alias("_off"))), "_pid")
              .select(*keys, "x", (F.col("_off") + F.col("_run") - F.col("_c")).alias("_g"), "_c"))
    groups = ranked.groupBy(*keys).agg(F.min("_g").alias("_start"), F.sum("_c").alias("_n"))
    pr = F.explode(F.array(*[F.lit(p) for p in probs])).alias("p")
    need = (groups.select(*keys, "_start", "_n", pr)
            .withColumn("_h", F.col("p") * (F.col("_n") - 1))
            .withColumn("_lo", F.floor("_h").cast("bigint"))
            .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1)))
    picks = need.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "p", "_h", "_lo",
                        F.explode(F.array_distinct(F.array(F.col("_start") + F.col("_lo"), F.col("_start") + F.col("_hi")))).alias("_at"))
    picks = materialize(picks)
    # Two rows per group and probability: broadcast behind a check of their number.
    picks = F.broadcast(picks) if picks.count() <= BROADCAST_PICKS else picks
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    vals = ranked.join(picks, [*same, F.col("_at") >= F.col("_g"), F.col("_at") < F.col("_g") + F.col("_c")]).drop(*[f"_k_{k}" for k in keys])
    out = (vals.groupBy(*keys, "p", "_h", "_lo")
           .agg(F.min("x").alias("_vlo"), F.max("x").alias("_vhi")))
    value = F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))
    return out.select(*keys, "p", value.alias("value"))


def quantile_wide(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                  method: str = "radix", names: Sequence[str] | None = None) -> DataFrame:
    """One row per (*by, column) with a column per probability (``q_<p>`` or ``names``)."""
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q_{str(p).replace('.', '_')}" for p in probs]
    q = quantiles(df, cols, probs, by, method)
    aggs = [F.max(F.when(F.col("p") == F.lit(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return q.groupBy(*by, "column").agg(*aggs)


def quantile_wide_of(long: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str],
                     method: str = "radix", value: str = "x") -> DataFrame:
    """Like :func:`quantile_wide` on a long frame: one row per ``keys``."""
    probs = [float(p) for p in probs]
    q = quantiles_of(long, keys, probs, method, value=value)
    aggs = [F.max(F.when(F.col("p") == F.lit(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return q.groupBy(*keys).agg(*aggs)
