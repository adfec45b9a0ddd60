"""As-of join.

``direction="backward"``: last right key <= left key; ``"forward"``: first
right key >= left key.  Both inclusive at equality, optional tolerance,
optional exact-match ``by`` columns.

Plan: the match depends only on the key values, so it is computed once per
*distinct* (by, left key) instead of per left row.  Distinct left and right
keys are unioned, tagged, ordered by (key, tag) and the nearest right key is
carried to every left key with the bucketed carry of :mod:`ordered` (no
single-partition window even without ``by``).  The small key -> match map is
equi-joined back to the left rows, then the right rows are equi-joined on
the matched key.  No range join, no pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import ordered


def asof_map(left_keys: DataFrame, right_keys: DataFrame, key: str = "k",
             direction: str = "backward", by: Sequence[str] = (),
             buckets: int | None = None) -> DataFrame:
    """Distinct (by, k) of the left side -> matched right key ``_match``."""
    by = list(by)
    lk = left_keys.select(*by, F.col(key).alias("_k")).distinct()
    rk = right_keys.select(*by, F.col(key).alias("_k")).distinct()
    num = lambda df: ordered.order_number(df, "_k").cast("bigint")
    # Tie order at equal keys: backward wants right before left, forward left before right.
    r_first = direction == "backward"
    lk = lk.withColumn("_ord", num(lk) * 2 + (1 if r_first else 0)).withColumn("_rk", F.lit(None).cast(rk.schema["_k"].dataType))
    rk = rk.withColumn("_ord", num(rk) * 2 + (0 if r_first else 1)).withColumn("_rk", F.col("_k"))
    # Distinct keys only; written once, so the left side's plan runs once here.
    u = materialize(lk.withColumn("_left", F.lit(True)).unionByName(rk.withColumn("_left", F.lit(False))))
    carried = ordered.carry(u, "_ord", "_rk", by, "forward" if r_first else "backward",
                            buckets=buckets, out_value="_match", out_order="_match_ord")
    # One row per distinct left key: materialised once, then joined back.
    return materialize(carried.where("_left").select(*by, F.col("_k").alias(key), "_match"))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
              direction: str = "backward", by: Sequence[str] = (), tolerance=None,
              match_col: str | None = None, buckets: int | None = None) -> DataFrame:
    """merge_asof semantics: every left row, plus the matched right row's columns.

    Of right rows with equal (by, right_on) the one with the largest other columns, compared
    in their order, is taken, so left rows never multiply; ``match_col`` names the
    matched right key (default: ``right_on``).  ``tolerance`` is a number (same
    unit as the key) or a ``datetime.timedelta`` for timestamp keys.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    by = list(by)
    mcol = match_col or right_on
    m = asof_map(left.select(*by, F.col(left_on).alias("k")),
                 right.select(*by, F.col(right_on).alias("k")), "k", direction, by, buckets)
    if tolerance is not None:
        gap = F.abs(ordered.order_number(m, "k") - ordered.order_number(m, "_match"))
        tol = tolerance
        if hasattr(tolerance, "total_seconds"):
            dtype = m.schema["k"].dataType.typeName()
            tol = tolerance.total_seconds() * (1_000_000 if "timestamp" in dtype else 1 / 86400)
        m = m.withColumn("_match", F.when(gap <= F.lit(tol), F.col("_match")))
    out = left.join(m.withColumnRenamed("k", "_lk"),
                    on=[*[left[b] == m[b] for b in by], left[left_on] == F.col("_lk")], how="left")
    out = out.drop(*[m[b] for b in by]).drop("_lk")
    rest = [c for c in right.columns if c not in by and c != right_on]
    if not rest:
        return out.withColumnRenamed("_match", mcol)
    r = right.groupBy(*[F.col(b).alias(f"_rb_{b}") for b in by], F.col(right_on).alias("_rmatch")).agg(
        F.max(F.struct(*rest)).alias("_row")).select(*[f"_rb_{b}" for b in by], "_rmatch", "_row.*")
    cond = [F.col(f"_rb_{b}") == out[b] for b in by] + [F.col("_rmatch") == F.col("_match")]
    return (out.join(r, on=cond, how="left").drop(*[f"_rb_{b}" for b in by], "_rmatch")
            .withColumnRenamed("_match", mcol))
