"""Numeric column expressions with the reference's NULL / NaN rules.

All functions return ``Column`` expressions so they stay inside whole-stage
codegen; none of them triggers a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c) -> Column:
    """NaN and +/-inf become NULL (pandas treats them as missing after ``replace``)."""
    c = col_(c)
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(c)


def safe_ln(c) -> Column:
    """Natural log defined as NULL for x <= 0 (NumPy gives -inf / NaN)."""
    c = col_(c)
    return F.when(c > 0, F.ln(c))


def safe_div(a, b) -> Column:
    """x / 0 -> NULL instead of an ANSI error or an infinity."""
    return F.try_divide(col_(a), col_(b))


def clip(c, lo, hi) -> Column:
    """Clip to [lo, hi]; NULL values and NULL bounds leave the value untouched."""
    c = col_(c)
    lo, hi = col_(lo) if not isinstance(lo, (int, float)) else F.lit(lo), \
        col_(hi) if not isinstance(hi, (int, float)) else F.lit(hi)
    out = F.when(lo.isNotNull() & (c < lo), lo).otherwise(c)
    return F.when(hi.isNotNull() & (out > hi), hi).otherwise(out)


def nonzero_or(a, b) -> Column:
    """Use ``a`` unless it is 0 or NULL, else ``b`` (``replace(0, nan).fillna(b)``)."""
    a = col_(a)
    return F.coalesce(F.when(a != 0, a), col_(b))


def sample_skew(n: Column, g1: Column, is_const: Column) -> Column:
    """Bias-corrected skewness G1 from the population g1; 0 for a constant sample."""
    corr = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(is_const, F.lit(0.0)).otherwise(corr)


def sample_kurt(n: Column, g2: Column, is_const: Column, const_value: float = 0.0) -> Column:
    """Bias-corrected excess kurtosis G2 from the population excess g2.

    ``const_value`` is what a constant sample yields: 0.0 for a column
    statistic, -3.0 for a rolling window (the reference's library differs
    between the two).
    """
    corr = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(is_const, F.lit(const_value)).otherwise(corr))


def skew_kurt_exprs(x, over=None, rolling: bool = False) -> tuple[Column, Column]:
    """(skew, kurt) of column ``x`` as aggregate expressions (or window exprs with ``over``)."""
    x = col_(x)

    def agg(e):
        return e.over(over) if over is not None else e

    n = agg(F.count(x)).cast("double")
    is_const = agg(F.min(x)) == agg(F.max(x))
    skew = sample_skew(n, agg(F.skewness(x)), is_const)
    kurt = sample_kurt(n, agg(F.kurtosis(x)), is_const, -3.0 if rolling else 0.0)
    return skew, kurt


def dagostino_k2(df, n: str, g1: str, g2: str, prefix: str = "_k"):
    """D'Agostino-Pearson omnibus test columns from n, population g1 and excess g2.

    Adds ``z_skew``, ``z_kurt``, ``normaltest_stat`` and ``normaltest_p``.
    Closed form (D'Agostino 1970; Anscombe & Glynn 1983); the chi-square
    tail with 2 degrees of freedom is exp(-k2/2).  NULL below 8 observations.
    Built in stages so each intermediate is computed once.
    """
    p = prefix
    N = F.col(n).cast("double")
    c = lambda name: F.col(f"{p}_{name}")
    s1 = df.select(
        "*",
        (F.col(g1) * F.sqrt((N + 1) * (N + 3) / (6.0 * (N - 2)))).alias(f"{p}_y0"),
        (3.0 * (N * N + 27 * N - 70) * (N + 1) * (N + 3)
         / ((N - 2) * (N + 5) * (N + 7) * (N + 9))).alias(f"{p}_beta2"),
        ((F.col(g2) + 3.0 - 3.0 * (N - 1) / (N + 1))
         / F.sqrt(24.0 * N * (N - 2) * (N - 3) / ((N + 1) * (N + 1) * (N + 3) * (N + 5)))).alias(f"{p}_x"),
        (6.0 * (N * N - 5 * N + 2) / ((N + 7) * (N + 9))
         * F.sqrt(6.0 * (N + 3) * (N + 5) / (N * (N - 2) * (N - 3)))).alias(f"{p}_b"))
    s2 = s1.select(
        "*",
        F.when(c("y0") == 0, F.lit(1.0)).otherwise(c("y0")).alias(f"{p}_y"),
        (-1.0 + F.sqrt(2.0 * (c("beta2") - 1))).alias(f"{p}_w2"),
        (6.0 + 8.0 / c("b") * (2.0 / c("b") + F.sqrt(1 + 4.0 / (c("b") * c("b"))))).alias(f"{p}_a"))
    s3 = s2.select(
        "*",
        (1.0 / F.sqrt(0.5 * F.ln(c("w2")))).alias(f"{p}_delta"),
        F.sqrt(2.0 / (c("w2") - 1)).alias(f"{p}_alpha"),
        (1 + c("x") * F.sqrt(2.0 / (c("a") - 4.0))).alias(f"{p}_d"))
    s4 = s3.select(
        "*",
        (c("delta") * F.asinh(c("y") / c("alpha"))).alias(f"{p}_zs"),
        ((1 - 2.0 / (9.0 * c("a"))
          - F.signum(c("d")) * F.pow(F.abs((1 - 2.0 / c("a")) / c("d")), F.lit(1.0 / 3.0)))
         / F.sqrt(2.0 / (9.0 * c("a")))).alias(f"{p}_zk"))
    small = N < 8
    null = F.lit(None).cast("double")
    k2 = c("zs") * c("zs") + c("zk") * c("zk")
    out = s4.select(
        "*",
        F.when(small, null).otherwise(c("zs")).alias("z_skew"),
        F.when(small, null).otherwise(c("zk")).alias("z_kurt"),
        F.when(small, null).otherwise(k2).alias("normaltest_stat"),
        F.when(small, null).otherwise(F.exp(-k2 / 2.0)).alias("normaltest_p"))
    return out.drop(*[f"{p}_{k}" for k in ("y0", "beta2", "x", "b", "y", "w2", "a", "delta", "alpha", "d",
                                           "zs", "zk")])
