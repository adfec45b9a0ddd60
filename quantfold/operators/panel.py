"""Firm-year panel: filters, derived features, per-share scaling, target and diffs
(B01-B11, B19, B20).

All ordered work uses one window spec ``W = partitionBy(key).orderBy(date)``;
the filter between the cash-flow step and the target keeps the partitioning,
so Spark reuses one exchange.  A firm's partition is bounded by the calendar
(one row per fiscal year), so per-key windows cannot grow with the data.
Order of steps follows the reference: filters -> CFO diff -> fill -> scale ->
drop incomplete rows -> lead target -> feature diffs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import finite_or_null, nonzero_or

# The reference's 30 base features, in its order.
BASE_FEATURES = [
    "ib", "sale", "cogs", "xsga", "dp", "xint", "nopi", "txt",
    "xad", "xrd", "spi", "xido", "dvc",
    "at", "act", "lct", "lt", "ceq", "che", "invt", "rect",
    "ppent", "iva", "intan", "ap", "dlc", "txp", "dltt", "re",
    "cfo",
]
REQUIRED = ["at", "sale", "ib", "csho"]
PER_SHARE = [f"{c}_per_share" for c in BASE_FEATURES]
DIFFS = [f"{c}_diff" for c in PER_SHARE]
X_COLS = PER_SHARE + DIFFS


def _w(key: str, date: str):
    return Window.partitionBy(key).orderBy(date)


def panel_filter(df: DataFrame, required: Sequence[str] = REQUIRED,
                 exchanges: Sequence[str] = ("N", "A", "Q"),
                 excluded_sic: Sequence[tuple[int, int]] = ((6000, 6999), (4900, 4999)),
                 min_price: float = 1.0) -> DataFrame:
    """Sample filters: required items present, common equity on NYSE/AMEX/NASDAQ,
    not financial / utility (NULL SIC is kept), price above ``min_price``."""
    out = df.na.drop(subset=list(required))
    out = out.where((F.col("SecurityType") == "EQTY") & (F.col("SecuritySubType") == "COM"))
    out = out.where(F.col("PrimaryExch").isin(*exchanges))
    for lo, hi in excluded_sic:
        out = out.where(~F.coalesce(F.col("sic").between(lo, hi), F.lit(False)))
    return out.where(F.col("MthPrc") > min_price)


def derive_iva(df: DataFrame) -> DataFrame:
    return df.withColumn("iva", F.coalesce("ivaeq", F.lit(0.0)) + F.coalesce("ivao", F.lit(0.0)))


def cash_flow(df: DataFrame, key: str = "gvkey", date: str = "datadate") -> DataFrame:
    """CFO: reported (oancf - xidoc) unless 0 / missing, else ib - accruals, where
    accruals = d(act - che) - d(lct - dlc - txp) - dp (changes within the firm, first year 0)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    w = _w(key, date)
    nca = z("act") - z("che")
    adj = z("lct") - z("dlc") - z("txp")
    d_nca = F.coalesce(nca - F.lag(nca).over(w), F.lit(0.0))
    d_adj = F.coalesce(adj - F.lag(adj).over(w), F.lit(0.0))
    cfo_bs = z("ib") - (d_nca - d_adj - z("dp"))
    reported = z("oancf") - z("xidoc")
    return df.withColumn("cfo", nonzero_or(reported, cfo_bs))


def per_share(df: DataFrame, cols: Sequence[str] = BASE_FEATURES, denom: str = "csho") -> DataFrame:
    """Fill base features with 0, divide by shares (x/0 -> NULL), non-finite -> NULL."""
    out = df.na.fill(0.0, subset=list(cols))
    return out.select("*", *[finite_or_null(F.try_divide(F.col(c), F.col(denom))).alias(f"{c}_per_share")
                             for c in cols])


def lead_target(df: DataFrame, key: str = "gvkey", date: str = "datadate",
                num: str = "ib", den: str = "csho", out: str = "y") -> DataFrame:
    """y = next year's num / next year's den within the firm (positional, surviving rows)."""
    w = _w(key, date)
    return df.withColumn(out, finite_or_null(F.try_divide(F.lead(num).over(w), F.lead(den).over(w))))


def group_diff(df: DataFrame, cols: Sequence[str], key: str = "gvkey", date: str = "datadate",
               suffix: str = "_diff", fill: float | None = 0.0) -> DataFrame:
    """x - previous x within the firm; the first row gets ``fill``."""
    w = _w(key, date)
    exprs = []
    for c in cols:
        d = F.col(c) - F.lag(c).over(w)
        exprs.append((F.coalesce(d, F.lit(fill)) if fill is not None else d).alias(f"{c}{suffix}"))
    return df.select("*", *exprs)


def model_frame(df: DataFrame, key: str = "gvkey", date: str = "datadate",
                dropna_subset: Sequence[str] | None = None) -> DataFrame:
    """The full feature pipeline: filters -> iva -> CFO -> per share -> drop incomplete
    rows -> target -> diffs -> (key, date, 60 features, y) with y present.

    ``dropna_subset=None`` drops rows with a NULL in *any* column present at
    that point, as the reference does (including raw inputs never filled);
    pass a subset to restrict it.
    """
    out = derive_iva(panel_filter(df))
    out = cash_flow(out, key, date)
    out = per_share(out)
    out = out.na.drop(subset=list(dropna_subset) if dropna_subset else None)
    out = lead_target(out, key, date)
    out = group_diff(out, PER_SHARE, key, date)
    return out.select(key, date, *X_COLS, "y").where(F.col("y").isNotNull())
