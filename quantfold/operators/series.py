"""Series in step and in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def align_series(left: DataFrame, right: DataFrame, on: str = "time") -> DataFrame:
    """Rows of both series at the times they share; raises ValueError if they share none.

    The joined rows are written once, so the check and the caller's job don't both run the join."""
    out = materialize(left.join(right, on, "inner"))
    if out.isEmpty():
        raise ValueError("the series do not overlap: no common time")
    return out


def series_frame(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ("time",)) -> DataFrame:
    """Long ``(*ids, series, y)`` rows of the named columns that exist, as a plot reads them."""
    keep = [c for c in cols if c in df.columns]
    if not keep:
        raise ValueError("none of the columns exists")
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in keep]).unpivot(list(ids), keep, "series", "y")
