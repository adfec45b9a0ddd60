"""Deterministic, portable row hash.

Random operations (K-fold, bootstrap, sampling, splits, synthetic
predictions) are made reproducible by ranking on a hash instead of a driver
RNG.  The hash is the first 60 bits of the MD5 of ``'|'``-joined key values,
which any SQL engine with ``md5`` can recompute - so the oracle can check
these operators too.  It is reproducible, not NumPy-identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    cols = [F.lit(p) if isinstance(p, (int, float)) and not isinstance(p, bool)
            else (F.col(p) if isinstance(p, str) else p) for p in parts]
    s = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def hash_sql(*parts: str) -> str:
    """The same hash as a DuckDB / ANSI SQL expression over SQL fragments."""
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {joined})), 1, 15) AS BIGINT)"

