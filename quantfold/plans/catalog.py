"""Registry of the queries behind ``__spark_entry__`` and their SQL oracles.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with an
equivalent ANSI SQL string that DuckDB runs over the same parquet tables.
Conventions shared by both sides: every column aliased, integers as BIGINT,
doubles rounded to 6 decimals plus 0.0 (no negative zero), dates as DATE,
arrays and maps flattened to strings or rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import apply_required_conf


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...] = ()


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, ops: tuple[str, ...] = (), digits: dict[str, int] | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_required_conf(spark)
            return finalize(fn(spark, sf_dir), overrides=digits)
        run.__name__ = fn.__name__
        REGISTRY[name] = Query(name, run, sql, ops)
        return fn
    return deco


def finalize(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Normalise output types for comparison: doubles rounded, ints widened.

    ``overrides`` gives fewer decimals to large-magnitude columns whose last
    digit depends on summation order (the oracle rounds them the same way).
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), (overrides or {}).get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
