"""Sources and sinks.

Readers take explicit schemas where the reference inferred them, normalise
NaN to NULL once at ingest, and return plain DataFrames.  Stage tables are
written as Parquet into the shared folder named by ``spark.checkpoint.dir``
(never a machine-local temporary folder).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.articles import read_articles  # noqa: F401  (C01)
from ..session import stage_path


def _nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def read_timeseries(spark: SparkSession, path: str, time_col: str, fmt: str = "csv",
                    schema: T.StructType | str | None = None) -> DataFrame:
    """CSV / JSON series: rename ``time_col`` to ``time`` and parse it as a timestamp."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    df = df.withColumnRenamed(time_col, "time").withColumn("time", F.to_timestamp("time"))
    return _nan_to_null(df)


def read_panel(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
    df = reader.option("header", True).csv(path)
    if "datadate" in df.columns:
        df = df.withColumn("datadate", F.to_date("datadate"))
    return _nan_to_null(df)


def read_rates(spark: SparkSession, sources: dict[str, str], date_col: str = "TIME_PERIOD",
               value_col: str = "OBS_VALUE") -> DataFrame:
    """One CSV per currency -> long ``(date, ccy, value)``; bad values become NULL."""
    frames = []
    for code, path in sources.items():
        raw = spark.read.option("header", True).csv(path).select(date_col, value_col)
        frames.append(raw.select(F.to_date(date_col).alias("date"), F.lit(code).alias("ccy"),
                                 F.expr(f"try_cast(`{value_col}` AS DOUBLE)").alias("value")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def combine_series(frames: Sequence[DataFrame], on: str = "time", how: str = "outer") -> DataFrame:
    """Several series side by side on the time column (each frame keyed uniquely by ``on``; other column names differ).

    Any number of frames meets in one shuffle: rows of all of them are grouped by time (``outer``: times of any frame,
    ``inner``: of every frame).  Rows without a time match none, as in a join."""
    frames = list(frames)
    names = [c for f in frames for c in f.columns if c != on]
    if len(set(names)) < len(names):
        raise ValueError("the series share column names")
    if how not in ("outer", "inner"):
        raise ValueError(f"how must be outer or inner, not {how!r}")
    marked = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    rows = marked[0]
    for f in marked[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    cols = [F.col(f"`{c}`") for c in names]
    together = rows.where(F.col(on).isNotNull()).groupBy(on).agg(*[F.first(c, ignorenulls=True).alias(n) for c, n in zip(cols, names)], F.count_distinct("_frame").alias("_frames"))
    if how == "inner":
        return together.where(F.col("_frames") == len(frames)).drop("_frames")
    return together.drop("_frames").unionByName(rows.where(F.col(on).isNull()).select(on, *cols))


def _commits(spark: SparkSession, target: str) -> DataFrame | None:
    """The commit records of a stage, newest first, or None."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("version long, folder string").json(f"{target}/commits").orderBy(F.desc("version"), F.desc("folder"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_stage(df: DataFrame, name: str, partition_by: Sequence[str] = (), path: str | None = None) -> str:
    """Write an inter-stage table as Parquet (the reference pickled its caches).

    Every write goes to a folder of its own and counts once its commit record is there, so a failed rewrite leaves
    the table as it was, and a job that reads it meanwhile keeps its files.  Earlier versions stay on disk."""
    spark, target = df.sparkSession, path or stage_path(df.sparkSession, name)
    folder = f"data-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{target}/{folder}")
    before = _commits(spark, target)
    last = before.first() if before is not None else None
    record = spark.createDataFrame([((last["version"] if last else 0) + 1, folder)], "version long, folder string")
    record.coalesce(1).write.mode("append").json(f"{target}/commits")
    return target


def read_stage(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """The last committed version of a stage."""
    target = path or stage_path(spark, name)
    found = _commits(spark, target)
    last = found.first() if found is not None else None
    if last is None:
        raise FileNotFoundError(f"no stage has been committed at {target}")
    return spark.read.parquet(f"{target}/{last['folder']}")
