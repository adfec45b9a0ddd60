"""Session helpers.

Operators never create sessions themselves; they take DataFrames.  These
helpers exist for tests, the bench and the driver contract.  Settings a
cluster already provides (checkpoint directory, shuffle partitions) are read
from the session and only filled in when unset.
"""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Settings every operator relies on: UTC wall clock (dates are compared
#: against the oracle as naive UTC) and ANSI arithmetic (division by zero is
#: handled explicitly with ``try_divide``).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "quantfold",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Pin the runtime settings operators depend on (safe on a shared session)."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory, setting a local one only in local mode.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; we never
    override it and raise when it is missing, because a machine-local folder
    would be unreadable from other nodes.  In ``local`` mode (tests, bench),
    where driver and executors are one process, a fresh scratch folder is set.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[[^\]]*\])?$", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="quantfold-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A location for a written stage table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stages/{name}"


@contextmanager
def without_constraints(spark: SparkSession):
    """Plan very wide frames without constraint inference, then restore the setting.

    With 60 derived features and a NOT NULL filter over every column, inference grows combinatorially;
    the filters it would infer are explicit in those plans.  Materialize inside."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df):
    """Cut lineage of a small intermediate (a key map, a per-date table) with a
    reliable checkpoint into ``spark.checkpoint.dir``; later plans read it as
    a leaf instead of re-planning and re-running its subtree."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
