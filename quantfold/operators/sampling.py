"""Exact-size samples, splits and balanced groups by seeded hash.

A row's place is its rank by a seeded hash of its keys; which rows are among the first k follows from the k-th smallest
hash, found by radix selection (:mod:`radix`).  No rows are ranked or sorted, but those whose hash equals the threshold
(their keys break the tie).  Sizes are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import materialize
from . import radix

#: Thresholds (a row a group and size) up to which they are broadcast.
BROADCAST_ROWS = 500_000


def among_first(df: DataFrame, sizes: dict[str, Callable[[Column], Column]], ids: Sequence[str], seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Add a boolean per name: whether the row is among the first ``size(rows of its group)`` by hash within ``by``.

    ``ids`` (unique together) also break ties; a group of NULL keys is a group; a size of 0 or less takes no row."""
    by, names = list(by), list(sizes)
    h = df.withColumn("_h", hash_key(*[F.col(c) for c in ids], F.lit(seed)))

    def last_ranks(total: Column) -> Column:
        return F.array(*[F.struct(F.lit(float(i)).alias("_p"), F.lit(0.0).alias("_h"), F.lit(0).alias("_side"), (F.least(sizes[n](total), total) - 1).cast("bigint").alias("_rank"))
                         for i, n in enumerate(names)])

    found = radix.select(h, by, last_ranks, "_h")
    cut = F.struct(F.col("_v").alias("x"), F.col("_tie").alias("tie"))
    at = found.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(*[F.max(F.when(F.col("_p") == float(i), cut)).alias(f"_c{i}") for i in range(len(names))])
    at = materialize(at)  # a row a group
    at = F.broadcast(at) if at.count() <= BROADCAST_ROWS else at
    marked = h.join(at, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], "left") if by else h.crossJoin(at)
    equal = F.lit(False)
    for i in range(len(names)):
        equal = equal | F.coalesce(F.col("_h") == F.col(f"_c{i}.x"), F.lit(False))
    # Only rows at a threshold are numbered, within their hash: the others share windows of their own.
    order = Window.partitionBy(*by, "_at").orderBy(*ids)
    marked = marked.withColumn("_at", F.when(equal, F.col("_h")))
    tied = marked.where(F.col("_at").isNotNull()).withColumn("_n", F.row_number().over(order) - 1)
    marked = marked.where(F.col("_at").isNull()).withColumn("_n", F.lit(0)).unionByName(tied)
    flags = [F.coalesce((F.col("_h") < F.col(f"_c{i}.x")) | ((F.col("_h") == F.col(f"_c{i}.x")) & (F.col("_n") <= F.col(f"_c{i}.tie"))), F.lit(False)).alias(n) for i, n in enumerate(names)]
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], *flags)


def sample_exact(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows of each group (all, if fewer)."""
    return among_first(df, {"_in": lambda total: F.lit(n).cast("bigint")}, ids, seed, by).where("_in").drop("_in")


def split_exact(df: DataFrame, n_eval: int, train_share: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``split``: ``n_eval`` rows eval, ``floor(train_share * rest)`` train, the others test."""

    def trained(total: Column) -> Column:
        return F.lit(n_eval) + F.floor(F.greatest(total - n_eval, F.lit(0)) * train_share)

    marked = among_first(df, {"_eval": lambda total: F.lit(n_eval).cast("bigint"), "_train": trained}, ids, seed)
    return marked.withColumn("split", F.when(F.col("_eval"), "eval").when(F.col("_train"), "train").otherwise("test")).drop("_eval", "_train")


def balance_labels(df: DataFrame, label: str, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Every label cut to the size of the smallest one; rows without a label are dropped."""
    labelled = df.where(F.col(label).isNotNull())
    least = labelled.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return sample_exact(labelled, least, ids, seed, [label])
