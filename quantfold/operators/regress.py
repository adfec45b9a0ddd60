"""Filling NULLs by linear regression on other columns.

A row is filled from the predictors that it has: the regression of its *pattern* (which predictors are present) is fitted on all
rows that have the target and those predictors.  One aggregate sums cross products per group and pattern (they combine
map-side; a row counts for every needed pattern that it covers), a small system a pattern is solved, and rows meet the
coefficients of their pattern.

Defined cases: without any predictor the mean of the target is filled; a constant or redundant predictor takes no share
(the solution of least norm); a group without a known target stays NULL; NaN is NULL; present targets don't change.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: A pattern is a number of this many bits at most.
MAX_PREDICTORS = 16
#: Rows of coefficients (a group and pattern each) up to which they are broadcast.
BROADCAST_ROWS = 100_000


def _solved(p: int, names: list[str]):
    """Coefficients of each (group, pattern) row of sums: intercept and one number a predictor (0 where absent)."""

    def run(batches):
        for pdf in batches:
            out = []
            for v, pattern in zip(pdf["v"], pdf["_pattern"]):
                at = [i for i in range(p) if pattern >> i & 1]
                n, sy = v[0], v[1]
                s = np.array([v[2 + i] for i in at])
                xy = np.array([v[2 + p + i] for i in at])
                xx = np.array([[v[2 + 2 * p + i * p + j] for j in at] for i in at]).reshape(len(at), len(at))
                coef = np.zeros(p + 1)
                if at:
                    centred = xx - np.outer(s, s) / n
                    scale = np.sqrt(np.maximum(np.diag(centred), 0))
                    live = scale > 1e-12 * np.sqrt(np.maximum(np.diag(xx), 0))  # the others are constant
                    unit = np.where(live, scale, 1)
                    system = centred / np.outer(unit, unit) * np.outer(live, live)
                    w = np.linalg.lstsq(system, (xy - s * sy / n) / unit * live, rcond=1e-12)[0] / unit
                    coef[[i + 1 for i in at]] = w
                    coef[0] = (sy - w @ s) / n
                else:
                    coef[0] = sy / n
                out.append(coef.tolist())
            yield pd.DataFrame({**{c: pdf[c] for c in names}, "_coef": out})

    return run


def fill_regression(df: DataFrame, target: str, predictors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with NULLs of ``target`` replaced by fitted values; other columns are unchanged."""
    preds, by, p = list(predictors), list(by), len(predictors)
    if p > MAX_PREDICTORS or target in preds:
        raise ValueError(f"at most {MAX_PREDICTORS} predictors, the target not among them")

    def number(c: str):
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)

    x, y = [number(c) for c in preds], number(target)
    pattern = sum((F.when(v.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(x)), F.lit(0))
    keys = [f"_g{i}" for i in range(len(by))]  # group keys, under names of their own
    narrow = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.array(*x).alias("_x") if x else F.array().cast("array<double>").alias("_x"), y.alias("_y"), pattern.alias("_has"))
    # Sums around the means lose no digits: one row of means, taken off before anything is multiplied.
    means = narrow.where(F.col("_y").isNotNull()).agg(F.avg("_y").alias("_my"), *[F.avg(F.get("_x", F.lit(i))).alias(f"_m{i}") for i in range(p)]).first()
    my, mx = means["_my"], [means[f"_m{i}"] or 0.0 for i in range(p)]
    if my is None:
        return df
    needed = [r[0] for r in narrow.where(F.col("_y").isNull()).select("_has").distinct().collect()]  # at most 2^predictors numbers
    if not needed:
        return df
    known = narrow.where(F.col("_y").isNotNull()).select(*keys, "_x", "_y", F.explode(F.filter(F.lit(needed).cast("array<int>"), lambda n: n.bitwiseAND(F.col("_has")) == n)).alias("_pattern"))
    z = [F.coalesce(F.get("_x", F.lit(i)) - F.lit(m), F.lit(0.0)) for i, m in enumerate(mx)]
    w = F.col("_y") - F.lit(my)
    sums = [F.count(F.lit(1)).cast("double"), F.sum(w), *[F.sum(a) for a in z], *[F.sum(a * w) for a in z]]
    cross = {(i, j): F.sum(z[i] * z[j]) for i in range(p) for j in range(i, p)}
    sums += [cross[min(i, j), max(i, j)] for i in range(p) for j in range(p)]
    total = known.groupBy(*keys, "_pattern").agg(F.array(*sums).alias("v"))
    schema = total.drop("v").schema.add("_coef", T.ArrayType(T.DoubleType()))
    coefs = materialize(total.mapInPandas(_solved(p, [*keys, "_pattern"]), schema))
    coefs = coefs.select(*[F.col(k).alias(f"_of{k}") for k in keys], F.col("_pattern").alias("_of"), "_coef")
    coefs = F.broadcast(coefs) if coefs.count() <= BROADCAST_ROWS else coefs
    gap = F.when(y.isNull(), pattern)  # only rows to fill look for coefficients
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_of{k}")) for c, k in zip(by, keys)]
    fitted = F.lit(my) + F.get("_coef", F.lit(0))
    for i in range(p):
        fitted = fitted + F.coalesce((x[i] - F.lit(mx[i])) * F.get("_coef", F.lit(i + 1)), F.lit(0.0))
    joined = df.join(coefs, [*same, gap == F.col("_of")], "left")
    kind = df.schema[target].dataType
    return joined.select(*[F.coalesce(y, fitted).cast(kind).alias(c) if c == target else F.col(f"`{c}`") for c in df.columns])
