"""Rolling backtest with any estimator.

Walk-forward folds, K-fold grid search, bootstrap bagging, the mean of the members' predictions,
per-fold and overall metrics.  Rows are scaled once (wide, one array of features a row) and numbered
by a seeded hash within their fold, which gives both the K-fold part and the row's place in the bootstrap draws.

Without an ``estimator`` it is ridge regression from sufficient statistics: one pass over the rows sums
Gram matrices (X'X, X'y, y'y, n) per (fold, K-fold part or member) inside each task, the few arrays are added up in two
levels, a fold's small systems are solved, and the members' mean prediction is that of their mean coefficients.  No fold's
rows ever meet in one task.

With an :mod:`estimator <estimators>` a model needs its rows together: one group per (fold, grid point, K-fold part) and
one per (fold, member), each in a task of its own.  A group is bounded by ``max_cells`` (rows x features); a fold beyond it raises, since it
needs an estimator with mergeable statistics.  Models are joined back to test rows by (fold, part), where parts bound the rows of a task.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import folds as FD
from .estimators import Estimator, ridge_weights
from .metrics import regression_metrics

ALPHAS = (1e-5, 1e-2, 1.0)
#: Arrays of a (fold, group) are first added up in so many parts.
SALTS = 16
#: Rows x features that one model may be trained on (8 bytes each), and test rows that one task predicts.
MAX_CELLS, TEST_ROWS = 1 << 26, 100_000


def matrix(x: pa.Array | pa.ChunkedArray, p: int) -> np.ndarray:
    """An array<double> column of ``p`` values a row as (rows, p); missing values are NaN."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, p).astype(float)


def _prepared(frame: DataFrame, features: Sequence[str], start: int, end: int, train_years: int, k: int, members: int, frac: float,
              seed: int, key: str, date: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Train rows ``(fold, _pos, cv, times, x, y)`` (``times``: member -> how often drawn) and test rows ``(fold, key, date, x, y)``."""
    scaled = FD.fold_scale(frame.withColumn("_target", F.col(target)), features, start, end, train_years, key, date, keep=["_target"])
    scaled = materialize(scaled.withColumnRenamed("_target", "y"))
    train = FD.numbered(scaled.where(F.col("role") == "train"), ids=(key, date), seed=seed)
    sizes = scaled.where(F.col("role") == "train").groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    drawn = FD.draws(sizes, members, frac, seed).groupBy("fold", "_pos").agg(F.map_from_entries(F.collect_list(F.struct("member", "weight"))).alias("times"))  # <= members entries
    train = train.join(drawn, ["fold", "_pos"], "left").withColumn("cv", F.pmod("_pos", F.lit(k)).cast("int"))
    return train.select("fold", "_pos", "cv", "times", "x", "y"), scaled.where(F.col("role") == "test").select("fold", key, date, "x", "y")


# --- ridge from sums -----------------------------------------------------------------
def _grams(p: int, members: int):
    """X'X, X'y, y'y, n of a task's rows per fold and group: ``cv<part>`` and ``m<member>``."""

    def run(batches):
        sums: dict[tuple[int, str], np.ndarray] = {}
        for b in batches:
            x = np.hstack([np.ones((b.num_rows, 1)), np.nan_to_num(matrix(b.column("x"), p))])
            y, fold, cv = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "cv"))
            times = np.zeros((b.num_rows, members))
            entries = b.column("times")
            row = np.repeat(np.arange(b.num_rows), np.diff(entries.offsets.to_numpy()))
            times[row, entries.keys.to_numpy()] = entries.items.to_numpy()
            for f in np.unique(fold):
                own = fold == f
                groups = [(f"cv{c}", own & (cv == c), None) for c in np.unique(cv[own])] + [(f"m{m}", own & (times[:, m] > 0), times[:, m]) for m in range(members)]
                for name, rows, weight in groups:
                    if not rows.any():
                        continue
                    xs, ys, w = x[rows], y[rows].astype(float), np.ones(rows.sum()) if weight is None else weight[rows]
                    xw = xs * w[:, None]
                    v = np.concatenate([(xw.T @ xs).ravel(), xw.T @ ys, [float(w @ (ys * ys)), float(w.sum())]])
                    sums[int(f), name] = sums[int(f), name] + v if (int(f), name) in sums else v
        for (f, name), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([name]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["fold", "grp", "v"])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "grp": [pdf["grp"].iloc[0]], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})


def _solver(p: int, alphas: Sequence[float], k: int):
    p1 = p + 1

    def unpack(v):
        return v[:p1 * p1].reshape(p1, p1), v[p1 * p1:p1 * p1 + p1], v[-2], v[-1]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        stats = {g: unpack(np.sum(np.stack(d["v"].to_list()), axis=0)) for g, d in pdf.groupby("grp")}
        cv = [stats[f"cv{i}"] for i in range(k) if f"cv{i}" in stats]
        best_alpha, best = None, np.inf
        for a in alphas:
            errs = []
            for i, (xtx_k, xty_k, yy_k, n_k) in enumerate(cv):
                if n_k == 0 or len(cv) < 2:
                    continue
                w = ridge_weights(sum(s[0] for j, s in enumerate(cv) if j != i), sum(s[1] for j, s in enumerate(cv) if j != i), a)
                errs.append((yy_k - 2 * w @ xty_k + w @ xtx_k @ w) / n_k)
            score = float(np.mean(errs)) if errs else np.inf
            if score < best:
                best_alpha, best = a, score
        chosen = [s for g, s in stats.items() if g.startswith("m")]
        if best_alpha is None or not chosen:
            return pd.DataFrame(columns=["fold", "coef", "best_alpha", "best_cv_mse"])
        coef = np.mean([ridge_weights(s[0], s[1], best_alpha) for s in chosen], axis=0)
        return pd.DataFrame({"fold": [int(pdf["fold"].iloc[0])], "coef": [coef], "best_alpha": [best_alpha], "best_cv_mse": [best]})

    return solve


def _ridge(train: DataFrame, test: DataFrame, p: int, alphas: Sequence[float], k: int, members: int, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    empty = F.create_map().cast("map<int,bigint>")
    rows = train.select("fold", "cv", F.coalesce("times", empty).alias("times"), "x", F.col("y").cast("double").alias("y"))
    sums = rows.mapInArrow(_grams(p, members), "fold int, grp string, v array<double>")  # (folds x (k + members)) arrays a task
    part = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = part.groupBy("fold", "grp", "part").applyInPandas(_added, "fold int, grp string, v array<double>")
    # At most (k + members) * SALTS arrays a fold reach its solver.
    coefs = materialize(part.groupBy("fold").applyInPandas(_solver(p, alphas, k), "fold int, coef array<double>, best_alpha double, best_cv_mse double"))
    own = F.broadcast(coefs.select("fold", "coef"))  # a row a fold
    linear = F.aggregate(F.zip_with("x", F.slice("coef", 2, p), lambda x, w: F.coalesce(x, F.lit(0.0)) * w), F.lit(0.0), lambda s, v: s + v)
    preds = test.join(own, "fold").select("fold", *ids, F.col("y").alias("y_actual"), (F.get("coef", F.lit(0)) + linear).alias("y_predicted"))
    return preds, coefs.select("fold", "best_alpha", "best_cv_mse")


# --- any estimator -------------------------------------------------------------------
def _rows_of(t: pa.Table, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(x, y, order)`` of a group's rows by position; features that the fold dropped are left out."""
    order = np.argsort(t.column("_pos").to_numpy(), kind="stable")
    x = matrix(t.column("x"), p)[order]
    return x[:, ~np.isnan(x).all(axis=0)], t.column("y").to_numpy()[order].astype(float), order


def _scores(estimator: Estimator, p: int, seed: int):
    """The held-out error of one grid point on one K-fold part."""

    def run(t: pa.Table) -> pa.Table:
        x, y, order = _rows_of(t, p)
        fold, g, part = (t.column(c)[0].as_py() for c in ("fold", "g", "part"))
        out = t.column("cv").to_numpy()[order] == part
        error = None
        if out.any() and not out.all():
            model = estimator.fit(x[~out], y[~out], np.ones((~out).sum()), estimator.grid[g], seed + part)
            error = float(np.mean((y[out] - estimator.predict(model, x[out])) ** 2))
        return pa.table({"fold": pa.array([fold], pa.int32()), "g": pa.array([g], pa.int32()), "mse": pa.array([error], pa.float64())})

    return run


def _members(estimator: Estimator, p: int, seed: int):
    """The model of one member on the rows that it drew."""

    def run(t: pa.Table) -> pa.Table:
        x, y, order = _rows_of(t, p)
        fold, g, member = (t.column(c)[0].as_py() for c in ("fold", "g", "member"))
        model = estimator.fit(x, y, t.column("weight").to_numpy()[order].astype(float), estimator.grid[g], seed + 1000 + member)
        return pa.table({"fold": pa.array([fold], pa.int32()), "member": pa.array([member], pa.int32()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    return run


def _predictions(estimator: Estimator, p: int, schema: pa.Schema):
    """The mean prediction of a fold's models for a part of its test rows."""

    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        if not rows.num_rows or not models.num_rows:
            return schema.empty_table()
        x = matrix(rows.column("x"), p)
        x = x[:, ~np.isnan(x).all(axis=0)]
        order = np.argsort(models.column("member").to_numpy())
        loaded = [pickle.loads(models.column("model")[int(i)].as_py()) for i in order]
        mean = np.mean([estimator.predict(m, x) for m in loaded], axis=0)
        return rows.drop_columns(["x", "part"]).append_column("y_predicted", pa.array(mean, pa.float64())).cast(schema)

    return run


def _trained(train: DataFrame, test: DataFrame, p: int, estimator: Estimator, k: int, members: int, seed: int, ids: Sequence[str],
             max_cells: int) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.pandas.types import to_arrow_schema

    largest = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest * p > max_cells:
        raise ValueError(f"a fold of {largest} rows x {p} features is over max_cells={max_cells}: use an estimator with mergeable statistics (estimator=None)")
    train = materialize(train)
    points = F.explode(F.sequence(F.lit(0), F.lit(len(estimator.grid) - 1))).alias("g")
    tried = train.select("fold", "_pos", "cv", "x", F.col("y").cast("double").alias("y"), points).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("part"))
    scores = tried.groupBy("fold", "g", "part").applyInArrow(_scores(estimator, p, seed), "fold int, g int, mse double")
    mean = scores.groupBy("fold", "g").agg(F.avg("mse").alias("mse")).where(F.col("mse").isNotNull())
    best = materialize(mean.groupBy("fold").agg(F.min(F.struct("mse", "g")).alias("b")).select("fold", F.col("b.g").alias("g"), F.col("b.mse").alias("best_cv_mse")))
    drawn = (train.where(F.col("times").isNotNull()).select("fold", "_pos", "x", F.col("y").cast("double").alias("y"), F.explode("times").alias("member", "weight"))
             .join(F.broadcast(best.select("fold", "g")), "fold"))  # a row a fold
    models = materialize(drawn.groupBy("fold", "member").applyInArrow(_members(estimator, p, seed), "fold int, member int, model binary"))
    parts = F.ceil(F.col("n") / F.lit(float(TEST_ROWS))).cast("int")
    dealt = test.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).select("fold", parts.alias("parts"))  # a row a fold
    rows = test.join(F.broadcast(dealt), "fold").withColumn("part", F.pmod(F.xxhash64(*ids), F.col("parts")).cast("int")).drop("parts").withColumnRenamed("y", "y_actual")
    each = models.join(dealt, "fold").select("fold", "member", "model", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    out = rows.drop("x", "part").withColumn("y_predicted", F.lit(None).cast("double")).schema
    preds = (rows.groupBy("fold", "part").cogroup(each.groupBy("fold", "part"))
             .applyInArrow(_predictions(estimator, p, to_arrow_schema(out)), out))
    params = F.array(*[F.lit(json.dumps(g)) for g in estimator.grid])
    return preds.select("fold", *ids, "y_actual", "y_predicted"), best.select("fold", F.get(params, F.col("g")).alias("best_params"), "best_cv_mse")


def rolling_backtest(frame: DataFrame, features: Sequence[str], start: int, end: int,
                     train_years: int = 10, k: int = 5, members: int = 10, frac: float = 0.6,
                     alphas: Sequence[float] = ALPHAS, seed: int = 42, key: str = "gvkey",
                     date: str = "datadate", target: str = "y", estimator: Estimator | None = None,
                     max_cells: int = MAX_CELLS) -> tuple[DataFrame, DataFrame]:
    """Walk-forward backtest -> (predictions, metrics per fold + overall).

    predictions: ``(fold, key, date, y_actual, y_predicted)``; metrics: ``(fold, mse, r2,
    mae, rmse, n)`` with a NULL-fold overall row, and the fold's record: ``best_alpha`` (ridge) or ``best_params`` (JSON),
    ``best_cv_mse``, ``n_train``, ``n_test``.  Folds without a usable feature have no row.
    """
    names, ids = list(features), (key, date)
    train, test = _prepared(frame, names, start, end, train_years, k, members, frac, seed, key, date, target)
    if estimator is None:
        preds, record = _ridge(train, test, len(names), alphas, k, members, ids)
    else:
        preds, record = _trained(train, test, len(names), estimator, k, members, seed, ids, max_cells)
    preds = materialize(preds)
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n_train")).join(test.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test")), "fold")
    metrics = regression_metrics(preds, "y_actual", "y_predicted", by="fold").join(F.broadcast(record.join(sizes, "fold")), "fold", "left")  # a row a fold
    return preds, metrics


def residual_sample(preds: DataFrame, year: int | None = None, n: int = 1000, seed: int = 42,
                    key: str = "gvkey", date: str = "datadate") -> DataFrame:
    """Up to ``n`` predictions (optionally of one year) chosen by seeded hash, with residuals.

    The limit is the feature here (a display sample), taken by hash order.
    """
    from ..functions.hashing import hash_key

    p = preds if year is None else preds.where(F.year(date) == year)
    p = p.withColumn("_h", hash_key(F.col(key), F.col(date), F.lit(seed)))
    return (p.orderBy("_h").limit(n).drop("_h")
            .withColumn("residual", F.col("y_actual") - F.col("y_predicted")))
