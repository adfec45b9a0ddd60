"""Classification and regression metrics.

Metrics are computed from a confusion table (one row per actual x predicted
pair, a handful of rows) built by a partially-combined ``groupBy``; nothing
row-level reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LABELS
from ..session import materialize


def label_pairs(df: DataFrame, id_col: str, codes: Sequence[str], pred_map: str,
                horizons: Sequence[str] = ("past", "future"),
                actual_fmt: str = "{code}_{horizon}_label") -> DataFrame:
    """Unpivot actual label columns and map predictions into (id, code, horizon, actual, predicted).

    Rows whose prediction map is empty are skipped (as invalid responses);
    a missing key predicts 'unchanged'.
    """
    valid = df.where(F.size(pred_map) > 0)
    items = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(h).alias("horizon"),
                               F.col(f"`{actual_fmt.format(code=c, horizon=h)}`").alias("actual"))
                      for c in codes for h in horizons])
    ex = valid.select(F.col(id_col).alias("id"), F.col(pred_map).alias("_m"), F.explode(items).alias("_i"))
    pred = F.coalesce(F.try_element_at("_m", F.concat(F.col("_i.code"), F.lit("_"), F.col("_i.horizon"))),
                      F.lit("unchanged"))
    return ex.select("id", F.col("_i.code").alias("code"), F.col("_i.horizon").alias("horizon"),
                     F.col("_i.actual").alias("actual"), pred.alias("predicted"))


def confusion(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n): at most |labels|^2 rows, materialised once for reuse."""
    return materialize(pairs.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")))


def per_class(conf: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1, support per class (0 where undefined).

    ``labels=None`` uses the union of observed actual and predicted labels.
    """
    sup = conf.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    prd = conf.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_pred"))
    tp = conf.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"), F.col("n").alias("tp"))
    if labels is None:
        base = sup.select("label").unionByName(prd.select("label")).distinct()
    else:
        base = conf.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    j = base.join(sup, "label", "left").join(prd, "label", "left").join(tp, "label", "left").fillna(
        0, subset=["support", "n_pred", "tp"])
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.withColumn("f1", f1).select("label", "precision", "recall", "f1",
                                         F.col("support").cast("bigint").alias("support"))


def classification_metrics(pairs: DataFrame, labels: Sequence[str] = LABELS, actual: str = "actual",
                           predicted: str = "predicted", skipped: DataFrame | None = None) -> DataFrame:
    """One row: accuracy, macro-F1 over observed labels, n, plus per fixed class P/R/F1/support."""
    conf = confusion(pairs, actual, predicted)
    tot = conf.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                                                .otherwise(0)).alias("correct"))
    macro = per_class(conf).agg(F.avg("f1").alias("macro_f1"))
    fixed = per_class(conf, labels)
    piv = fixed.groupBy().pivot("label", list(labels)).agg(
        F.first("precision").alias("precision"), F.first("recall").alias("recall"),
        F.first("f1").alias("f1"), F.first("support").alias("support"))
    out = tot.crossJoin(macro).crossJoin(piv).select(
        (F.col("correct") / F.col("n")).alias("accuracy"), "macro_f1", F.col("n").cast("bigint").alias("n"),
        *[F.col(c) for c in piv.columns])
    if skipped is not None:
        out = out.crossJoin(skipped.agg(F.count(F.lit(1)).cast("bigint").alias("skipped")))
    return out


def classification_report(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Rows per observed class plus 'accuracy', 'macro avg', 'weighted avg' (sklearn layout)."""
    conf = confusion(pairs, actual, predicted)
    pc = per_class(conf)
    total = conf.agg(F.sum("n").alias("total"),
                     F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("ok"))
    acc = total.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                       F.lit(None).cast("double").alias("recall"), (F.col("ok") / F.col("total")).alias("f1"),
                       F.col("total").cast("bigint").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   F.sum("support").cast("bigint").alias("support"))
    wsum = F.sum("support")
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * F.col("support")) / wsum).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / wsum).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / wsum).alias("f1"),
                      wsum.cast("bigint").alias("support"))
    return pc.unionByName(acc).unionByName(macro).unionByName(weighted)


def regression_metrics(df: DataFrame, y: str = "y_actual", yhat: str = "y_predicted",
                       by: str | None = None) -> DataFrame:
    """MSE, R^2, MAE, RMSE per group and an ``overall`` row (group NULL).

    R^2 = 1 - SSE / SST with SST around the group mean (sklearn's r2_score).
    """
    e = F.col(y) - F.col(yhat)
    aggs = [F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n"),
            F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_vp")]
    if by:
        g = df.rollup(by).agg(*aggs)
    else:
        g = df.agg(*aggs)
    r2 = F.when(F.col("_vp") > 0, 1 - F.col("_sse") / (F.col("_vp") * F.col("n")))
    cols = ([by] if by else []) + [F.col("mse"), r2.alias("r2"), "mae", F.sqrt("mse").alias("rmse"),
                                   F.col("n").cast("bigint").alias("n")]
    return g.select(*cols)
