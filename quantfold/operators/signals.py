"""Sentiment signal, long-short weights, strategy P&L and risk metrics.

Predictions are long rows ``(article_id, trading_date, ccy, horizon, label)``.
All per-date work is keyed by the date (or date x currency); the only
ordered windows run over the set of distinct trading dates, which is bounded
by the calendar (one row per day), never by the number of articles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..functions.text import LABELS
from ..session import materialize

ANNUALIZATION = 252


def predictions_from_map(df: DataFrame, id_col: str, date_col: str, map_col: str,
                         codes: Sequence[str], horizons: Sequence[str] = ("future", "past")) -> DataFrame:
    """Map column ``{"<CCY>_<horizon>": label}`` -> long predictions for the given codes.

    A missing key becomes 'unchanged' (the reference's default).
    """
    keys = F.array(*[F.struct(F.lit(c).alias("ccy"), F.lit(h).alias("horizon"))
                     for c in codes for h in horizons])
    ex = df.select(F.col(id_col).alias("article_id"), F.col(date_col).alias("trading_date"),
                   F.col(map_col).alias("_m"), F.explode(keys).alias("_k"))
    lab = F.coalesce(F.try_element_at("_m", F.concat(F.col("_k.ccy"), F.lit("_"), F.col("_k.horizon"))),
                     F.lit("unchanged"))
    return ex.select("article_id", "trading_date", F.col("_k.ccy").alias("ccy"),
                     F.col("_k.horizon").alias("horizon"), lab.alias("label"))


def daily_counts(preds: DataFrame, codes: Sequence[str], horizon: str = "future",
                 date: str = "trading_date") -> DataFrame:
    """Appreciation / depreciation counts per (date, currency) on the full date x code grid.

    Dates are those with at least one article; a currency without a
    prediction counts as unchanged.  Partial aggregation absorbs busy dates.
    """
    p = preds.where(F.col("horizon") == horizon)
    counts = p.groupBy(date, "ccy").agg(
        F.count_if(F.col("label") == "appreciation").alias("n_appreciation"),
        F.count_if(F.col("label") == "depreciation").alias("n_depreciation"))
    dates = preds.select(date).distinct()
    grid = dates.crossJoin(F.broadcast(
        preds.sparkSession.createDataFrame([(c,) for c in codes], "ccy string")))
    return (grid.join(counts, on=[date, "ccy"], how="left")
            .select(date, "ccy", F.coalesce("n_appreciation", F.lit(0)).cast("bigint").alias("n_appreciation"),
                    F.coalesce("n_depreciation", F.lit(0)).cast("bigint").alias("n_depreciation")))


def sentiment_signal(counts: DataFrame) -> DataFrame:
    """S = sign(ln(1+a) - ln(1+d)) = sign(a - d) (log is monotone)."""
    return counts.withColumn(
        "signal", F.signum(F.col("n_appreciation") - F.col("n_depreciation")).cast("int"))


def portfolio_weights(signal: DataFrame, date: str = "trading_date") -> DataFrame:
    """Longs S/sum(S>0), shorts S/sum(|S<0|), zero otherwise; per date."""
    w = Window.partitionBy(date)
    s = F.col("signal").cast("double")
    pos = F.sum(F.when(s > 0, s).otherwise(0.0)).over(w)
    neg = F.sum(F.when(s < 0, F.abs(s)).otherwise(0.0)).over(w)
    weight = (F.when((s > 0) & (pos > 0), s / pos)
              .when((s < 0) & (neg > 0), s / neg).otherwise(F.lit(0.0)))
    return signal.withColumn("weight", weight)


def next_dates(dates: DataFrame, date: str = "trading_date") -> DataFrame:
    """(date, next_date) over the sorted distinct dates (one row per calendar date)."""
    d = dates.select(date).distinct()
    return d.withColumn("next_date", F.lead(date).over(Window.orderBy(date)))


def execute_strategy(weights: DataFrame, returns: DataFrame, date: str = "trading_date",
                     ret_date: str = "date", ret: str = "ret") -> DataFrame:
    """Daily P&L: weights at date t times returns at the next news date.

    Returns are first restricted to news dates; the last news date has no
    next date and yields no row (n-1 rows).  A currency without a return on the
    next date adds nothing to that day (returns of ``log_returns`` are complete
    per date, so none is missing there).
    """
    nd = next_dates(weights, date)
    r = returns.select(F.col(ret_date).alias("next_date"), "ccy", F.col(ret).alias("_r"))
    r = r.join(nd.select(F.col(date).alias("next_date")), "next_date", "left_semi")
    j = (weights.join(nd, date).where(F.col("next_date").isNotNull())
         .join(r, on=["next_date", "ccy"], how="inner"))
    return j.groupBy(date).agg(F.sum(F.col("weight") * F.col("_r")).alias("pnl"))


def drawdown(pnl: DataFrame, date: str = "trading_date") -> DataFrame:
    """Cumulative P&L, running maximum (from the first value) and drawdown per date."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return (pnl.withColumn("cum_pnl", F.sum("pnl").over(w))
            .withColumn("running_max", F.max("cum_pnl").over(w))
            .withColumn("drawdown", F.col("running_max") - F.col("cum_pnl")))


def turnover(weights: DataFrame, date: str = "trading_date") -> DataFrame:
    """Sum over currencies of |w_t - w_{t-1}| per date (first date excluded)."""
    w = Window.partitionBy("ccy").orderBy(date)
    d = weights.withColumn("_dw", F.abs(F.col("weight") - F.lag("weight").over(w)))
    return d.where(F.col("_dw").isNotNull()).groupBy(date).agg(F.sum("_dw").alias("turnover"))


def strategy_metrics(pnl: DataFrame, weights: DataFrame, periods: int = ANNUALIZATION,
                     date: str = "trading_date") -> DataFrame:
    """One row: annualised return %, volatility %, Sharpe (0 if vol 0), max drawdown %, turnover."""
    dd = drawdown(pnl, date).agg(F.max("drawdown").alias("mdd"))
    base = pnl.agg(F.avg("pnl").alias("mu"), F.stddev_samp("pnl").alias("sd"))
    tov = turnover(weights, date).agg(F.avg("turnover").alias("tov"))
    ann_ret = F.col("mu") * periods
    ann_vol = F.col("sd") * math.sqrt(periods)
    return base.crossJoin(dd).crossJoin(tov).select(
        (ann_ret * 100).alias("annualized_return_pc"), (ann_vol * 100).alias("annualized_volatility_pc"),
        F.when(ann_vol != 0, ann_ret / ann_vol).otherwise(F.lit(0.0)).alias("sharpe_ratio"),
        (F.col("mdd") * 100).alias("max_drawdown_pc"), (F.col("tov") * periods).alias("rebalancing_frequency"))


def run_strategy(preds: DataFrame, returns: DataFrame, codes: Sequence[str], horizon: str = "future",
                 periods: int = ANNUALIZATION) -> DataFrame:
    """Predictions + returns -> the five strategy metrics (counts, signal, weights, P&L, metrics)."""
    w = materialize(portfolio_weights(sentiment_signal(daily_counts(preds, codes, horizon))))  # dates x codes rows, read three times
    pnl = materialize(execute_strategy(w, returns))  # a row a date
    return strategy_metrics(pnl, w, periods)


def synthetic_predictions(df: DataFrame, id_col: str, codes: Sequence[str], seed: int = 42,
                          horizons: Sequence[str] = ("future", "past")) -> DataFrame:
    """Reproducible random labels per (article, code, horizon) for dry runs."""
    keys = F.array(*[F.struct(F.lit(c).alias("ccy"), F.lit(h).alias("horizon"))
                     for c in codes for h in horizons])
    ex = df.select(F.col(id_col).alias("article_id"), F.explode(keys).alias("_k"))
    h = hash_key(F.col("article_id"), F.col("_k.ccy"), F.col("_k.horizon"), F.lit(seed))
    lab = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod(h, F.lit(3)) + 1).cast("int"))
    return ex.select("article_id", F.col("_k.ccy").alias("ccy"), F.col("_k.horizon").alias("horizon"),
                     lab.alias("label"))


def dictionary_scores(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``df`` with counts of lexicon words per article and a label (positives less negatives).

    ``lexicon``: (word, polarity).  Words are the lower-cased runs of letters a-z.  Words are counted per article
    before the join on the word, so a frequent word is one row per article; articles without a hit
    count 0.  ``id_col`` names an article."""
    words = F.explode(F.split(F.lower(F.col(f"`{text}`")), "[^a-z]+")).alias("word")
    counted = df.select(F.col(id_col).alias("_id"), words).where("word <> ''").groupBy("_id", "word").agg(F.count("*").alias("_n"))
    lex = lexicon.select(F.lower("word").alias("word"), "polarity").distinct()
    hits = counted.join(lex, "word").groupBy("_id").agg(
        F.sum(F.when(F.col("polarity") > 0, F.col("_n")).otherwise(0)).alias("n_positive"),
        F.sum(F.when(F.col("polarity") < 0, F.col("_n")).otherwise(0)).alias("n_negative"))
    out = df.join(hits, df[id_col] == hits["_id"], "left").drop("_id").fillna(0, ["n_positive", "n_negative"])
    score = F.col("n_positive") - F.col("n_negative")
    return out.withColumn("dict_label", F.when(score > 0, "appreciation")
                          .when(score < 0, "depreciation").otherwise("unchanged"))


def dictionary_predictions(df: DataFrame, id_col: str, text: str, mentions: str, lexicon: DataFrame,
                           horizons: Sequence[str] = ("future",)) -> DataFrame:
    """Dictionary baseline: every mentioned currency gets the article's dictionary label."""
    s = dictionary_scores(df, id_col, text, lexicon)
    ex = s.select(F.col(id_col).alias("article_id"), "dict_label", F.explode(mentions).alias("ccy"))
    hz = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    return ex.select("article_id", "ccy", hz, F.col("dict_label").alias("label"))
