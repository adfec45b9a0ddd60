"""News articles to labelled rows (C02-C05, C12-C16): one text pass, one as-of pass for both directions.

The text is read once into a narrow stage (keys, day, mentions); cleaning, as-of matching and the
label joins run on that.  The as-of match depends on the day alone, so it is computed for the distinct days,
a table bounded by the calendar (one row a day), and joined back together with the labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_min_words, mentioned_currencies, truncate_chars
from ..session import materialize
from .articles import dedup_keep_first
from .observed import StageCounts
from .returns import to_wide


def trading_day_map(days: DataFrame, trading: DataFrame) -> DataFrame:
    """``day, trading_date_future, trading_date_past``: the first trading date on or after, the last on or before each day.

    ``days``: day (date); ``trading``: trading_date (date).  Both are sets of dates, so the window
    over their union holds one row per calendar day at most."""
    marks = (days.select("day", F.lit(None).cast("date").alias("_t"))
             .unionByName(trading.select(F.col("trading_date").alias("day"), F.col("trading_date").alias("_t")))
             .groupBy("day").agg(F.max("_t").alias("_t")))
    past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return marks.select("day", F.last("_t", True).over(future).alias("trading_date_future"),
                        F.last("_t", True).over(past).alias("trading_date_past"))


def article_stage(df: DataFrame, synonyms: dict[str, list[str]] | None = None, keep: Sequence[str] = (),
                  min_words: int = 20, max_chars: int = 32767, dedup_keys: Sequence[str] = ("Full Text", "Title", "URL"),
                  ordinal: str = "ordinal", partition: Sequence[str] = ("source",), counts: StageCounts | None = None) -> DataFrame:
    """Cleaned articles that mention a code, without their texts:
    ``(*partition, ordinal, *keep, Date, has_title, mentioned_currencies)``; their rows by stage go to ``counts``."""
    text = F.col("`Full Text`")
    keys = [f"_k{i}" for i in range(len(dedup_keys))]

    def mark(rows: DataFrame, stage: str) -> DataFrame:
        return counts.mark(rows, stage) if counts else rows

    long_enough = mark(mark(df, "read").where(has_min_words(text, min_words)), "long enough")
    narrow = materialize(long_enough.select(
        *partition, ordinal, *[c for c in keep if c not in (*partition, ordinal)], F.to_date("Date").alias("Date"),
        F.col("Title").isNotNull().alias("has_title"),
        mentioned_currencies(truncate_chars(text, max_chars), synonyms).alias("mentioned_currencies"),
        *[F.sha2(F.col(f"`{k}`").cast("string"), 256).alias(n) for k, n in zip(dedup_keys, keys)]))
    for n in keys:
        narrow = dedup_keep_first(narrow, n, ordinal, partition)
    return mark(mark(narrow, "without repeats").where(F.size("mentioned_currencies") > 0).drop(*keys), "mentioning")


def label_articles(df: DataFrame, labels: DataFrame, codes: Sequence[str], synonyms: dict[str, list[str]] | None = None,
                   keep: Sequence[str] = (), counts: StageCounts | None = None, **cleaning) -> DataFrame:
    """Complete labelled articles: the stage's columns, both trading dates and ``<code>_{future,past}_label``.

    ``labels``: (date, ccy, future_label, past_label).  Rows lacking a title, a day, a future trading
    date or any label are dropped."""
    stage = materialize(article_stage(df, synonyms, keep, counts=counts, **cleaning))
    trading = labels.select(F.col("date").alias("trading_date")).distinct()
    days = stage.where(F.col("Date").isNotNull()).select(F.col("Date").alias("day")).distinct()
    future = to_wide(labels, "date", "ccy", "future_label", codes, "_future_label").withColumnRenamed("date", "trading_date_future")
    past = to_wide(labels, "date", "ccy", "past_label", codes, "_past_label").withColumnRenamed("date", "trading_date_past")
    by_day = materialize(trading_day_map(days, trading).join(future, "trading_date_future").join(past, "trading_date_past")
                         .withColumnRenamed("day", "Date").na.drop())
    # One row per calendar day of 2 dates and 2 labels a code.
    out = stage.where("has_title").drop("has_title").join(F.broadcast(by_day), "Date")
    return counts.mark(out, "labelled") if counts else out
