"""Stand-ins for the reference's inputs, derived from the driver's tables.

The reference's own inputs (rate CSVs, a firm-year panel, news CSVs,
predictions) are not in its tree.  Each function here derives the matching
schema from the synthetic tables with plain Spark transformations, so every
registered query reads the given tables and grows with them.  The matching
SQL lives next to the query definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- 1.1 time series: events(ts, value) with deterministic NULLs -------------
def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``time = ts``, measure ``value`` (NULL where event_id % 7 = 0), ``by = event_type``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", F.col("ts").alias("time"), "event_type", "user_id",
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value")).alias("value"))


def hourly_series(spark: SparkSession, sf_dir: str, event_type: str, name: str) -> DataFrame:
    """Hourly mean of one event type: ``(time, <name>)``."""
    ev = table(spark, sf_dir, "events")
    return (ev.where(F.col("event_type") == event_type)
            .groupBy(F.date_trunc("hour", "ts").alias("time"))
            .agg(F.avg("value").alias(name)))


# --- 1.4 rate series: monthly supplier-bucket revenue -------------------------
SERIES_CODES = [f"S{i}" for i in range(10)]


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ``(date, ccy, value)``: ``S<l_suppkey % 10>`` by ship month."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"),
                       F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("ccy"))
            .agg(F.sum("l_extendedprice").alias("value")))


# --- 1.3 articles: documents -------------------------------------------------
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, ordinal, Title, Date, Full Text, URL)`` from documents.

    Title = source and number (every 23rd repeats the number 20 below), URL =
    source || doc_id, date = a day and hour from 2024 on that spread over ten years; ``ordinal`` = doc_id is the stable file position used
    for keep-first de-duplication.
    """
    d = table(spark, sf_dir, "documents")
    return d.select(
        "source", F.col("doc_id").alias("ordinal"), "doc_id",
        F.concat(F.lit("Report "), F.col("source"), F.lit(" "),
                 (F.col("doc_id") - F.when(F.col("doc_id") % 23 == 0, 20).otherwise(0)).cast("string")).alias("Title"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(days=F.pmod(F.col("doc_id") * 7919, F.lit(3650)).cast("int"), hours=F.pmod("doc_id", F.lit(24)).cast("int"))).alias("Date"),
        F.col("text").alias("Full Text"),
        F.concat("source", F.col("doc_id").cast("string")).alias("URL"))


# --- 1.5 predictions: orders -------------------------------------------------
def predictions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions ``(article_id, trading_date, ccy, horizon, label)``.

    Currency = ``S<o_custkey % 10>``, date = order month, label from the
    priority digit (1, 2 appreciation; 4, 5 depreciation; 3 unchanged).
    """
    o = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    lab = (F.when(digit.isin("1", "2"), "appreciation")
           .when(digit.isin("4", "5"), "depreciation").otherwise("unchanged"))
    return o.select(
        F.col("o_orderkey").alias("article_id"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("trading_date"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 10).cast("string")).alias("ccy"),
        F.lit("future").alias("horizon"), lab.alias("label"))


# --- 1.2 panel: orders rolled up to customer-years ---------------------------
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm-year panel with the reference's column names.

    ``gvkey = o_custkey``, ``datadate = Dec 31 of the order year``; measures
    come from sum / count / min / max / avg of ``o_totalprice``; optional
    inputs get deterministic NULL patterns so the fill rules matter.  Divisors
    are primes so derived values never end exactly on a rounding digit.
    """
    o = table(spark, sf_dir, "orders")
    g = (o.groupBy(F.col("o_custkey").alias("gvkey"), F.year("o_orderdate").alias("fyear"))
         .agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"),
              F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
              F.avg("o_totalprice").alias("mu"),
              F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("f"),
              F.count(F.when(F.col("o_orderpriority").startswith("1"), 1)).alias("urgent")))
    k, y = F.col("gvkey"), F.col("fyear")
    s, n, lo, hi, mu, f = (F.col(c) for c in ("s", "n", "lo", "hi", "mu", "f"))
    nul = F.lit(None).cast("double")

    def maybe(expr, mod, rem=0):
        return F.when((k + y) % mod == rem, nul).otherwise(expr)

    cols = {
        "gvkey": k, "datadate": F.make_date(y, F.lit(12), F.lit(31)),
        "at": s / 997.0, "sale": hi / 97.0, "ib": (mu - lo) / 997.0 - 50.0,
        "csho": F.when(k % 17 == 0, F.lit(0.0)).otherwise(n.cast("double")),
        "SecurityType": F.when(k % 13 == 0, "PREF").otherwise("EQTY"),
        "SecuritySubType": F.lit("COM"),
        "PrimaryExch": F.element_at(F.array(*[F.lit(x) for x in "NAQX"]), (k % 4 + 1).cast("int")),
        "sic": F.when(k % 11 == 0, F.lit(None).cast("int")).otherwise(((k * 37) % 10000).cast("int")),
        "MthPrc": F.when(k % 19 == 0, F.lit(0.5)).otherwise(mu / 9973.0),
        "ivaeq": maybe(lo / 4999.0, 3), "ivao": maybe(hi / 8999.0, 4),
        "act": maybe(s / 2999.0, 5), "che": maybe(lo / 701.0, 6), "lct": maybe(hi / 797.0, 7),
        "dlc": maybe(mu / 1999.0, 8), "txp": maybe(n.cast("double"), 9), "dp": maybe(lo / 1499.0, 10),
        "oancf": F.when((k + y) % 4 == 0, F.lit(0.0)).otherwise(maybe(f / 997.0, 5, 1)),
        "xidoc": maybe(mu / 9973.0, 6, 2),
    }
    extra = ["cogs", "xsga", "xint", "nopi", "txt", "xad", "xrd", "spi", "xido", "dvc", "lt",
             "ceq", "invt", "rect", "ppent", "intan", "ap", "dltt", "re"]
    for i, name in enumerate(extra):
        base = [s, hi, lo, mu][i % 4]
        cols[name] = maybe(base / (97.0 * (i + 1)) - F.col("urgent"), 7 + i % 5, i % 3)
    return g.select(*[e.alias(c) for c, e in cols.items()])
