"""Queries over the time-series stand-in (events): quality, cleaning, statistics, rolling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import series
from ..operators import clean, quality, regress, rolling, stats
from ..operators.returns import to_wide
from . import fixtures as fx
from . import fixtures_sql as fsql
from .catalog import register

E = f"WITH e AS ({fsql.EVENTS_SERIES})"
TYPES = ["click", "error", "purchase", "signup", "view"]


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _ev(spark, sf_dir):
    return fx.events_series(spark, sf_dir)


@register("ts_count_null", E + """
SELECT col_name, CAST(null_count AS BIGINT) AS null_count FROM (
  SELECT 'event_id' AS col_name, count(*) FILTER (WHERE event_id IS NULL) AS null_count FROM e UNION ALL
  SELECT 'time', count(*) FILTER (WHERE time IS NULL) FROM e UNION ALL
  SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL) FROM e UNION ALL
  SELECT 'user_id', count(*) FILTER (WHERE user_id IS NULL) FROM e UNION ALL
  SELECT 'value', count(*) FILTER (WHERE value IS NULL) FROM e)""", ops=("A06", "A21"))
def ts_count_null(spark, sf_dir):
    return quality.count_null(_ev(spark, sf_dir)).withColumnRenamed("column", "col_name")


@register("ts_null_matrix", E + f"""
SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS bucket, 'value' AS col_name,
       {r6("avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)")} AS null_share
FROM e GROUP BY 1""", ops=("A07",))
def ts_null_matrix(spark, sf_dir):
    nm = quality.null_matrix(_ev(spark, sf_dir).select("time", "value"), "time", "day")
    return nm.withColumnRenamed("column", "col_name")


_Q = E + """, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e),
z AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM e)"""
_IQR_FLAG = "COALESCE(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false)"
_Z_FLAG = "NOT COALESCE(value BETWEEN m - 3 * s AND m + 3 * s, false)"


@register("ts_outliers_iqr", _Q + f"""
SELECT event_id, {r6("value")} AS value, {_IQR_FLAG} AS value__outlier FROM e, q""", ops=("A08", "A22"))
def ts_outliers_iqr(spark, sf_dir):
    return quality.outliers_iqr(_ev(spark, sf_dir).select("event_id", "value"), ["value"])


@register("ts_outliers_zscore", _Q + f"""
SELECT event_id, {r6("value")} AS value, {_Z_FLAG} AS value__outlier FROM e, z""", ops=("A09",))
def ts_outliers_zscore(spark, sf_dir):
    return quality.outliers_zscore(_ev(spark, sf_dir).select("event_id", "value"), ["value"])


@register("ts_filter_outliers", _Q + f"""
SELECT event_id, {r6("value")} AS value FROM e, q, z
WHERE NOT ({_IQR_FLAG}) AND NOT ({_Z_FLAG})""", ops=("A10",))
def ts_filter_outliers(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "value")
    a = quality.outliers_iqr(ev, ["value"], suffix="__iqr")
    b = quality.outliers_zscore(a, ["value"], suffix="__z")
    return quality.filter_outliers(b, ["value__iqr", "value__z"])


@register("ts_drop_null_rows", E + f"""
SELECT event_id, time, event_type, {r6("value")} AS value FROM e WHERE value IS NOT NULL""", ops=("A11",))
def ts_drop_null_rows(spark, sf_dir):
    return quality.drop_null_rows(_ev(spark, sf_dir).select("event_id", "time", "event_type", "value"))


@register("ts_drop_null_columns", E + f"""
SELECT event_id, time, event_type, {r6("value")} AS value FROM e""", ops=("A12",))
def ts_drop_null_columns(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "time", "event_type", "value")
    ev = ev.withColumn("sparse", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return quality.drop_null_columns(ev, 0.5)


@register("ts_fill_mean", E + f"""
SELECT event_id, {r6("COALESCE(value, (SELECT avg(value) FROM e))")} AS value FROM e""", ops=("A13",))
def ts_fill_mean(spark, sf_dir):
    return clean.fill_null(_ev(spark, sf_dir).select("event_id", "value"), ["value", "nope"], "mean")


@register("ts_fill_median", E + f"""
SELECT event_id, {r6("COALESCE(value, (SELECT median(value) FROM e))")} AS value FROM e""", ops=("A13", "S25"))
def ts_fill_median(spark, sf_dir):
    return clean.fill_null(_ev(spark, sf_dir).select("event_id", "value"), ["value"], "median")


def _fill_sql(part: str) -> str:
    p = f"PARTITION BY {part}" if part else ""
    return E + f""",
n AS (SELECT *, row_number() OVER ({p} ORDER BY time) - 1 AS pos FROM e),
c AS (SELECT *,
  last_value(value IGNORE NULLS) OVER ({p} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN time END IGNORE NULLS) OVER ({p} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
  last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER ({p} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
  first_value(value IGNORE NULLS) OVER ({p} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN value IS NOT NULL THEN time END IGNORE NULLS) OVER ({p} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER ({p} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
  FROM n)"""


@register("ts_ffill", _fill_sql("event_type") + f"""
SELECT event_id, {r6("COALESCE(value, pv)")} AS value FROM c""", ops=("A14",))
def ts_ffill(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "time", "event_type", "value")
    return clean.fill_null(ev, ["value"], "forwardfill", by=["event_type"]).select("event_id", "value")


@register("ts_bfill", _fill_sql("event_type") + f"""
SELECT event_id, {r6("COALESCE(value, nv)")} AS value FROM c""", ops=("A14",))
def ts_bfill(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "time", "event_type", "value")
    return clean.fill_null(ev, ["value"], "backfill", by=["event_type"]).select("event_id", "value")


@register("ts_ffill_global", _fill_sql("") + f"""
SELECT event_id, {r6("COALESCE(value, pv)")} AS value FROM c""", ops=("A14",))
def ts_ffill_global(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "time", "value")
    return clean.fill_null(ev, ["value"], "forwardfill").select("event_id", "value")


@register("ts_interp_linear", _fill_sql("") + f"""
SELECT event_id, {r6("COALESCE(value, CASE WHEN nv IS NULL THEN pv WHEN np = pp THEN pv "
                     "ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END)")} AS value FROM c""",
          ops=("A15",))
def ts_interp_linear(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "time", "value")
    return clean.fill_null(ev, ["value"], "linear_interpolation").select("event_id", "value")


@register("ts_interp_time", _fill_sql("event_type") + f"""
SELECT event_id, {r6("COALESCE(value, CASE WHEN nv IS NULL THEN pv WHEN nt = pt THEN pv "
                     "ELSE pv + (nv - pv) * CAST(epoch_us(time) - epoch_us(pt) AS DOUBLE) "
                     "/ CAST(epoch_us(nt) - epoch_us(pt) AS DOUBLE) END)")} AS value FROM c""",
          ops=("A15",))
def ts_interp_time(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "time", "event_type", "value")
    return clean.fill_null(ev, ["value"], "time_interpolation", by=["event_type"]).select("event_id", "value")


@register("ts_interp_nearest", _fill_sql("event_type") + f"""
SELECT event_id, {r6("COALESCE(value, CASE WHEN pv IS NULL OR nv IS NULL THEN NULL "
                     "WHEN epoch_us(time) - epoch_us(pt) <= epoch_us(nt) - epoch_us(time) THEN pv ELSE nv END)")}
       AS value FROM c""", ops=("A16",))
def ts_interp_nearest(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "time", "event_type", "value")
    return clean.fill_null(ev, ["value"], "nearest_interpolation", by=["event_type"]).select("event_id", "value")


@register("ts_log_transform", E + f"""
SELECT event_id, {r6("CASE WHEN value > 0 THEN ln(value) END")} AS value FROM e""", ops=("A18", "F09"))
def ts_log_transform(spark, sf_dir):
    return clean.log_transform(_ev(spark, sf_dir).select("event_id", "value"), ["value"])


@register("ts_winsorize", E + f""", b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM e)
SELECT event_id, {r6("CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END")} AS value
FROM e, b""", ops=("A19", "F12"))
def ts_winsorize(spark, sf_dir):
    return clean.winsorize(_ev(spark, sf_dir).select("event_id", "value"), ["value"], 0.01, 0.99)


@register("ts_time_slice", E + f"""
SELECT event_id, time, {r6("value")} AS value FROM e
WHERE time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'""", ops=("A20",))
def ts_time_slice(spark, sf_dir):
    return clean.time_slice(_ev(spark, sf_dir).select("event_id", "time", "value"),
                            dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 10, 12))


def _summary_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return E + f"""
SELECT {g}'value' AS col_name, {r6("avg(value)")} AS mean, {r6("median(value)")} AS median,
  {r6("stddev_samp(value)")} AS std, {r6("var_samp(value)")} AS var, {r6("min(value)")} AS min,
  {r6("max(value)")} AS max, {r6("max(value) - min(value)")} AS range,
  {r6("quantile_cont(value, 0.25)")} AS q1, {r6("quantile_cont(value, 0.75)")} AS q3,
  {r6("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")} AS iqr,
  {r6("CASE WHEN count(value) < 3 THEN NULL WHEN min(value) = max(value) THEN 0.0 ELSE skewness(value) END")} AS skew,
  {r6("CASE WHEN count(value) < 4 THEN NULL WHEN min(value) = max(value) THEN 0.0 ELSE kurtosis(value) END")} AS kurt,
  {r6("COALESCE(sum(value), 0.0)")} AS sum, count(value) AS count
FROM e {gb}"""


@register("ts_summary_stats", _summary_sql("event_type"), ops=("A24", "A25"))
def ts_summary_stats(spark, sf_dir):
    s = stats.summary_stats(_ev(spark, sf_dir).select("event_type", "value"), ["value"], by=["event_type"])
    return s.withColumnRenamed("column", "col_name")


@register("ts_summary_all", _summary_sql(""), ops=("A24",))
def ts_summary_all(spark, sf_dir):
    return stats.summary_stats(_ev(spark, sf_dir), ["value"]).withColumnRenamed("column", "col_name")


@register("ts_date_range", E + """
SELECT event_type, min(time) AS start, max(time) AS "end" FROM e GROUP BY event_type""", ops=("A26",))
def ts_date_range(spark, sf_dir):
    return stats.date_range_of(_ev(spark, sf_dir), "time", ["event_type"])


def _k2_sql() -> str:
    # Population moments from DuckDB's sample skewness / kurtosis (inverse of G1 / G2).
    return E + """,
m AS (SELECT event_type, CAST(count(value) AS DOUBLE) AS n, skewness(value) AS sk_s, kurtosis(value) AS ku_s,
             min(value) = max(value) AS c
      FROM e WHERE value IS NOT NULL AND time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'
      GROUP BY event_type),
g AS (SELECT *, sk_s * (n - 2) / sqrt(n * (n - 1)) AS g1,
             (ku_s * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS g2 FROM m),
s1 AS (SELECT *, CASE WHEN g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) = 0 THEN 1.0
                      ELSE g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) END AS y,
              3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
              3.0 * (n - 1) / (n + 1) AS ee,
              24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS vv,
              6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS bb
       FROM g),
s2 AS (SELECT *, -1.0 + sqrt(2.0 * (beta2 - 1)) AS w2, (g2 + 3.0 - ee) / sqrt(vv) AS x,
              6.0 + 8.0 / bb * (2.0 / bb + sqrt(1 + 4.0 / (bb * bb))) AS a FROM s1),
s3 AS (SELECT *, 1.0 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha,
              1 + x * sqrt(2.0 / (a - 4.0)) AS d FROM s2),
s4 AS (SELECT *, delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS zs,
              (1 - 2.0 / (9.0 * a) - sign(d) * pow(abs((1 - 2.0 / a) / d), 1.0 / 3.0)) / sqrt(2.0 / (9.0 * a)) AS zk
       FROM s3)
SELECT event_type, 'value' AS col_name,
  round(CASE WHEN c THEN 0.0 ELSE sk_s END, 6) + 0.0 AS skew, round(CASE WHEN c THEN 0.0 ELSE ku_s END, 6) + 0.0 AS kurt,
  round(zs, 6) + 0.0 AS z_skew, round(zk, 6) + 0.0 AS z_kurt,
  round(zs * zs + zk * zk, 6) + 0.0 AS normaltest_stat, round(exp(-(zs * zs + zk * zk) / 2), 6) + 0.0 AS normaltest_p
FROM s4"""


@register("ts_normality", _k2_sql(), ops=("A27",))
def ts_normality(spark, sf_dir):
    ev = quality.drop_null_rows(_ev(spark, sf_dir).select("time", "event_type", "value"))
    out = stats.normality_test(ev, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 20), "time",
                               ["value"], by=["event_type"])
    return out.withColumnRenamed("column", "col_name")


@register("ts_histogram", E + f""",
r AS (SELECT event_type, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
             CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
      FROM e WHERE value IS NOT NULL GROUP BY event_type),
c AS (SELECT e.event_type, least(CAST(floor((value - lo) / (hi - lo) * 30) AS BIGINT) + 1, 30) AS bin,
             count(*) AS cnt FROM e JOIN r ON e.event_type = r.event_type WHERE value IS NOT NULL GROUP BY 1, 2),
g AS (SELECT event_type, lo, hi, CAST(unnest(range(1, 31)) AS BIGINT) AS bin FROM r)
SELECT g.event_type, 'value' AS col_name, g.bin, {r6("lo + (g.bin - 1) * ((hi - lo) / 30)")} AS bin_lo,
       {r6("lo + g.bin * ((hi - lo) / 30)")} AS bin_hi, CAST(COALESCE(cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.bin = c.bin""", ops=("A28", "S29"))
def ts_histogram(spark, sf_dir):
    h = stats.histogram(_ev(spark, sf_dir).select("event_type", "value"), ["value"], 30, by=["event_type"])
    return h.withColumnRenamed("column", "col_name")


@register("ts_box_stats", E + f""",
q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3
      FROM e GROUP BY event_type)
SELECT e.event_type, 'value' AS col_name, {r6("q1")} AS q1, {r6("med")} AS median, {r6("q3")} AS q3,
  {r6("min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END)")} AS whislo,
  {r6("max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END)")} AS whishi,
  CAST(count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_fliers,
  CAST(count(*) AS BIGINT) AS n
FROM e JOIN q ON e.event_type = q.event_type WHERE value IS NOT NULL
GROUP BY e.event_type, q1, med, q3""", ops=("A29",))
def ts_box_stats(spark, sf_dir):
    b = stats.box_stats(_ev(spark, sf_dir).select("event_type", "value"), ["value"], by=["event_type"])
    return b.withColumnRenamed("column", "col_name")


@register("ts_box_fliers", E + f""",
q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e GROUP BY event_type)
SELECT e.event_type, e.event_id, 'value' AS col_name, {r6("value")} AS x FROM e JOIN q ON e.event_type = q.event_type
WHERE value < q1 - 0.25 * (q3 - q1) OR value > q3 + 0.25 * (q3 - q1)""", ops=("A29",))
def ts_box_fliers(spark, sf_dir):
    """Points beyond a quarter of the IQR (the stand-in's values are spread evenly, so none is beyond 1.5)."""
    out = stats.box_fliers(_ev(spark, sf_dir).select("event_type", "event_id", "value"), ["value"], ["event_type"], 0.25, ["event_id"])
    return out.withColumnRenamed("column", "col_name")


_REG = "CASE WHEN event_id % 11 <> 0 THEN CAST(user_id AS DOUBLE) END"


@register("ts_fill_regression", E + f""",
x AS (SELECT event_id, value AS y, {_REG} AS x FROM e),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x),
m AS (SELECT avg(y) AS m FROM x)
SELECT event_id, {r6("COALESCE(y, CASE WHEN x IS NULL THEN m ELSE a + b * x END)")} AS value FROM x, f, m""", ops=("A17",))
def ts_fill_regression(spark, sf_dir):
    """Missing values from a line over the user's number, or their mean where that is missing too."""
    df = _ev(spark, sf_dir).select("event_id", "value", F.expr(_REG).alias("user"))
    return regress.fill_regression(df, "value", ["user"]).select("event_id", "value")


_HOURLY = """h AS (SELECT date_trunc('hour', ts) AS time, event_type, avg(value) AS v FROM events GROUP BY 1, 2)"""


@register("ts_linear_fit", f"""WITH {_HOURLY},
j AS (SELECT a.time, a.v AS click, b.v AS view FROM h a JOIN h b ON a.time = b.time
      WHERE a.event_type = 'click' AND b.event_type = 'view')
SELECT {r6("CASE WHEN regr_count(view, click) > 2 THEN regr_slope(view, click) END")} AS slope,
       {r6("CASE WHEN regr_count(view, click) > 2 THEN regr_intercept(view, click) END")} AS intercept,
       {r6("CASE WHEN regr_count(view, click) > 2 THEN regr_r2(view, click) END")} AS r2,
       CAST(regr_count(view, click) AS BIGINT) AS n FROM j""", ops=("A30", "A23"))
def ts_linear_fit(spark, sf_dir):
    a = fx.hourly_series(spark, sf_dir, "click", "click")
    b = fx.hourly_series(spark, sf_dir, "view", "view")
    return stats.linear_fit(a.join(b, "time", "inner"), "click", "view")


@register("ts_align_series", f"""WITH {_HOURLY}
SELECT a.time, {r6("a.v")} AS click, {r6("b.v")} AS view FROM h a JOIN h b ON a.time = b.time
WHERE a.event_type = 'click' AND b.event_type = 'view'""", ops=("A23", "G11"))
def ts_align_series(spark, sf_dir):
    a = fx.hourly_series(spark, sf_dir, "click", "click")
    b = fx.hourly_series(spark, sf_dir, "view", "view")
    return series.align_series(a, b)


@register("ts_combine_series", f"""WITH {_HOURLY}
SELECT time, {", ".join(f"{r6(f'max(CASE WHEN event_type = {chr(39)}{t}{chr(39)} THEN v END)')} AS {t}" for t in TYPES)}
FROM h GROUP BY time""", ops=("C10",))
def ts_combine_series(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    long = ev.groupBy(F.date_trunc("hour", "ts").alias("time"), "event_type").agg(F.avg("value").alias("v"))
    return to_wide(long, "time", "event_type", "v", TYPES)


@register("ts_plot_frame", E + f"""
SELECT event_id, time, 'value' AS series, {r6("value")} AS y FROM e UNION ALL
SELECT event_id, time, 'user_id', {r6("CAST(user_id AS DOUBLE)")} FROM e""", ops=("G13",))
def ts_plot_frame(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    return series.series_frame(ev, ["value", "user_id", "not_a_column"], ["event_id", "time"])


_HOUR_US = 3600 * 1_000_000


_LONG = "value * 1000 / 9973"  # a prime: sums over long windows don't end on a digit that is rounded


def _roll_sql(hours: int = 6, by: str = "PARTITION BY event_type ", value: str = "value / 7") -> str:
    w = f"({by}ORDER BY epoch_us(time) RANGE BETWEEN {hours * _HOUR_US - 1} PRECEDING AND CURRENT ROW)"
    # Values divided by seven: no exact decimals whose rounding the order of summation would decide.
    return E.rstrip() + f""",
s AS (SELECT event_id, time, event_type, {value} AS value FROM e)
SELECT event_id, time, {r6("value")} AS value,
  {r6(f"avg(value) OVER {w}")} AS value_mean,
  {r6(f"quantile_cont(value, 0.5) OVER {w}")} AS value_median,
  {r6(f"stddev_samp(value) OVER {w}")} AS value_std, {r6(f"var_samp(value) OVER {w}")} AS value_var,
  {r6(f"min(value) OVER {w}")} AS value_min, {r6(f"max(value) OVER {w}")} AS value_max,
  {r6(f"max(value) OVER {w} - min(value) OVER {w}")} AS value_range,
  {r6(f"quantile_cont(value, 0.25) OVER {w}")} AS value_q1,
  {r6(f"quantile_cont(value, 0.75) OVER {w}")} AS value_q3,
  {r6(f"quantile_cont(value, 0.75) OVER {w} - quantile_cont(value, 0.25) OVER {w}")} AS value_iqr,
  {r6(f"CASE WHEN count(value) OVER {w} < 3 THEN NULL WHEN min(value) OVER {w} = max(value) OVER {w} THEN 0.0 ELSE skewness(value) OVER {w} END")} AS value_skew,
  {r6(f"CASE WHEN count(value) OVER {w} < 4 THEN NULL WHEN min(value) OVER {w} = max(value) OVER {w} THEN -3.0 ELSE kurtosis(value) OVER {w} END")} AS value_kurt,
  {r6(f"sum(value) OVER {w}")} AS value_sum,
  CAST(count(value) OVER {w} AS BIGINT) AS value_count
FROM s"""


def _sevenths(spark, sf_dir):
    return _ev(spark, sf_dir).select("event_id", "time", "event_type", (F.col("value") / 7).alias("value"))


@register("ts_rolling_stats", _roll_sql(), ops=("A31", "S9"))
def ts_rolling_stats(spark, sf_dir):
    return rolling.rolling_stats(_sevenths(spark, sf_dir), "6h", "time", ["value"], by=["event_type"], tie=["event_id"]).drop("event_type")


@register("ts_rolling_year", f"SELECT * FROM ({_roll_sql(365 * 24, '', _LONG)})", ops=("A31", "S9"))
def ts_rolling_year(spark, sf_dir):
    """A window of 365 days over the whole series, without keys."""
    return rolling.rolling_stats(_ev(spark, sf_dir).select("event_id", "time", F.expr(_LONG).alias("value")), "365D", "time", ["value"], tie=["event_id"])


@register("ts_rolling_ten_days", f"SELECT * FROM ({_roll_sql(240, '', _LONG)})", ops=("A31", "S9"))
def ts_rolling_ten_days(spark, sf_dir):
    return rolling.rolling_stats(_ev(spark, sf_dir).select("event_id", "time", F.expr(_LONG).alias("value")), "10D", "time", ["value"], tie=["event_id"])


@register("ts_rolling_selection", f"SELECT event_id, value_median, value_iqr, value_kurt FROM ({_roll_sql()})", ops=("A32",))
def ts_rolling_selection(spark, sf_dir):
    out = rolling.rolling_selection(_sevenths(spark, sf_dir), "6h", ["median", "iqr", "kurt"], "time", ["value"], by=["event_type"], tie=["event_id"])
    return out.drop("event_type", "time", "value")


# Repeated times: the hour of each event, ordered by event_id within it.
@register("ts_ffill_repeated_times", E + """,
h AS (SELECT event_id, date_trunc('hour', time) AS time, value FROM e)
SELECT event_id, time, round(COALESCE(value, last_value(value IGNORE NULLS) OVER (ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS ffill,
       round(COALESCE(value, first_value(value IGNORE NULLS) OVER (ORDER BY time, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS bfill
FROM h""", ops=("A14",))
def ts_ffill_repeated_times(spark, sf_dir):
    h = _ev(spark, sf_dir).select("event_id", F.date_trunc("hour", "time").alias("time"), "value")
    both = h.select("*", F.col("value").alias("ffill"), F.col("value").alias("bfill")).drop("value")
    filled = clean.fill_null(both, ["ffill"], "forwardfill", tie=["event_id"])
    return clean.fill_null(filled, ["bfill"], "backfill", tie=["event_id"])
