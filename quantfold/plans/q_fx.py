"""Queries over rate series: complete cases, returns, horizons, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import returns as R
from ..session import materialize
from . import fixtures as fx
from . import fixtures_sql as fsql
from .catalog import register


def _rates(spark, sf_dir):
    return fx.monthly_series(spark, sf_dir).withColumn("ccy_ord", R.series_order(fx.SERIES_CODES))


_SQL_RETURNS = f"""
WITH s AS ({fsql.MONTHLY_SERIES}),
cc AS (SELECT date FROM s WHERE value IS NOT NULL GROUP BY date
       HAVING count(DISTINCT ccy) = (SELECT count(DISTINCT ccy) FROM s)),
r0 AS (SELECT s.date, ccy, ccy_ord, value,
              CASE WHEN value / lag(value) OVER (PARTITION BY ccy ORDER BY s.date) > 0
                   THEN ln(value / lag(value) OVER (PARTITION BY ccy ORDER BY s.date)) END AS ret
       FROM s JOIN cc ON s.date = cc.date),
rc AS (SELECT date FROM r0 WHERE ret IS NOT NULL GROUP BY date
       HAVING count(DISTINCT ccy) = (SELECT count(DISTINCT ccy) FROM r0)),
r AS (SELECT r0.* FROM r0 JOIN rc ON r0.date = rc.date)"""


@register("fx_complete_cases", f"""
WITH s AS ({fsql.MONTHLY_SERIES}),
cc AS (SELECT date FROM s WHERE value IS NOT NULL GROUP BY date
       HAVING count(DISTINCT ccy) = (SELECT count(DISTINCT ccy) FROM s))
SELECT s.date, ccy, round(value, 6) + 0.0 AS value FROM s JOIN cc ON s.date = cc.date""",
          ops=("C07", "C10"))
def fx_complete_cases(spark, sf_dir):
    return R.complete_cases(fx.monthly_series(spark, sf_dir)).select("date", "ccy", "value")


@register("fx_log_returns", f"""{_SQL_RETURNS}
SELECT date, ccy, round(ret, 6) + 0.0 AS ret FROM r""", ops=("C08",))
def fx_log_returns(spark, sf_dir):
    return R.log_returns(fx.monthly_series(spark, sf_dir)).select("date", "ccy", "ret")


_SQL_HORIZON = f"""{_SQL_RETURNS},
h0 AS (SELECT date, ccy, ccy_ord, ret,
  CASE WHEN count(ret) OVER (PARTITION BY ccy ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5
       THEN sum(ret) OVER (PARTITION BY ccy ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END AS future,
  CASE WHEN count(ret) OVER (PARTITION BY ccy ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5
       THEN sum(ret) OVER (PARTITION BY ccy ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS past
  FROM r),
hc AS (SELECT date FROM h0 WHERE future IS NOT NULL AND past IS NOT NULL GROUP BY date
       HAVING count(DISTINCT ccy) = (SELECT count(DISTINCT ccy) FROM h0)),
h AS (SELECT h0.* FROM h0 JOIN hc ON h0.date = hc.date)"""


@register("fx_horizon_sums", f"""{_SQL_HORIZON}
SELECT date, ccy, round(future, 6) + 0.0 AS future, round(past, 6) + 0.0 AS past FROM h""",
          ops=("C26", "C11"))
def fx_horizon_sums(spark, sf_dir):
    rets = R.log_returns(fx.monthly_series(spark, sf_dir))
    return R.horizon_sums(rets).select("date", "ccy", "future", "past")


_LABEL = """CASE WHEN {p} < 3 THEN 'appreciation' WHEN {p} >= 7 THEN 'depreciation'
              ELSE 'unchanged' END"""


@register("fx_rank_labels", f"""{_SQL_HORIZON}
SELECT date, ccy, round(ret, 6) + 0.0 AS ret, round(future, 6) + 0.0 AS future,
       round(past, 6) + 0.0 AS past,
       {_LABEL.format(p="(row_number() OVER (PARTITION BY date ORDER BY future DESC, ccy_ord) - 1)")} AS future_label,
       {_LABEL.format(p="(row_number() OVER (PARTITION BY date ORDER BY past DESC, ccy_ord) - 1)")} AS past_label
FROM h""", ops=("C28", "G03"))
def fx_rank_labels(spark, sf_dir):
    out = R.label_table(fx.monthly_series(spark, sf_dir), codes=fx.SERIES_CODES)
    return out.select("date", "ccy", "ret", "future", "past", "future_label", "past_label")


@register("fx_wide_labels", f"""{_SQL_HORIZON},
l AS (SELECT date, ccy,
       {_LABEL.format(p="(row_number() OVER (PARTITION BY date ORDER BY future DESC, ccy_ord) - 1)")} AS future,
       {_LABEL.format(p="(row_number() OVER (PARTITION BY date ORDER BY past DESC, ccy_ord) - 1)")} AS past
      FROM h)
SELECT date, {", ".join(f"max(CASE WHEN ccy = '{c}' THEN {h} END) AS {c}_{h}_label" for h in ("future", "past") for c in fx.SERIES_CODES)}
FROM l GROUP BY date""", ops=("G15",))
def fx_wide_labels(spark, sf_dir):
    out = materialize(R.label_table(fx.monthly_series(spark, sf_dir), codes=fx.SERIES_CODES))  # date x code rows
    future, past = (R.to_wide(out, "date", "ccy", f"{h}_label", fx.SERIES_CODES, f"_{h}_label") for h in ("future", "past"))
    return future.join(past, "date")


@register("fx_long_again", f"""{_SQL_HORIZON}
SELECT date, ccy, round(ret, 6) + 0.0 AS value FROM h""", ops=("G15",))
def fx_long_again(spark, sf_dir):
    out = materialize(R.label_table(fx.monthly_series(spark, sf_dir), codes=fx.SERIES_CODES))
    return R.from_wide(R.to_wide(out, "date", "ccy", "ret", fx.SERIES_CODES), "date", fx.SERIES_CODES)
