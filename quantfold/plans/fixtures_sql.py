"""The stand-in derivations of :mod:`quantfold.plans.fixtures` as SQL (oracle side)."""

EVENTS_SERIES = """
SELECT event_id, ts AS time, event_type, user_id,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
FROM events"""

MONTHLY_SERIES = """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
       'S' || CAST(l_suppkey % 10 AS VARCHAR) AS ccy,
       CAST(l_suppkey % 10 AS INTEGER) + 1 AS ccy_ord,
       sum(l_extendedprice) AS value
FROM lineitem GROUP BY 1, 2, 3"""

ARTICLE_DATE = "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id * 7919 % 3650 AS INTEGER)) + to_hours(CAST(doc_id % 24 AS INTEGER))"

ARTICLES = f"""
SELECT source, doc_id AS ordinal, doc_id, 'Report ' || source || ' ' || CAST(doc_id - CASE WHEN doc_id % 23 = 0 THEN 20 ELSE 0 END AS VARCHAR) AS "Title",
       {ARTICLE_DATE} AS "Date",
       text AS "Full Text", source || CAST(doc_id AS VARCHAR) AS "URL"
FROM documents"""

PREDICTIONS_LONG = """
SELECT o_orderkey AS article_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS trading_date,
       'S' || CAST(o_custkey % 10 AS VARCHAR) AS ccy, 'future' AS horizon,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'appreciation'
            WHEN substr(o_orderpriority, 1, 1) IN ('4', '5') THEN 'depreciation'
            ELSE 'unchanged' END AS label
FROM orders"""


def _maybe(expr: str, mod: int, rem: int = 0) -> str:
    return f"CASE WHEN (gvkey + fyear) % {mod} = {rem} THEN NULL ELSE {expr} END"


def _panel_sql() -> str:
    cols = {
        "gvkey": "gvkey", "datadate": "make_date(CAST(fyear AS BIGINT), 12, 31)",
        "at": "s / 997.0", "sale": "hi / 97.0", "ib": "(mu - lo) / 997.0 - 50.0",
        "csho": "CASE WHEN gvkey % 17 = 0 THEN 0.0 ELSE CAST(n AS DOUBLE) END",
        '"SecurityType"': "CASE WHEN gvkey % 13 = 0 THEN 'PREF' ELSE 'EQTY' END",
        '"SecuritySubType"': "'COM'",
        '"PrimaryExch"': "['N', 'A', 'Q', 'X'][CAST(gvkey % 4 + 1 AS INTEGER)]",
        "sic": "CASE WHEN gvkey % 11 = 0 THEN NULL ELSE CAST((gvkey * 37) % 10000 AS INTEGER) END",
        '"MthPrc"': "CASE WHEN gvkey % 19 = 0 THEN 0.5 ELSE mu / 9973.0 END",
        "ivaeq": _maybe("lo / 4999.0", 3), "ivao": _maybe("hi / 8999.0", 4),
        "act": _maybe("s / 2999.0", 5), "che": _maybe("lo / 701.0", 6), "lct": _maybe("hi / 797.0", 7),
        "dlc": _maybe("mu / 1999.0", 8), "txp": _maybe("CAST(n AS DOUBLE)", 9),
        "dp": _maybe("lo / 1499.0", 10),
        "oancf": f"CASE WHEN (gvkey + fyear) % 4 = 0 THEN 0.0 ELSE {_maybe('f / 997.0', 5, 1)} END",
        "xidoc": _maybe("mu / 9973.0", 6, 2),
    }
    extra = ["cogs", "xsga", "xint", "nopi", "txt", "xad", "xrd", "spi", "xido", "dvc", "lt",
             "ceq", "invt", "rect", "ppent", "intan", "ap", "dltt", "re"]
    for i, name in enumerate(extra):
        base = ["s", "hi", "lo", "mu"][i % 4]
        cols[name] = _maybe(f"{base} / {97.0 * (i + 1)!r} - urgent", 7 + i % 5, i % 3)
    select = ",\n       ".join(f"{e} AS {c if c.startswith(chr(34)) else chr(34) + c + chr(34)}"
                                 for c, e in cols.items())
    return f"""
SELECT {select}
FROM (SELECT o_custkey AS gvkey, year(o_orderdate) AS fyear, sum(o_totalprice) AS s,
             count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
             avg(o_totalprice) AS mu,
             sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f,
             count(CASE WHEN starts_with(o_orderpriority, '1') THEN 1 END) AS urgent
      FROM orders GROUP BY 1, 2) g"""


PANEL = _panel_sql()
