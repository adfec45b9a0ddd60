"""Queries over the news stand-ins: cleaning, mentions, dates, as-of, labels, signals,
metrics, prompts and parsing (C01-C36, F01-F20, G04-G06, U03)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as TX
from ..functions.hashing import hash_key, hash_sql
from ..operators import articles as A
from ..operators import metrics as M
from ..operators import prompts as P
from ..operators import returns as R
from ..operators import sampling as SM
from ..operators import signals as S
from ..operators import tokens
from ..operators.asof import asof_join
from ..operators.labelling import label_articles
from ..operators.observed import StageCounts
from . import fixtures as fx
from . import fixtures_sql as fsql
from ..session import materialize
from .catalog import register
from .q_fx import _SQL_HORIZON, _LABEL

CODES = fx.SERIES_CODES

# Stand-in synonym dictionary for the invented prose: each series code is
# "mentioned" when one of its substrings occurs (unanchored, case-insensitive).
STAND_SYNONYMS = {
    "S0": ["yen"], "S1": ["que"], "S2": ["und"], "S3": ["this"], "S4": ["with"],
    "S5": ["les"], "S6": ["was"], "S7": ["are"], "S8": ["der"], "S9": ["for"],
}


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _mention_sql(text: str, syn: dict[str, list[str]]) -> str:
    parts = ", ".join(
        f"CASE WHEN regexp_matches({text}, {_sql_str('(?i)(?:' + '|'.join(p) + ')')}) THEN '{c}' END"
        for c, p in syn.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


_WORDS_SQL = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"

_CLEAN_SQL = f"""
f AS (SELECT * FROM a WHERE {_WORDS_SQL.format(t='"Full Text"')} >= 20),
d1 AS (SELECT * FROM f WHERE ordinal IN (SELECT min(ordinal) FROM f GROUP BY source, "Full Text")),
d2 AS (SELECT * FROM d1 WHERE ordinal IN (SELECT min(ordinal) FROM d1 GROUP BY source, "Title")),
d3 AS (SELECT * FROM d2 WHERE ordinal IN (SELECT min(ordinal) FROM d2 GROUP BY source, "URL")),
c AS (SELECT source, ordinal, doc_id, "Title", "Date", substr("Full Text", 1, 32767) AS "Full Text", "URL" FROM d3)"""


@register("news_clean", f"""WITH a AS ({fsql.ARTICLES}),{_CLEAN_SQL}
SELECT source, doc_id, "Title" AS title, "Date" AS date, "URL" AS url,
       CAST(length("Full Text") AS BIGINT) AS text_len, md5("Full Text") AS text_md5 FROM c""",
          ops=("C02", "G06", "F01", "F02", "S11"))
def news_clean(spark, sf_dir):
    c = A.clean_articles(fx.articles(spark, sf_dir), keep=["doc_id"])
    return c.select("source", "doc_id", F.col("Title").alias("title"), F.col("Date").alias("date"),
                    F.col("URL").alias("url"), F.length("`Full Text`").cast("bigint").alias("text_len"),
                    F.md5("`Full Text`").alias("text_md5"))


@register("news_mentions", f"""
SELECT doc_id, array_to_string(m, ',') AS mentioned FROM (
  SELECT doc_id, {_mention_sql('text', TX.CURRENCY_SYNONYMS)} AS m FROM documents) WHERE len(m) > 0""",
          ops=("F08", "C03", "U01", "S15"))
def news_mentions(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    m = A.with_mentions(d, text="text")
    return m.select("doc_id", F.array_join("mentioned_currencies", ",").alias("mentioned"))


@register("news_dates", f"""
SELECT doc_id,
  date_trunc('day', timezone('America/New_York', timezone('UTC', {fsql.ARTICLE_DATE}))) AS ny_date,
  date_trunc('day', {fsql.ARTICLE_DATE}) AS pub_date
FROM documents""", ops=("F03", "F04", "F05", "F06"))
def news_dates(spark, sf_dir):
    a = fx.articles(spark, sf_dir)
    iso = F.date_format("Date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pub = F.concat(F.lit("Published "), F.date_format("Date", "M/d/yyyy, h:mm a"))
    return a.select("doc_id", D.iso_to_local_midnight(iso).cast("timestamp_ntz").alias("ny_date"),
                    D.parse_us_datetime(pub).cast("timestamp_ntz").alias("pub_date"))


_URGENT = "(SELECT DISTINCT o_orderdate AS d FROM orders WHERE o_orderpriority = '1-URGENT')"
_URGENT_BY = "(SELECT DISTINCT o_custkey, o_orderdate AS d FROM orders WHERE o_orderpriority = '1-URGENT')"


def _urgent(spark, sf_dir, by=False):
    o = fx.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    cols = (["o_custkey"] if by else []) + [F.col("o_orderdate").alias("d")]
    return o.select(*cols).distinct()


@register("asof_backward", f"""
SELECT l.o_orderkey, l.o_orderdate, r.d FROM orders l ASOF LEFT JOIN {_URGENT} r ON l.o_orderdate >= r.d""",
          ops=("C13", "S14"))
def asof_backward(spark, sf_dir):
    left = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return asof_join(left, _urgent(spark, sf_dir), "o_orderdate", "d", "backward")


@register("asof_forward", f"""
SELECT l.o_orderkey, l.o_orderdate, r.d FROM orders l ASOF LEFT JOIN {_URGENT} r ON l.o_orderdate <= r.d""",
          ops=("C12", "S14"))
def asof_forward(spark, sf_dir):
    left = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return asof_join(left, _urgent(spark, sf_dir), "o_orderdate", "d", "forward")


@register("asof_backward_tolerance", f"""
SELECT l.o_orderkey, l.o_orderdate, CASE WHEN l.o_orderdate - r.d <= INTERVAL 1 DAY THEN r.d END AS d
FROM orders l ASOF LEFT JOIN {_URGENT} r ON l.o_orderdate >= r.d""", ops=("C13",))
def asof_backward_tolerance(spark, sf_dir):
    """Matches of at most a day."""
    left = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return asof_join(left, _urgent(spark, sf_dir), "o_orderdate", "d", "backward", tolerance=dt.timedelta(days=1))


@register("asof_forward_by", f"""
SELECT l.o_orderkey, l.o_custkey, l.o_orderdate, r.d FROM orders l ASOF LEFT JOIN {_URGENT_BY} r
  ON l.o_custkey = r.o_custkey AND l.o_orderdate <= r.d""", ops=("C12", "C16"))
def asof_forward_by(spark, sf_dir):
    left = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return asof_join(left, _urgent(spark, sf_dir, True), "o_orderdate", "d", "forward", by=["o_custkey"])


@register("asof_backward_by", f"""
SELECT l.o_orderkey, l.o_custkey, l.o_orderdate, r.d FROM orders l ASOF LEFT JOIN {_URGENT_BY} r
  ON l.o_custkey = r.o_custkey AND l.o_orderdate >= r.d""", ops=("C13",))
def asof_backward_by(spark, sf_dir):
    left = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return asof_join(left, _urgent(spark, sf_dir, True), "o_orderdate", "d", "backward", by=["o_custkey"])


# --- labelled articles (section 1.7-1.8 of the reference pipeline) -------------
ART_BASE = "1995-06-01 00:00:00"


def labelled_articles(spark, sf_dir, counts=None):
    """Articles whose days spread over the six years from 1995-06-01, labelled, one wide row each."""
    art = fx.articles(spark, sf_dir).withColumn(
        "Date", F.lit(ART_BASE).cast("timestamp_ntz") + F.make_dt_interval(days=F.pmod(F.col("doc_id") * 7919, F.lit(2190)).cast("int")))
    labels = materialize(R.label_table(fx.monthly_series(spark, sf_dir), codes=CODES))  # date x code rows
    return label_articles(art, labels, CODES, STAND_SYNONYMS, keep=["doc_id"], counts=counts)


def _labelled_sql() -> str:
    fut = ", ".join(f"max(CASE WHEN ccy = '{c}' THEN future_label END) AS {c}_future_label" for c in CODES)
    pst = ", ".join(f"max(CASE WHEN ccy = '{c}' THEN past_label END) AS {c}_past_label" for c in CODES)
    cols = ", ".join([f"fw.{c}_future_label" for c in CODES] + [f"pw.{c}_past_label" for c in CODES])
    notnull = " AND ".join([f"fw.{c}_future_label IS NOT NULL" for c in CODES]
                           + [f"pw.{c}_past_label IS NOT NULL" for c in CODES])
    arts = fsql.ARTICLES.replace(fsql.ARTICLE_DATE, f"TIMESTAMP '{ART_BASE}' + to_days(CAST(doc_id * 7919 % 2190 AS INTEGER))")
    return f"""{_SQL_HORIZON},
lab AS (SELECT date, ccy,
   {_LABEL.format(p="(row_number() OVER (PARTITION BY date ORDER BY future DESC, ccy_ord) - 1)")} AS future_label,
   {_LABEL.format(p="(row_number() OVER (PARTITION BY date ORDER BY past DESC, ccy_ord) - 1)")} AS past_label
   FROM h),
fw AS (SELECT date, {fut} FROM lab GROUP BY date),
pw AS (SELECT date, {pst} FROM lab GROUP BY date),
td AS (SELECT DISTINCT date AS d FROM lab),
a AS ({arts}),{_CLEAN_SQL},
m AS (SELECT doc_id, "Title", CAST("Date" AS DATE) AS "Date", "Full Text",
             {_mention_sql('"Full Text"', STAND_SYNONYMS)} AS mentioned FROM c),
m2 AS (SELECT * FROM m WHERE len(mentioned) > 0),
af AS (SELECT m2.*, td.d AS trading_date_future FROM m2 ASOF LEFT JOIN td ON m2."Date" <= td.d),
ab AS (SELECT af.*, td.d AS trading_date_past FROM af ASOF LEFT JOIN td ON af."Date" >= td.d),
out AS (SELECT ab.doc_id, ab."Title", ab."Date", ab."Full Text", ab.mentioned, ab.trading_date_future,
               ab.trading_date_past, {cols}
        FROM ab LEFT JOIN fw ON ab.trading_date_future = fw.date LEFT JOIN pw ON ab.trading_date_past = pw.date
        WHERE ab.trading_date_future IS NOT NULL AND {notnull})"""


_LAB_COLS = ", ".join([f"{c}_future_label" for c in CODES] + [f"{c}_past_label" for c in CODES])


@register("news_labels", f"""{_labelled_sql()}
SELECT doc_id, "Date" AS date, array_to_string(mentioned, ',') AS mentioned,
       trading_date_future, trading_date_past, {_LAB_COLS} FROM out""",
          ops=("C12", "C13", "C14", "C15", "C16", "C04", "D1"))
def news_labels(spark, sf_dir):
    out = labelled_articles(spark, sf_dir)
    label_cols = [f"{c}_future_label" for c in CODES] + [f"{c}_past_label" for c in CODES]
    return out.select("doc_id", F.col("Date").alias("date"),
                      F.array_join("mentioned_currencies", ",").alias("mentioned"),
                      "trading_date_future", "trading_date_past", *label_cols)


@register("news_date_window", f"""{_labelled_sql()}
SELECT doc_id, "Date" AS date FROM out WHERE "Date" >= DATE '1996-01-01' AND "Date" < DATE '1998-07-01'""",
          ops=("C05",))
def news_date_window(spark, sf_dir):
    out = labelled_articles(spark, sf_dir)
    return A.date_window(out, dt.date(1996, 1, 1), dt.date(1998, 7, 1)).select(
        "doc_id", F.col("Date").alias("date"))


@register("news_sample", f"""
SELECT doc_id FROM documents ORDER BY {hash_sql('doc_id', '7')}, doc_id LIMIT 150""", ops=("G07",))
def news_sample(spark, sf_dir):
    return SM.sample_exact(fx.table(spark, sf_dir, "documents").select("doc_id"), 150, ["doc_id"], 7)


@register("news_split", f"""WITH r AS (
  SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('doc_id', '42')}, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents
  WHERE TIMESTAMP '2019-12-01 00:00:00' + to_hours(CAST(doc_id % 1000 AS INTEGER)) < TIMESTAMP '2020-01-01 00:00:00')
SELECT doc_id, CASE WHEN k < 200 THEN 'eval' WHEN k < 200 + floor((n - 200) * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""",
          ops=("G08",))
def news_split(spark, sf_dir):
    """200 articles for evaluation and an 80/20 split of the rest, of the articles before 2020-01-01."""
    date = F.lit("2019-12-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.pmod("doc_id", F.lit(1000)).cast("int"))
    art = fx.table(spark, sf_dir, "documents").select("doc_id", date.alias("Date"))
    old = art.where(F.col("Date") < F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    return SM.split_exact(old, 200, 0.8, ["doc_id"]).select("doc_id", "split")


@register("pred_balanced", f"""WITH p AS ({fsql.PREDICTIONS_LONG}),
r AS (SELECT article_id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('article_id', '42')}, article_id) AS k FROM p)
SELECT article_id, label FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM p GROUP BY label))""", ops=("G12",))
def pred_balanced(spark, sf_dir):
    """Every label cut to the size of the smallest."""
    return SM.balance_labels(fx.predictions_long(spark, sf_dir).select("article_id", "label"), "label", ["article_id"])


@register("prompt_targets", f"""{_labelled_sql()},
lb AS (SELECT doc_id, mentioned, MAP {{{", ".join(f"'{c}_{h}': {c}_{h}_label" for c in CODES for h in ("past", "future"))}}} AS labels FROM out)
SELECT doc_id, array_to_string(list_transform(mentioned, lambda x: x || '_past: "' || labels[x || '_past'] || '"' || chr(10)
       || x || '_future: "' || labels[x || '_future'] || '"' || chr(10)), '') AS target FROM lb""", ops=("F16",))
def prompt_targets(spark, sf_dir):
    """Training targets of labelled articles."""
    out = labelled_articles(spark, sf_dir)
    return out.select("doc_id", P.target_text("mentioned_currencies", P.label_map(CODES)).alias("target"))


@register("news_stage_counts", f"""{_labelled_sql()}
SELECT 'read' AS stage, count(*) AS n FROM a UNION ALL SELECT 'long enough', count(*) FROM f
UNION ALL SELECT 'without repeats', count(*) FROM c UNION ALL SELECT 'mentioning', count(*) FROM m2
UNION ALL SELECT 'labelled', count(*) FROM out""", ops=("C25", "C06"))
def news_stage_counts(spark, sf_dir):
    """Rows after each stage, counted while the articles are labelled once."""
    counts = StageCounts()
    labelled = labelled_articles(spark, sf_dir, counts)
    materialize(labelled.select("doc_id"))
    return counts.table(spark)


# --- responses, parsing and evaluation ---------------------------------------------
def _response_expr():
    """Deterministic stand-in model answer per article: a label per mentioned code and
    horizon from a hash; malformed (two colons / no colon) where doc_id % 5 = 0."""
    labs = F.array(*[F.lit(x) for x in TX.LABELS])

    def lab(c, h):
        return F.element_at(labs, (F.pmod(hash_key(F.col("doc_id"), c, F.lit(h)), F.lit(3)) + 1).cast("int"))

    lines = F.transform("mentioned_currencies", lambda c: F.concat(
        c, F.lit('_past: "'), lab(c, "past"), F.lit('",\n'), c, F.lit("_future: '"), lab(c, "future"),
        F.lit("'\n")))
    body = F.array_join(lines, "")
    tail = (F.when(F.col("doc_id") % 10 == 0, F.lit("note: two: colons\n"))
            .when(F.col("doc_id") % 10 == 5, F.lit("no colon here\n")).otherwise(F.lit("")))
    return F.concat(F.lit("\n"), body, tail)


def _response_sql() -> str:
    def lab(h):
        return (f"['appreciation', 'depreciation', 'unchanged']"
                f"[CAST({hash_sql('doc_id', 'x', repr(h).replace(chr(34), chr(39)))} % 3 + 1 AS INTEGER)]")
    body = (f"array_to_string(list_transform(mentioned, lambda x: x || '_past: \"' || {lab('past')} || '\",' || chr(10) "
            f"|| x || '_future: ''' || {lab('future')} || '''' || chr(10)), '')")
    tail = ("CASE WHEN doc_id % 10 = 0 THEN 'note: two: colons' || chr(10) "
            "WHEN doc_id % 10 = 5 THEN 'no colon here' || chr(10) ELSE '' END")
    return f"chr(10) || {body} || {tail}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _parsed_sql(strip_quotes: bool = True) -> str:
    label = _strip("string_split(lines[i], ':')[2]")
    if strip_quotes:
        label = f"regexp_replace(regexp_replace({label}, '^\"+|\"+$', '', 'g'), '^\'\'+|\'\'+$', '', 'g')"
    return f"""{_labelled_sql()},
resp AS (SELECT doc_id, out.* EXCLUDE (doc_id), {_response_sql()} AS response FROM out),
ln AS (SELECT doc_id, list_filter(string_split(response, chr(10)), lambda l: {_strip('l')} <> '') AS lines FROM resp),
ok AS (SELECT doc_id, lines FROM ln WHERE len(lines) > 0
       AND len(list_filter(lines, lambda l: len(string_split(l, ':')) <> 2)) = 0),
kv AS (SELECT doc_id, i, {_strip("string_split(lines[i], ':')[1]")} AS k, {label} AS v
       FROM ok, range(1, len(lines) + 1) t(i)),
last AS (SELECT doc_id, k, arg_max(v, i) AS label FROM kv GROUP BY doc_id, k)"""


def parsed_predictions(spark, sf_dir, strip_quotes=True):
    lab = labelled_articles(spark, sf_dir).withColumn("response", _response_expr())
    # Parsed once: a filter on the map would repeat the parser in the plan.
    return materialize(lab.withColumn("sentiment_predictions", TX.parse_response("response", strip_quotes)).drop("response"))


@register("parse_responses", f"""{_parsed_sql()}
SELECT doc_id, k AS key, label FROM last""", ops=("F17", "S20", "C06"))
def parse_responses(spark, sf_dir):
    p = parsed_predictions(spark, sf_dir).where(F.size("sentiment_predictions") > 0)
    return p.select("doc_id", F.explode("sentiment_predictions").alias("key", "label"))


def _pairs_sql(strip_quotes: bool = True) -> str:
    sel = " UNION ALL ".join(
        f"SELECT ok.doc_id, '{c}' AS code, '{h}' AS horizon, o.{c}_{h}_label AS actual, "
        f"COALESCE((SELECT label FROM last WHERE last.doc_id = ok.doc_id AND last.k = '{c}_{h}'), 'unchanged') AS predicted "
        f"FROM ok JOIN out o ON ok.doc_id = o.doc_id"
        for c in CODES for h in ("past", "future"))
    return f"""{_parsed_sql(strip_quotes)},
pairs AS ({sel})"""


@register("eval_pairs", f"""{_pairs_sql()}
SELECT doc_id AS id, code, horizon, actual, predicted FROM pairs""", ops=("C36", "F18", "U02", "U04"))
def eval_pairs(spark, sf_dir):
    return M.label_pairs(parsed_predictions(spark, sf_dir), "doc_id", CODES, "sentiment_predictions")


def _cls_sql(pairs: str, more: str = "") -> str:
    per = ", ".join(
        f"""{r6(f"COALESCE(sum(CASE WHEN actual = '{l}' AND predicted = '{l}' THEN 1 ELSE 0 END) / NULLIF(CAST(sum(CASE WHEN predicted = '{l}' THEN 1 ELSE 0 END) AS DOUBLE), 0), 0.0)")} AS {l}_precision,
            {r6(f"COALESCE(sum(CASE WHEN actual = '{l}' AND predicted = '{l}' THEN 1 ELSE 0 END) / NULLIF(CAST(sum(CASE WHEN actual = '{l}' THEN 1 ELSE 0 END) AS DOUBLE), 0), 0.0)")} AS {l}_recall,
            {r6(f"COALESCE((SELECT f FROM f1 WHERE label = '{l}'), 0.0)")} AS {l}_f1,
            CAST(sum(CASE WHEN actual = '{l}' THEN 1 ELSE 0 END) AS BIGINT) AS {l}_support"""
        for l in TX.LABELS)
    return f"""{pairs},
lbl AS (SELECT actual AS label FROM pairs UNION SELECT predicted FROM pairs),
pc AS (SELECT label,
         COALESCE((SELECT count(*) FROM pairs WHERE actual = label AND predicted = label) /
                  NULLIF(CAST((SELECT count(*) FROM pairs WHERE predicted = label) AS DOUBLE), 0), 0.0) AS p,
         COALESCE((SELECT count(*) FROM pairs WHERE actual = label AND predicted = label) /
                  NULLIF(CAST((SELECT count(*) FROM pairs WHERE actual = label) AS DOUBLE), 0), 0.0) AS r
       FROM lbl),
f1 AS (SELECT label, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pc),
agg AS (SELECT {r6("avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END)")} AS accuracy,
               CAST(count(*) AS BIGINT) AS n, {per} FROM pairs)
SELECT agg.*, {r6("(SELECT avg(f) FROM f1)")} AS macro_f1{more} FROM agg"""


@register("eval_metrics", _cls_sql(_pairs_sql(), ", (SELECT count(*) FROM out WHERE doc_id NOT IN (SELECT doc_id FROM ok)) AS skipped"), ops=("C20", "C22", "S16"))
def eval_metrics(spark, sf_dir):
    parsed = parsed_predictions(spark, sf_dir)
    pairs = M.label_pairs(parsed, "doc_id", CODES, "sentiment_predictions")
    return M.classification_metrics(pairs, skipped=parsed.where(F.size("sentiment_predictions") == 0))


_QPAIRS = """WITH pairs AS (
  SELECT l.doc_id AS id, 'q' || CAST(l.quality AS VARCHAR) AS actual,
         CASE WHEN d.n_chars > 15000 THEN 'q2' WHEN d.n_chars > 2000 THEN 'q1' ELSE 'q0' END AS predicted
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _quality_pairs(spark, sf_dir):
    lab = fx.table(spark, sf_dir, "labels")
    doc = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    pred = (F.when(F.col("n_chars") > 15000, "q2").when(F.col("n_chars") > 2000, "q1").otherwise("q0"))
    return lab.join(doc, "doc_id").select(F.col("doc_id").alias("id"),
                                          F.concat(F.lit("q"), F.col("quality").cast("string")).alias("actual"),
                                          pred.alias("predicted"))


_REPORT_SQL = f"""
lbl AS (SELECT actual AS label FROM pairs UNION SELECT predicted FROM pairs),
pc AS (SELECT label,
         COALESCE((SELECT count(*) FROM pairs WHERE actual = label AND predicted = label) /
                  NULLIF(CAST((SELECT count(*) FROM pairs WHERE predicted = label) AS DOUBLE), 0), 0.0) AS p,
         COALESCE((SELECT count(*) FROM pairs WHERE actual = label AND predicted = label) /
                  NULLIF(CAST((SELECT count(*) FROM pairs WHERE actual = label) AS DOUBLE), 0), 0.0) AS r,
         (SELECT count(*) FROM pairs WHERE actual = label) AS s
       FROM lbl),
rf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pc)
SELECT label, {r6("p")} AS precision, {r6("r")} AS recall, {r6("f1")} AS f1, CAST(s AS BIGINT) AS support FROM rf
UNION ALL SELECT 'accuracy', NULL, NULL, {r6("avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END)")}, count(*) FROM pairs
UNION ALL SELECT 'macro avg', {r6("avg(p)")}, {r6("avg(r)")}, {r6("avg(f1)")}, CAST(sum(s) AS BIGINT) FROM rf
UNION ALL SELECT 'weighted avg', {r6("sum(p * s) / sum(s)")}, {r6("sum(r * s) / sum(s)")},
                 {r6("sum(f1 * s) / sum(s)")}, CAST(sum(s) AS BIGINT) FROM rf"""


@register("cls_report", _QPAIRS + "," + _REPORT_SQL, ops=("C21",))
def cls_report(spark, sf_dir):
    return M.classification_report(_quality_pairs(spark, sf_dir))


@register("eval_report_quoted", _pairs_sql(False) + "," + _REPORT_SQL, ops=("F17", "C21"))
def eval_report_quoted(spark, sf_dir):
    """The report when quotes are not stripped: quoted labels are classes of their own."""
    parsed = parsed_predictions(spark, sf_dir, strip_quotes=False)
    return M.classification_report(M.label_pairs(parsed, "doc_id", CODES, "sentiment_predictions"))


@register("cls_metrics", _cls_sql(_QPAIRS).replace("'appreciation'", "'q0'").replace("'depreciation'", "'q1'")
          .replace("'unchanged'", "'q2'").replace("appreciation_", "q0_").replace("depreciation_", "q1_")
          .replace("unchanged_", "q2_"), ops=("C20",))
def cls_metrics(spark, sf_dir):
    return M.classification_metrics(_quality_pairs(spark, sf_dir), labels=["q0", "q1", "q2"])


# --- strategy over predictions -----------------------------------------------------
_PRED = f"p AS ({fsql.PREDICTIONS_LONG})"
_GRID = f"""{_PRED},
dts AS (SELECT DISTINCT trading_date FROM p),
codes AS (SELECT unnest([{", ".join(f"'{c}'" for c in CODES)}]) AS ccy),
cnt AS (SELECT trading_date, ccy, count(*) FILTER (WHERE label = 'appreciation') AS na,
               count(*) FILTER (WHERE label = 'depreciation') AS nd FROM p WHERE horizon = 'future' GROUP BY 1, 2),
g AS (SELECT dts.trading_date, codes.ccy, COALESCE(na, 0) AS na, COALESCE(nd, 0) AS nd
      FROM dts CROSS JOIN codes LEFT JOIN cnt ON dts.trading_date = cnt.trading_date AND codes.ccy = cnt.ccy),
sg AS (SELECT *, CAST(sign(na - nd) AS INTEGER) AS signal FROM g),
w AS (SELECT *, CASE WHEN signal > 0 AND sum(CASE WHEN signal > 0 THEN signal ELSE 0 END) OVER (PARTITION BY trading_date) > 0
                     THEN signal / sum(CASE WHEN signal > 0 THEN signal ELSE 0 END) OVER (PARTITION BY trading_date)
                     WHEN signal < 0 AND sum(CASE WHEN signal < 0 THEN -signal ELSE 0 END) OVER (PARTITION BY trading_date) > 0
                     THEN signal / sum(CASE WHEN signal < 0 THEN -signal ELSE 0 END) OVER (PARTITION BY trading_date)
                     ELSE 0.0 END AS weight FROM sg)"""


def _weights(spark, sf_dir):
    preds = fx.predictions_long(spark, sf_dir)
    return S.portfolio_weights(S.sentiment_signal(S.daily_counts(preds, CODES)))


@register("sig_daily_counts", f"""WITH {_GRID}
SELECT trading_date, ccy, CAST(na AS BIGINT) AS n_appreciation, CAST(nd AS BIGINT) AS n_depreciation FROM g""",
          ops=("C19", "U02"))
def sig_daily_counts(spark, sf_dir):
    return S.daily_counts(fx.predictions_long(spark, sf_dir), CODES)


@register("sig_weights", f"""WITH {_GRID}
SELECT trading_date, ccy, CAST(signal AS BIGINT) AS signal, {r6("weight")} AS weight FROM w""",
          ops=("C30", "C31", "S21", "S22", "D5"))
def sig_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("trading_date", "ccy", "signal", "weight")


_PNL = f"""{_SQL_HORIZON},
{_GRID},
nd AS (SELECT trading_date, lead(trading_date) OVER (ORDER BY trading_date) AS next_date FROM dts),
rr AS (SELECT date AS next_date, ccy, ret FROM r WHERE date IN (SELECT trading_date FROM dts)),
pnl AS (SELECT w.trading_date, sum(w.weight * rr.ret) AS pnl FROM w JOIN nd ON w.trading_date = nd.trading_date
        JOIN rr ON rr.next_date = nd.next_date AND rr.ccy = w.ccy GROUP BY w.trading_date)"""


@register("sig_pnl", f"""{_PNL}
SELECT trading_date, {r6("pnl")} AS pnl FROM pnl""", ops=("C18", "C29", "C32", "C17", "G02"))
def sig_pnl(spark, sf_dir):
    rets = R.log_returns(fx.monthly_series(spark, sf_dir))
    return S.execute_strategy(_weights(spark, sf_dir), rets)


@register("sig_drawdown", f"""{_PNL}
SELECT trading_date, {r6("pnl")} AS pnl,
  {r6("sum(pnl) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS cum_pnl,
  {r6("max(cp) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS running_max,
  {r6("max(cp) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cp")} AS drawdown
FROM (SELECT *, sum(pnl) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp FROM pnl)""",
          ops=("C27", "S17", "F10"))
def sig_drawdown(spark, sf_dir):
    rets = R.log_returns(fx.monthly_series(spark, sf_dir))
    return S.drawdown(S.execute_strategy(_weights(spark, sf_dir), rets))


@register("sig_metrics", f"""{_PNL},
dd AS (SELECT max(rm - cp) AS mdd FROM (SELECT sum(pnl) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
        max(cp0) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rm
        FROM (SELECT *, sum(pnl) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp0 FROM pnl))),
tv AS (SELECT avg(t) AS tov FROM (SELECT trading_date, sum(dw) AS t FROM
        (SELECT trading_date, abs(weight - lag(weight) OVER (PARTITION BY ccy ORDER BY trading_date)) AS dw FROM w)
        WHERE dw IS NOT NULL GROUP BY trading_date)),
b AS (SELECT avg(pnl) AS mu, stddev_samp(pnl) AS sd FROM pnl)
SELECT {r6("mu * 252 * 100")} AS annualized_return_pc, {r6("sd * sqrt(252) * 100")} AS annualized_volatility_pc,
       {r6("CASE WHEN sd * sqrt(252) <> 0 THEN mu * 252 / (sd * sqrt(252)) ELSE 0.0 END")} AS sharpe_ratio,
       {r6("mdd * 100")} AS max_drawdown_pc, {r6("tov * 252")} AS rebalancing_frequency
FROM b, dd, tv""", ops=("C23", "C24", "C33", "S18"))
def sig_metrics(spark, sf_dir):
    rets = R.log_returns(fx.monthly_series(spark, sf_dir))
    return S.run_strategy(fx.predictions_long(spark, sf_dir), rets, CODES)


@register("synth_predictions", f"""
SELECT doc_id AS article_id, c.ccy, h.horizon,
  ['appreciation', 'depreciation', 'unchanged'][CAST({hash_sql('doc_id', 'c.ccy', 'h.horizon', '42')} % 3 + 1 AS INTEGER)] AS label
FROM documents, (SELECT unnest([{", ".join(f"'{c}'" for c in CODES)}]) AS ccy) c,
     (SELECT unnest(['future', 'past']) AS horizon) h""", ops=("C35",))
def synth_predictions(spark, sf_dir):
    return S.synthetic_predictions(fx.table(spark, sf_dir, "documents"), "doc_id", CODES, 42)


# Lexicon: a frame derived from the part names' words (+1 / -1) and some function words of the documents.
_LEXICON_SQL = """SELECT word, polarity FROM (VALUES ('the', 1), ('and', 1), ('is', 1), ('with', 1), ('good', 1),
  ('of', -1), ('to', -1), ('in', -1), ('der', -1), ('que', -1)) v(word, polarity)
UNION SELECT lower(word), 1 FROM (SELECT unnest(regexp_split_to_array(p_name, '[^A-Za-z]+')) AS word FROM part) WHERE word <> ''"""


def _lexicon(spark, sf_dir):
    fixed = spark.createDataFrame([(w, 1) for w in ("the", "and", "is", "with", "good")]
                                  + [(w, -1) for w in ("of", "to", "in", "der", "que")], "word string, polarity int")
    names = fx.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", "[^A-Za-z]+")).alias("word"))
    return fixed.union(names.where("word <> ''").select(F.lower("word"), F.lit(1))).distinct()


_DICT_SQL = f"""WITH lex AS ({_LEXICON_SQL}),
w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents),
hit AS (SELECT doc_id, count(*) FILTER (WHERE polarity > 0) AS np, count(*) FILTER (WHERE polarity < 0) AS nn
        FROM w JOIN lex ON w.word = lex.word GROUP BY doc_id),
sc AS (SELECT d.doc_id, d.text, COALESCE(np, 0) AS np, COALESCE(nn, 0) AS nn,
       CASE WHEN COALESCE(np, 0) > COALESCE(nn, 0) THEN 'appreciation' WHEN COALESCE(np, 0) < COALESCE(nn, 0) THEN 'depreciation'
            ELSE 'unchanged' END AS dict_label FROM documents d LEFT JOIN hit ON d.doc_id = hit.doc_id)"""


@register("dict_sentiment", f"""{_DICT_SQL}
SELECT doc_id, CAST(np AS BIGINT) AS n_positive, CAST(nn AS BIGINT) AS n_negative, dict_label FROM sc""", ops=("C34",))
def dict_sentiment(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return S.dictionary_scores(d, "doc_id", "text", _lexicon(spark, sf_dir)).select("doc_id", "n_positive", "n_negative", "dict_label")


_DICT_PRED_SQL = f"""{_DICT_SQL},
m AS (SELECT doc_id, dict_label, unnest({_mention_sql('text', STAND_SYNONYMS)}) AS ccy FROM sc)"""


@register("dict_predictions", f"""{_DICT_PRED_SQL}
SELECT doc_id AS article_id, ccy, h.horizon, dict_label AS label FROM m, (SELECT unnest(['future', 'past']) AS horizon) h""", ops=("C34",))
def dict_predictions(spark, sf_dir):
    d = A.with_mentions(fx.table(spark, sf_dir, "documents"), STAND_SYNONYMS, text="text")
    return S.dictionary_predictions(d, "doc_id", "text", "mentioned_currencies", _lexicon(spark, sf_dir), ("future", "past"))


# --- prompts ------------------------------------------------------------------------
def _prompt_sql(title: str, text: str, arr: str) -> str:
    block = (f"array_to_string(flatten(list_transform({arr}, lambda c: [c || {_sql_str('_past: \"' + P.QUESTION + '\"')}, "
             f"c || {_sql_str('_future: \"' + P.QUESTION + '\"')}])), ',' || chr(10))")
    return (f"'Title: ' || COALESCE({title}, '') || chr(10) || 'Text: ' || COALESCE({text}, '') || "
            f"{_sql_str(chr(10) + chr(10) + P.PROMPT_INSTRUCTIONS)} || COALESCE({block}, '') || {_sql_str(P.PROMPT_TAIL)}")


@register("prompt_build", f"""WITH a AS ({fsql.ARTICLES}),{_CLEAN_SQL},
m AS (SELECT doc_id, "Title", "Full Text", {_mention_sql('"Full Text"', STAND_SYNONYMS)} AS cur FROM c),
pr AS (SELECT doc_id, {_prompt_sql('"Title"', '"Full Text"', 'cur')} AS prompt,
              array_to_string(list_transform(cur, lambda x: x || '_past: "unchanged"' || chr(10) || x || '_future: "unchanged"' || chr(10)), '') AS target
       FROM m WHERE len(cur) > 0)
SELECT doc_id, CAST(length(prompt) AS BIGINT) AS prompt_len, md5(prompt) AS prompt_md5, target FROM pr""",
          ops=("F15", "F16"))
def prompt_build(spark, sf_dir):
    c = A.clean_articles(fx.articles(spark, sf_dir), keep=["doc_id"])
    m = A.with_mentions(c, STAND_SYNONYMS)
    pr = m.select("doc_id", P.build_prompt("Title", "`Full Text`", "mentioned_currencies").alias("prompt"),
                  P.target_text("mentioned_currencies", F.create_map().cast("map<string,string>")).alias("target"))
    return pr.select("doc_id", F.length("prompt").cast("bigint").alias("prompt_len"),
                     F.md5("prompt").alias("prompt_md5"), "target")


@register("prompt_truncate", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
  CAST(length(CASE WHEN len(t) > {P.MAX_ARTICLE_TOKENS} THEN regexp_replace(array_to_string(t[1:{P.MAX_ARTICLE_TOKENS}], ''), '\\s+$', '') ELSE text END) AS BIGINT) AS trunc_len,
  md5(CASE WHEN len(t) > {P.MAX_ARTICLE_TOKENS} THEN regexp_replace(array_to_string(t[1:{P.MAX_ARTICLE_TOKENS}], ''), '\\s+$', '') ELSE text END) AS trunc_md5
FROM (SELECT doc_id, text, regexp_extract_all(text, '\\S+\\s*') AS t FROM documents)""", ops=("F19",))
def prompt_truncate(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    t = TX.truncate_tokens("text", P.MAX_ARTICLE_TOKENS)
    return d.select("doc_id", TX.token_count("text").alias("n_tokens"),
                    F.length(t).cast("bigint").alias("trunc_len"), F.md5(t).alias("trunc_md5"))


@register("prompt_overhead", f"""
WITH m AS (SELECT doc_id, {_mention_sql('text', STAND_SYNONYMS)} AS cur FROM documents),
p AS (SELECT doc_id, cur, {_prompt_sql("''", "''", 'cur')} ||
        array_to_string(list_transform(cur, lambda x: x || '_past: "unchanged"' || chr(10) || x || '_future: "unchanged"' || chr(10)), '') AS pr
      FROM m)
SELECT doc_id, CAST(len(cur) AS BIGINT) AS n_currencies, CAST(len(regexp_extract_all(pr, '\\S+\\s*')) AS BIGINT) AS overhead_tokens,
       CAST({P.MAX_SEQ_LENGTH} - len(regexp_extract_all(pr, '\\S+\\s*')) AS BIGINT) AS remaining_tokens FROM p""",
          ops=("F20",))
def prompt_overhead(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    m = A.with_mentions(d, STAND_SYNONYMS, text="text", drop_empty=False)
    n, rem = P.prompt_overhead(F.col("mentioned_currencies"))
    return m.select("doc_id", F.size("mentioned_currencies").cast("bigint").alias("n_currencies"),
                    n.alias("overhead_tokens"), rem.cast("bigint").alias("remaining_tokens"))


def _echo_scorer_factory():
    """Stand-in model for the batch contract: answers 'unchanged' for every code in the prompt."""
    import re

    pat = re.compile(r"^(\w+)_future: \"", re.M)

    def score(batch: list[str]) -> list[str]:
        return ["".join(f'{c}_future: "unchanged"\n' for c in pat.findall(t)) for t in batch]

    return score


@register("score_batches", f"""WITH a AS ({fsql.ARTICLES}),{_CLEAN_SQL},
m AS (SELECT doc_id, {_mention_sql('"Full Text"', STAND_SYNONYMS)} AS cur FROM c)
SELECT doc_id, unnest(cur) || '_future' AS key, 'unchanged' AS label FROM m WHERE len(cur) > 0""", ops=("U03",))
def score_batches(spark, sf_dir):
    c = A.clean_articles(fx.articles(spark, sf_dir), keep=["doc_id"])
    m = A.with_mentions(c, STAND_SYNONYMS)
    pr = m.select("doc_id", P.build_prompt("Title", "`Full Text`", "mentioned_currencies").alias("prompt"))
    scored = P.score_batches(pr, _echo_scorer_factory, "prompt", "response", batch_size=16)
    parsed = scored.select("doc_id", TX.parse_response("response").alias("pred"))
    return parsed.select("doc_id", F.explode("pred").alias("key", "label"))


def _file_tokenizer():
    """A public tokenizer file; where it lies is the caller's to say."""
    import public_tokenizers

    return tokens.TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))


@register("prompt_truncate_file", None, ops=("F19",))
def prompt_truncate_file(spark, sf_dir):
    """Whole texts cut at the end of the last token that fits, by a tokenizer file."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    t = tokens.truncated(d, "text", P.MAX_ARTICLE_TOKENS, _file_tokenizer())
    return t.select("doc_id", "n_tokens", F.length("truncated").cast("bigint").alias("trunc_len"), F.md5("truncated").alias("trunc_md5"))


@register("prompt_overhead_file", None, ops=("F20",))
def prompt_overhead_file(spark, sf_dir):
    """Tokens of the prompt and answer around every article by a tokenizer file, and what remains of the budget."""
    m = A.with_mentions(fx.table(spark, sf_dir, "documents"), STAND_SYNONYMS, text="text", drop_empty=False)
    return tokens.overheads(m.select("doc_id", "mentioned_currencies"), "mentioned_currencies", _file_tokenizer())
