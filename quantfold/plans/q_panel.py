"""Queries over the firm-year panel stand-in (orders rolled up to customer-years): filters,
features, target, folds, per-fold scaling, K-fold, bootstrap, backtest, metrics (B01-B27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_sql
from ..operators import backtest as BT
from ..operators import estimators as ES
from ..operators import folds as FD
from ..operators import metrics as M
from ..operators import panel as PN
from ..operators import stats as ST
from ..session import materialize, without_constraints
from . import fixtures as fx
from . import fixtures_sql as fsql
from .catalog import register

START, END, TRAIN_YEARS = 1975, 2019, 10


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


_FILTER_SQL = f"""p AS ({fsql.PANEL}),
f AS (SELECT * FROM p WHERE "at" IS NOT NULL AND sale IS NOT NULL AND ib IS NOT NULL AND csho IS NOT NULL
      AND "SecurityType" = 'EQTY' AND "SecuritySubType" = 'COM' AND "PrimaryExch" IN ('N', 'A', 'Q')
      AND NOT COALESCE(sic BETWEEN 6000 AND 6999, false) AND NOT COALESCE(sic BETWEEN 4900 AND 4999, false)
      AND "MthPrc" > 1)"""


def _features_sql() -> str:
    base_fill = ", ".join(f'COALESCE("{c}", 0.0) AS "{c}"' for c in PN.BASE_FEATURES if c not in ("iva", "cfo"))
    per = ", ".join(f'CASE WHEN csho = 0 THEN NULL ELSE "{c}" / csho END AS {c}_per_share' for c in PN.BASE_FEATURES)
    diffs = ", ".join(f"COALESCE({c} - lag({c}) OVER w, 0.0) AS {c}_diff" for c in PN.PER_SHARE)
    return f"""WITH {_FILTER_SQL},
d AS (SELECT *, COALESCE(ivaeq, 0) + COALESCE(ivao, 0) AS iva,
             COALESCE(act, 0) - COALESCE(che, 0) AS nca, COALESCE(lct, 0) - COALESCE(dlc, 0) - COALESCE(txp, 0) AS adj
      FROM f),
c AS (SELECT *, CASE WHEN COALESCE(oancf, 0) - COALESCE(xidoc, 0) <> 0 THEN COALESCE(oancf, 0) - COALESCE(xidoc, 0)
                     ELSE COALESCE(ib, 0) - (COALESCE(nca - lag(nca) OVER w, 0) - COALESCE(adj - lag(adj) OVER w, 0)
                                             - COALESCE(dp, 0)) END AS cfo
      FROM d WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)),
z AS (SELECT gvkey, datadate, csho, sic, ivaeq, ivao, oancf, xidoc, iva, cfo, {base_fill} FROM c),
s AS (SELECT *, {per} FROM z),
k AS (SELECT * FROM s WHERE sic IS NOT NULL AND ivaeq IS NOT NULL AND ivao IS NOT NULL AND oancf IS NOT NULL
      AND xidoc IS NOT NULL AND csho <> 0),
t AS (SELECT *, lead(ib) OVER w / NULLIF(lead(csho) OVER w, 0) AS y, {diffs}
      FROM k WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)),
mf AS (SELECT gvkey, datadate, {", ".join(PN.X_COLS)}, y FROM t WHERE y IS NOT NULL)"""


_FEAT = _features_sql()


@register("panel_filter", f"""WITH {_FILTER_SQL}
SELECT gvkey, datadate FROM f""", ops=("B02", "B03", "B04", "B05", "S5", "S6"))
def panel_filter(spark, sf_dir):
    return PN.panel_filter(fx.panel(spark, sf_dir)).select("gvkey", "datadate")


@register("panel_features", f"""{_FEAT}
SELECT gvkey, datadate, {", ".join(f"{r6(c)} AS {c}" for c in PN.X_COLS)}, {r6("y")} AS y FROM mf""",
          ops=("B06", "B07", "B08", "B09", "B10", "B11", "B19", "B20", "F11", "F14", "S7", "S23", "D12"))
def panel_features(spark, sf_dir):
    return _model_frame(spark, sf_dir)


def _model_frame(spark, sf_dir):
    with without_constraints(spark):
        return materialize(PN.model_frame(fx.panel(spark, sf_dir)))


@register("panel_year_counts", f"""{_FEAT}
SELECT CAST(year(datadate) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS count FROM mf GROUP BY 1""",
          ops=("B13", "F07"))
def panel_year_counts(spark, sf_dir):
    return ST.counts_by_year(_model_frame(spark, sf_dir))


_FOLDS_SQL = f"""{_FEAT},
ex AS (SELECT CAST(year(datadate) + i AS BIGINT) AS fold, 'train' AS role, mf.* FROM mf, range(1, {TRAIN_YEARS} + 1) r(i)
       WHERE year(datadate) + i BETWEEN {START} AND {END}
       UNION ALL SELECT CAST(year(datadate) AS BIGINT), 'test', mf.* FROM mf WHERE year(datadate) BETWEEN {START} AND {END}),
okf AS (SELECT fold FROM ex GROUP BY fold HAVING count(*) FILTER (WHERE role = 'train') > 0
        AND count(*) FILTER (WHERE role = 'test') > 0),
fo AS (SELECT * FROM ex WHERE fold IN (SELECT fold FROM okf))"""


def _folds(spark, sf_dir):
    return FD.walk_forward(_model_frame(spark, sf_dir), START, END, TRAIN_YEARS)


@register("panel_walk_forward", f"""{_FOLDS_SQL}
SELECT fold, role, gvkey, datadate FROM fo""", ops=("B17",))
def panel_walk_forward(spark, sf_dir):
    return _folds(spark, sf_dir).select("fold", "role", "gvkey", "datadate")


_SCALE_FEATURES = list(PN.X_COLS)


def _scale_sql(features) -> str:
    cols = ", ".join(features)
    return f"""{_FOLDS_SQL},
lg AS (SELECT fold, role, gvkey, datadate, feature, x FROM (SELECT fold, role, gvkey, datadate, {cols} FROM fo)
       UNPIVOT INCLUDE NULLS (x FOR feature IN ({cols}))),
qb AS (SELECT fold, feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM lg WHERE role = 'train'
       GROUP BY 1, 2),
cl AS (SELECT lg.fold, role, gvkey, datadate, lg.feature, CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END AS x
       FROM lg JOIN qb ON lg.fold = qb.fold AND lg.feature = qb.feature),
st AS (SELECT fold, feature, min(x) AS mn, max(x) AS mx FROM cl WHERE role = 'train' GROUP BY 1, 2
       HAVING var_samp(x) > 1e-8),
nt AS (SELECT fold FROM fo WHERE role = 'train' GROUP BY fold HAVING count(*) >= 10),
sc AS (SELECT cl.fold, role, gvkey, datadate, cl.feature, (x - mn) / (mx - mn) AS x
       FROM cl JOIN st ON cl.fold = st.fold AND cl.feature = st.feature WHERE cl.fold IN (SELECT fold FROM nt)),
bad AS (SELECT DISTINCT fold FROM sc WHERE x IS NULL OR isnan(x)),
sc2 AS (SELECT * FROM sc WHERE fold NOT IN (SELECT fold FROM bad)),
v2 AS (SELECT fold, feature FROM sc2 WHERE role = 'train' GROUP BY 1, 2 HAVING var_samp(x) > 1e-10),
out AS (SELECT sc2.* FROM sc2 JOIN v2 ON sc2.fold = v2.fold AND sc2.feature = v2.feature)"""


@register("panel_fold_scale", f"""{_scale_sql(_SCALE_FEATURES)}
SELECT fold, role, gvkey, datadate, feature, {r6("x")} AS x FROM out""", ops=("B14", "B15", "B18", "S24", "F12"))
def panel_fold_scale(spark, sf_dir):
    scaled = FD.fold_scale(_model_frame(spark, sf_dir), _SCALE_FEATURES, START, END, TRAIN_YEARS)
    return FD.long_features(scaled, _SCALE_FEATURES)


@register("panel_kfold", f"""{_FOLDS_SQL}
SELECT fold, gvkey, datadate,
  CAST((row_number() OVER (PARTITION BY fold ORDER BY {hash_sql('gvkey', 'datadate', '42')}) - 1) % 5 AS INTEGER) AS cv
FROM fo WHERE role = 'train'""", ops=("B21",))
def panel_kfold(spark, sf_dir):
    tr = _folds(spark, sf_dir).where(F.col("role") == "train").select("fold", "gvkey", "datadate")
    return FD.assign_kfold(tr, 5, 42).select("fold", "gvkey", "datadate", "cv")


@register("panel_bootstrap", f"""{_FOLDS_SQL},
tr AS (SELECT fold, gvkey, datadate, row_number() OVER (PARTITION BY fold ORDER BY {hash_sql('gvkey', 'datadate', '42')}) - 1 AS pos
       FROM fo WHERE role = 'train'),
n AS (SELECT fold, count(*) AS n FROM tr GROUP BY fold),
dr AS (SELECT n.fold, m.member, {hash_sql('n.fold', 'm.member', 'd.d', '42')} % n.n AS pos
       FROM n, range(0, 10) m(member), LATERAL (SELECT unnest(range(1, greatest(CAST(floor(n.n * 0.6) AS BIGINT), 1) + 1)) AS d) d),
bc AS (SELECT fold, member, pos, count(*) AS weight FROM dr GROUP BY 1, 2, 3)
SELECT bc.fold, CAST(bc.member AS INTEGER) AS member, tr.gvkey, tr.datadate, CAST(weight AS BIGINT) AS weight
FROM bc JOIN tr ON bc.fold = tr.fold AND bc.pos = tr.pos""", ops=("B22",))
def panel_bootstrap(spark, sf_dir):
    tr = _folds(spark, sf_dir).where(F.col("role") == "train").select("fold", "gvkey", "datadate")
    return FD.bootstrap(tr, 10, 0.6, 42)


@register("panel_regression_metrics", f"""{_FEAT}
SELECT CAST(year(datadate) AS INTEGER) AS year, {r6("avg((y - ib_per_share) * (y - ib_per_share))")} AS mse,
  {r6("CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - ib_per_share) * (y - ib_per_share)) / (var_pop(y) * count(*)) END")} AS r2,
  {r6("avg(abs(y - ib_per_share))")} AS mae, {r6("sqrt(avg((y - ib_per_share) * (y - ib_per_share)))")} AS rmse,
  CAST(count(*) AS BIGINT) AS n
FROM mf GROUP BY ROLLUP (year(datadate))""", ops=("B16",))
def panel_regression_metrics(spark, sf_dir):
    mf = _model_frame(spark, sf_dir)
    preds = mf.select(F.year("datadate").alias("year"), F.col("y").alias("y_actual"),
                      F.col("ib_per_share").alias("y_predicted"))
    return M.regression_metrics(preds, by="year")


@register("panel_residuals", f"""{_FEAT}
SELECT gvkey, datadate, {r6("y")} AS y_actual, {r6("ib_per_share")} AS y_predicted,
       {r6("y - ib_per_share")} AS residual
FROM mf ORDER BY {hash_sql('gvkey', 'datadate', '42')} LIMIT 1000""", ops=("B27", "G09"))
def panel_residuals(spark, sf_dir):
    mf = _model_frame(spark, sf_dir)
    preds = mf.select("gvkey", "datadate", F.col("y").alias("y_actual"), F.col("ib_per_share").alias("y_predicted"))
    return BT.residual_sample(preds, None, 1000, 42)


@register("panel_backtest", None, ops=("B23", "B24", "B25", "B26", "U05"))
def panel_backtest(spark, sf_dir):
    mf = _model_frame(spark, sf_dir)
    _, metrics = BT.rolling_backtest(mf, _SCALE_FEATURES, START, END, TRAIN_YEARS, k=5, members=10)
    return metrics



def _train_sql() -> str:
    """Scaled rows of one feature (o), train rows with their place (tr) and bootstrap draws (dr)."""
    return f"""{_scale_sql(["ib_per_share"])},
o AS (SELECT out.fold, out.role, out.gvkey, out.datadate, out.x, fo.y FROM out JOIN fo
      ON out.fold = fo.fold AND out.role = fo.role AND out.gvkey = fo.gvkey AND out.datadate = fo.datadate),
tr AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {hash_sql('gvkey', 'datadate', '42')}) - 1 AS pos FROM o WHERE role = 'train'),
n AS (SELECT fold, count(*) AS n FROM tr GROUP BY fold),
dr AS (SELECT n.fold, m.member, {hash_sql('n.fold', 'm.member', 'd.d', '42')} % n.n AS pos
       FROM n, range(0, 10) m(member), LATERAL (SELECT unnest(range(1, greatest(CAST(floor(n.n * 0.6) AS BIGINT), 1) + 1)) AS d) d)"""


def _metrics_sql(best: str) -> str:
    """The metrics of predictions pr (fold, y, p) with the record of best (fold, ..., best_cv_mse)."""
    return f"""sz AS (SELECT fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test FROM fo GROUP BY fold),
me AS (SELECT fold, avg((y - p) * (y - p)) AS mse, CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2,
              avg(abs(y - p)) AS mae, count(*) AS n FROM pr GROUP BY ROLLUP (fold))
SELECT me.fold, {r6("mse")} AS mse, {r6("r2")} AS r2, {r6("mae")} AS mae, {r6("sqrt(mse)")} AS rmse, me.n,
       {best}, {r6("best_cv_mse")} AS best_cv_mse, n_train, n_test
FROM me LEFT JOIN best ON me.fold = best.fold LEFT JOIN sz ON sz.fold = best.fold"""


def _one_sql() -> str:
    """Ridge with a free intercept on one feature, from sums: slope = Sxy / (Sxx + alpha) around the means."""
    sums = "sum({w}) AS n, sum({w} * x) AS sx, sum({w} * x * x) AS sxx, sum({w} * y) AS sy, sum({w} * x * y) AS sxy, sum({w} * y * y) AS syy"
    slope = "(sxy - sx * sy / n) / (sxx - sx * sx / n + {a})"
    return f"""{_train_sql()},
al AS (SELECT unnest([1e-5, 1e-2, 1.0]) AS alpha),
g AS (SELECT fold, pos % 5 AS cv, {sums.format(w="1.0")} FROM tr GROUP BY 1, 2),
tot AS (SELECT fold, sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy, sum(syy) AS syy FROM g GROUP BY 1),
rest AS (SELECT g.fold, g.cv, t.n - g.n AS n, t.sx - g.sx AS sx, t.sxx - g.sxx AS sxx, t.sy - g.sy AS sy, t.sxy - g.sxy AS sxy FROM g JOIN tot t ON g.fold = t.fold),
w AS (SELECT fold, cv, alpha, {slope.format(a="alpha")} AS b1, (sy - {slope.format(a="alpha")} * sx) / n AS b0 FROM rest, al WHERE n > 0),
err AS (SELECT w.fold, alpha, avg((syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n) AS mse
        FROM w JOIN g ON w.fold = g.fold AND w.cv = g.cv GROUP BY 1, 2),
best AS (SELECT fold, arg_min(alpha, mse) AS best_alpha, min(mse) AS best_cv_mse FROM err GROUP BY 1),
mb AS (SELECT dr.fold, dr.member, {sums.format(w="1.0")} FROM dr JOIN tr ON dr.fold = tr.fold AND dr.pos = tr.pos GROUP BY 1, 2),
cf AS (SELECT mb.fold, avg({slope.format(a="best_alpha")}) AS b1, avg((sy - {slope.format(a="best_alpha")} * sx) / n) AS b0 FROM mb JOIN best ON mb.fold = best.fold GROUP BY 1),
pr AS (SELECT fo.fold, fo.gvkey, fo.datadate, fo.y, cf.b0 + COALESCE(cf.b1 * out.x, 0) AS p FROM fo JOIN cf ON fo.fold = cf.fold
       LEFT JOIN out ON out.fold = fo.fold AND out.role = 'test' AND out.gvkey = fo.gvkey AND out.datadate = fo.datadate WHERE fo.role = 'test')"""


@register("panel_backtest_one", f"""{_one_sql()},
{_metrics_sql(f"{r6('best_alpha')} AS best_alpha")}""", ops=("B23", "B24", "B25", "B26", "U05"))
def panel_backtest_one(spark, sf_dir):
    """The whole backtest on one feature, whose solution SQL can write out."""
    _, metrics = BT.rolling_backtest(_model_frame(spark, sf_dir), ["ib_per_share"], START, END, TRAIN_YEARS, k=5, members=10)
    return metrics


@register("panel_predictions_one", f"""{_one_sql()}
SELECT fold, gvkey, datadate, {r6("y")} AS y_actual, {r6("p")} AS y_predicted FROM pr""", ops=("B12", "B24"))
def panel_predictions_one(spark, sf_dir):
    """The predictions of that backtest with their keys."""
    preds, _ = BT.rolling_backtest(_model_frame(spark, sf_dir), ["ib_per_share"], START, END, TRAIN_YEARS, k=5, members=10)
    return preds


@register("panel_backtest_residuals", f"""{_one_sql()}
SELECT fold, gvkey, datadate, {r6("y")} AS y_actual, {r6("p")} AS y_predicted, {r6("y - p")} AS residual
FROM pr ORDER BY {hash_sql('gvkey', 'datadate', '42')} LIMIT 1000""", ops=("B27", "G09"))
def panel_backtest_residuals(spark, sf_dir):
    """Residuals of a display sample of the backtest's predictions."""
    preds, _ = BT.rolling_backtest(_model_frame(spark, sf_dir), ["ib_per_share"], START, END, TRAIN_YEARS, k=5, members=10)
    return BT.residual_sample(preds, None, 1000, 42)


@register("panel_backtest_ridge", f"""{_one_sql()},
{_metrics_sql("CASE best_alpha WHEN 1e-5 THEN '{\"alpha\": 1e-05}' WHEN 1e-2 THEN '{\"alpha\": 0.01}' WHEN 1.0 THEN '{\"alpha\": 1.0}' END AS best_params")}""", ops=("B23", "B24", "B25", "B26", "U05"))
def panel_backtest_ridge(spark, sf_dir):
    """The same backtest with ridge regression trained through the estimator interface."""
    _, metrics = BT.rolling_backtest(_model_frame(spark, sf_dir), ["ib_per_share"], START, END, TRAIN_YEARS, k=5, members=10, estimator=ES.Ridge())
    return metrics


def _bins_sql() -> str:
    """Means of the target per bin of one feature."""
    cut = "least(bins - 1, CAST(floor({x} * bins) AS BIGINT))"
    return f"""{_train_sql()},
gr AS (SELECT * FROM (VALUES (0, 4), (1, 16)) v(g, bins)),
tb AS (SELECT fold, pos, pos % 5 AS cv, g, {cut.format(x="x")} AS bin, y FROM tr, gr),
pb AS (SELECT fold, g, cv, bin, count(*) AS n, sum(y) AS sy FROM tb GROUP BY 1, 2, 3, 4),
ab AS (SELECT fold, g, bin, sum(n) AS n, sum(sy) AS sy FROM pb GROUP BY 1, 2, 3),
al AS (SELECT fold, g, cv, sum(n) AS n, sum(sy) AS sy FROM pb GROUP BY 1, 2, 3),
tot AS (SELECT fold, g, sum(n) AS n, sum(sy) AS sy FROM al GROUP BY 1, 2),
er AS (SELECT tb.fold, tb.g, tb.cv, avg(pow(tb.y - CASE WHEN ab.n > pb.n THEN (ab.sy - pb.sy) / (ab.n - pb.n) ELSE (tot.sy - al.sy) / (tot.n - al.n) END, 2)) AS mse
       FROM tb JOIN pb USING (fold, g, cv, bin) JOIN ab USING (fold, g, bin) JOIN al USING (fold, g, cv) JOIN tot USING (fold, g) GROUP BY 1, 2, 3),
sco AS (SELECT fold, g, avg(mse) AS mse FROM er GROUP BY 1, 2),
best AS (SELECT s.fold, s.g, bins, mse AS best_cv_mse FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mse, g) AS r FROM sco) s JOIN gr USING (g) WHERE r = 1),
dm AS (SELECT dr.fold, dr.member, {cut.format(x="tr.x")} AS bin, tr.y FROM dr JOIN tr ON dr.fold = tr.fold AND dr.pos = tr.pos JOIN best ON best.fold = dr.fold),
mm AS (SELECT fold, member, avg(y) AS m FROM dm GROUP BY 1, 2),
mb AS (SELECT fold, member, bin, avg(y) AS m FROM dm GROUP BY 1, 2, 3),
te AS (SELECT o.fold, gvkey, datadate, y, {cut.format(x="x")} AS bin FROM o JOIN best ON best.fold = o.fold WHERE role = 'test'),
pr AS (SELECT te.fold, te.gvkey, te.datadate, any_value(te.y) AS y, avg(COALESCE(mb.m, mm.m)) AS p
       FROM te JOIN mm ON mm.fold = te.fold LEFT JOIN mb ON mb.fold = te.fold AND mb.member = mm.member AND mb.bin = te.bin GROUP BY 1, 2, 3)"""


@register("panel_backtest_bins", f"""{_bins_sql()},
{_metrics_sql("""'{\"bins\": ' || bins || '}' AS best_params""")}""", ops=("B23", "B24", "B25", "B26", "U05"))
def panel_backtest_bins(spark, sf_dir):
    """The backtest with an estimator that isn't linear, on one feature."""
    _, metrics = BT.rolling_backtest(_model_frame(spark, sf_dir), ["ib_per_share"], START, END, TRAIN_YEARS, k=5, members=10, estimator=ES.BinnedMeans())
    return metrics


@register("panel_backtest_mlp", None, ops=("B23", "B24", "B25", "B26", "U05"))
def panel_backtest_mlp(spark, sf_dir):
    """The backtest with bagged networks on all features."""
    _, metrics = BT.rolling_backtest(_model_frame(spark, sf_dir), _SCALE_FEATURES, START, END, TRAIN_YEARS, k=5, members=10, estimator=ES.Mlp())
    return metrics
