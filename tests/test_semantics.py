"""Semantics tests from FIXTURES part 3 (tiny literal frames, expected values worked out by hand
or with pandas, which is available as a test-time reference)."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantfold.functions.text import parse_response
from quantfold.operators import articles, asof, clean, metrics, ordered, panel, quality, quantiles, rolling, signals, stats
from quantfold.operators.quantiles import quantile_wide


def one_col(spark, values, name="v"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


@pytest.mark.parametrize("method", ["sorted", "percentile"])
def test_s1_quantiles_interpolate(spark, method):
    q = quantile_wide(one_col(spark, [1, 2, 3, 10]), ["v"], [0.01, 0.25, 0.75], method=method).first()
    assert q["q_0_01"] == pytest.approx(1.03) and q["q_0_25"] == pytest.approx(1.75)
    assert q["q_0_75"] == pytest.approx(4.75)


def test_s3_skew_kurt_bias_corrected(spark):
    r = stats.summary_stats(one_col(spark, [1, 2, 3, 10])).first()
    assert r["skew"] == pytest.approx(1.763632614803888) and r["kurt"] == pytest.approx(3.228)
    assert r["std"] == pytest.approx(pd.Series([1, 2, 3, 10]).std())


def test_s4_outlier_null_rules(spark):
    df = one_col(spark, [1, 2, None, 100]).withColumn("i", F.monotonically_increasing_id())
    z = {r["v"]: r["v__outlier"] for r in quality.outliers_zscore(df, ["v"]).collect()}
    assert z[None] is True and z[100.0] is False
    iqr = {r["v"]: r["v__outlier"] for r in quality.outliers_iqr(df, ["v"]).collect()}
    assert iqr[None] is False


def test_s5_sic_null_kept(spark):
    rows = [(k, "EQTY", "COM", "N", sic, 5.0, 1.0, 1.0, 1.0, 1.0) for k, sic in [(1, None), (2, 6000), (3, 4899)]]
    df = spark.createDataFrame(rows, "gvkey long, SecurityType string, SecuritySubType string, PrimaryExch string, "
                                     "sic int, MthPrc double, at double, sale double, ib double, csho double")
    assert sorted(r.gvkey for r in panel.panel_filter(df).collect()) == [1, 3]


def test_s11_keep_first_with_null_keys(spark):
    df = spark.createDataFrame([("s", 0, None), ("s", 1, None), ("s", 2, "x"), ("s", 3, "x")],
                               "source string, ordinal int, k string")
    got = sorted(r.ordinal for r in articles.dedup_keep_first(df, "k").collect())
    assert got == [0, 2]


def test_s14_d1_asof_unsorted_articles(spark):
    left = spark.createDataFrame([(1, dt.date(2020, 1, 3)), (2, dt.date(2020, 1, 1)), (3, dt.date(2020, 1, 2))],
                                 "id int, d date")
    right = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 1, 2),), (dt.date(2020, 1, 3),)], "t date")
    for direction in ("forward", "backward"):
        out = {r.id: r.t for r in asof.asof_join(left, right, "d", "t", direction).collect()}
        assert out == {1: dt.date(2020, 1, 3), 2: dt.date(2020, 1, 1), 3: dt.date(2020, 1, 2)}


def test_asof_strict_neighbours(spark):
    left = spark.createDataFrame([(1, 5), (2, 10), (3, 1), (4, 20)], "id int, k int")
    right = spark.createDataFrame([(4,), (10,), (15,)], "k int")
    fwd = {r.id: r.k_match for r in asof.asof_join(left, right, "k", "k", "forward", match_col="k_match").collect()}
    bwd = {r.id: r.k_match for r in asof.asof_join(left, right, "k", "k", "backward", match_col="k_match").collect()}
    assert fwd == {1: 10, 2: 10, 3: 4, 4: None} and bwd == {1: 4, 2: 10, 3: None, 4: 15}


def test_s16_macro_f1_union_of_labels(spark):
    pairs = spark.createDataFrame([("a", "a"), ("b", "c")], "actual string, predicted string")
    m = metrics.classification_metrics(pairs, labels=["a", "b", "c"]).first()
    assert m["macro_f1"] == pytest.approx((1 + 0 + 0) / 3) and m["accuracy"] == pytest.approx(0.5)


def test_s17_max_drawdown_from_first_value(spark):
    pnl = spark.createDataFrame([(1, -1.0), (2, -1.0), (3, 3.0)], "trading_date int, pnl double")
    assert signals.drawdown(pnl, "trading_date").agg(F.max("drawdown")).first()[0] == pytest.approx(1.0)


def test_s18_turnover_counts_changes_only(spark):
    w = spark.createDataFrame([(1, "X", 0.0), (2, "X", 1.0)], "trading_date int, ccy string, weight double")
    rows = signals.turnover(w).collect()
    assert len(rows) == 1 and rows[0].turnover == pytest.approx(1.0)


def _s19(spark):
    days = [1, 2, 3, 6, 7, 9]
    vals = [None, 1.0, None, None, 7.0, None]
    return spark.createDataFrame([(dt.datetime(2024, 1, d), v) for d, v in zip(days, vals)], "time timestamp, v double")


@pytest.mark.parametrize("method,expected", [
    ("linear_interpolation", [None, 1, 3, 5, 7, 7]),
    ("time_interpolation", [None, 1, 2.2, 5.8, 7, 7]),
    ("forwardfill", [None, 1, 1, 1, 7, 7]),
    ("backfill", [1, 1, 7, 7, 7, None]),
    ("nearest_interpolation", [None, 1, 1, 7, 7, None]),
])
def test_s19_fill_methods(spark, method, expected):
    for buckets in (1, 3):
        out = clean.fill_null(_s19(spark), ["v"], method, buckets=buckets).orderBy("time").collect()
        got = [r.v for r in out]
        assert [None if g is None else round(g, 9) for g in got] == expected


def test_s19_matches_pandas_on_random_series(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    n = 300
    t = pd.date_range("2024-01-01", periods=n, freq="h") + pd.to_timedelta(rng.integers(0, 50, n), unit="min")
    v = rng.normal(size=n)
    v[rng.random(n) < 0.3] = np.nan
    pdf = pd.DataFrame({"time": t, "v": v})
    df = spark.createDataFrame(pdf.astype({"v": object}).where(pdf.notna(), None))
    s = pdf.set_index("time")["v"]
    for method, ref in [("linear_interpolation", s.interpolate("linear")), ("time_interpolation", s.interpolate("time")),
                        ("forwardfill", s.ffill()), ("backfill", s.bfill())]:
        got = pd.Series([r.v for r in clean.fill_null(df, ["v"], method, buckets=7).orderBy("time").collect()],
                        dtype="float64")
        assert np.allclose(got.to_numpy(), ref.to_numpy(), equal_nan=True), method


def test_s20_parser_rules(spark):
    df = spark.createDataFrame([('a: "x",',), ("a: b: c",), ("k: 1\nk: 2",), ("",), (None,)], "r string")
    got = [r.m for r in df.select(parse_response("r").alias("m")).collect()]
    assert got[0] == {"a": 'x",'} and got[1] == {} and got[2] == {"k": "2"} and got[3] == {} and got[4] == {}


def test_s28_constant_sample(spark):
    r = stats.summary_stats(one_col(spark, [5, 5, 5, 5, 5])).first()
    assert r["skew"] == 0.0 and r["kurt"] == 0.0
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), 5.0) for h in range(5)], "time timestamp, v double")
    last = rolling.rolling_stats(ts, "1D", "time", ["v"]).orderBy("time").collect()[-1]
    assert last["v_kurt"] == -3.0 and last["v_skew"] == 0.0


def test_normality_golden(spark):
    a = stats.normality_test(one_col(spark, [2, 8, 0, 4, 1, 9, 9, 0]), cols=["v"]).first()
    assert a["z_skew"] == pytest.approx(0.44626385374197, abs=1e-9)
    b = stats.normality_test(one_col(spark, list(range(20))), cols=["v"]).first()
    assert b["z_kurt"] == pytest.approx(-1.70581041521221, abs=1e-9)
    assert b["normaltest_p"] == pytest.approx(math.exp(-b["normaltest_stat"] / 2))


def test_rolling_matches_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    n = 400
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(10**6, n, replace=False)), unit="s")
    pdf = pd.DataFrame({"time": t, "v": rng.normal(size=n).round(3)})
    out = rolling.rolling_stats(spark.createDataFrame(pdf), "6h", "time", ["v"], buckets=40)
    got = pd.DataFrame([r.asDict() for r in out.orderBy("time").collect()])
    r = pdf.set_index("time")["v"].rolling("6h", min_periods=1)
    for stat, ref in [("mean", r.mean()), ("var", r.var()), ("median", r.median()), ("q1", r.quantile(0.25)),
                      ("skew", r.skew()), ("kurt", r.kurt()), ("count", r.count())]:
        assert np.allclose(got[f"v_{stat}"].astype(float), ref.to_numpy(), equal_nan=True, atol=1e-6), stat


def test_fills_on_equal_times_match_pandas(spark):
    """The order of equal times is the tie column's, in both directions."""
    d = [dt.datetime(2024, 1, k) for k in (1, 1, 2, 2, 3)]
    pdf = pd.DataFrame({"id": range(1, 6), "time": d, "v": [None, 5.0, 7.0, None, 9.0]})
    df = spark.createDataFrame([(int(i), t.to_pydatetime(), None if pd.isna(v) else float(v)) for i, t, v in pdf.itertuples(index=False)], "id int, time timestamp, v double")
    want = {"forwardfill": pdf["v"].ffill(), "backfill": pdf["v"].bfill(), "linear_interpolation": pdf["v"].interpolate()}
    for method, ref in want.items():
        for buckets in (1, 3):
            got = {r["id"]: r["v"] for r in clean.fill_null(df, ["v"], method, buckets=buckets, tie=["id"]).collect()}
            assert [got[i] for i in range(1, 6)] == [None if pd.isna(x) else x for x in ref], (method, buckets)


def test_outlier_time_leaves_even_buckets(spark):
    base = spark.range(20_000).selectExpr("timestamp_micros(1704067200000000 + id * 1000000) AS time")
    df = base.union(spark.sql("SELECT timestamp_micros(0L) AS time"))
    sizes = [r["count"] for r in ordered.bucketize(df, "time", buckets=8).groupBy("_bk").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 20_001 / 8


def test_asof_with_repeated_right_keys_keeps_left_rows(spark):
    left = spark.createDataFrame([(1, 5), (2, 9)], "id int, k int")
    right = spark.createDataFrame([(4, "a", 1), (4, "b", 0), (8, None, 3)], "rk int, x string, y int")
    got = sorted((r["id"], r["rk"], r["x"], r["y"]) for r in asof.asof_join(left, right, "k", "rk").collect())
    assert got == [(1, 4, "b", 0), (2, 8, None, 3)]


def test_quantiles_of_a_hot_value(spark):
    df = spark.range(10_000).selectExpr("CASE WHEN id % 10 < 7 THEN 0.0D ELSE id / 7 END AS v", "id % 3 AS g", "CASE WHEN id % 2 = 0 THEN 'x' END AS h")
    pdf = df.toPandas()
    got = {(r["g"], r["h"], r["p"]): r["value"] for r in quantiles.quantiles(df, ["v"], [0.0, 0.25, 0.7, 0.705, 0.99, 1.0], by=["g", "h"]).collect()}
    for (g, h), x in pdf.groupby(["g", "h"], dropna=False)["v"]:
        for p in (0.0, 0.25, 0.7, 0.705, 0.99, 1.0):
            assert got[(g, h if isinstance(h, str) else None, p)] == pytest.approx(x.quantile(p), abs=1e-9)


def test_rolling_of_dense_data_and_ties_matches_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 40_000, 3000)), unit="s")
    pdf = pd.DataFrame({"time": t, "n": range(3000), "v": np.where(rng.random(3000) < 0.1, np.nan, rng.normal(1000, 1, 3000))})
    df = spark.createDataFrame([(a.to_pydatetime(), int(n), None if np.isnan(v) else float(v)) for a, n, v in pdf.itertuples(index=False)], "time timestamp, n int, v double")
    got = rolling.rolling_stats(df, "2h", "time", ["v"], buckets=16, tie=["n"]).toPandas().sort_values("n")
    r = pdf.set_index("time")["v"].rolling("2h", min_periods=1)
    for stat, ref in [("mean", r.mean()), ("std", r.std()), ("min", r.min()), ("max", r.max()), ("q3", r.quantile(0.75)), ("skew", r.skew()), ("sum", r.sum()), ("count", r.count())]:
        assert np.allclose(got[f"v_{stat}"].astype(float), ref.to_numpy(), equal_nan=True, atol=1e-5), stat


def test_rolling_selection_names(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "time timestamp, v double")
    assert rolling.rolling_selection(df, "1h", ["mean", "iqr"], cols=["v"]).columns == ["time", "v", "v_mean", "v_iqr"]
    for bad in ("sum", "count", "nonsense"):
        with pytest.raises(ValueError):
            rolling.rolling_selection(df, "1h", [bad], cols=["v"])


def test_weights_sum_per_side(spark):
    preds = spark.createDataFrame(
        [(i, 1, c, "future", lab) for i, (c, lab) in enumerate(
            [("A", "appreciation"), ("B", "appreciation"), ("C", "depreciation"), ("D", "unchanged")])],
        "article_id int, trading_date int, ccy string, horizon string, label string")
    w = signals.portfolio_weights(signals.sentiment_signal(signals.daily_counts(preds, ["A", "B", "C", "D", "E"])))
    r = {x.ccy: x.weight for x in w.collect()}
    assert r == {"A": 0.5, "B": 0.5, "C": -1.0, "D": 0.0, "E": 0.0}


def test_drop_null_columns_threshold(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, 1.0)], "a double, b double")
    assert quality.drop_null_columns(df, 0.5).columns == ["a"]
    with pytest.raises(ValueError):
        quality.drop_null_columns(df, 1.5)


def test_columns_in_their_order(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "n int, s string, x double")
    assert quality.columns(df) == ["n", "s", "x"] and quality.numeric_columns(df) == ["n", "x"]
    assert quality.numeric_columns(df, ["x", "missing", "s"]) == ["x"]


def test_asof_within_a_tolerance(spark):
    left = spark.createDataFrame([(1, 10), (2, 13), (3, 20), (4, 5)], "id int, k int")
    right = spark.createDataFrame([(9, "a"), (12, "b")], "k int, v string")
    got = {r["id"]: (r["m"], r["v"]) for r in asof.asof_join(left, right, "k", "k", "backward", tolerance=1, match_col="m").collect()}
    assert got == {1: (9, "a"), 2: (12, "b"), 3: (None, None), 4: (None, None)}


def test_tokenizer_gets_bounded_pieces():
    """No piece of a batch is over the bound in bytes, but for a text that is longer by itself; no row is lost."""
    import pyarrow as pa

    from quantfold.operators import tokens as TK

    texts = ["ä" * 9_000] * 100 + [None, "", "b" * (TK.PIECE + 1)] + ["c d"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "id"])
    pieces = list(TK._pieces(batch.slice(1), "text"))
    assert [i for p in pieces for i in p.column("id").to_pylist()] == list(range(1, len(texts)))
    sizes = [sum(len((t or "").encode()) for t in p.column("text").to_pylist()) for p in pieces]
    assert len(pieces) > 5 and all(n <= TK.PIECE or p.num_rows == 1 for n, p in zip(sizes, pieces))
