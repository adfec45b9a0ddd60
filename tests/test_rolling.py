"""Rolling statistics over windows of any length against pandas and plain loops."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantfold.operators import radix, rolling

START = dt.datetime(2024, 1, 1)


def series(n, seed, span, ties=False, holes=0.1, trend=0.0, few=False):
    rnd = np.random.default_rng(seed)
    at = np.sort(rnd.integers(0, span, n)) if ties else np.sort(rnd.choice(span, n, replace=False))
    v = rnd.choice([1.0, 2.0, 2.5], n) if few else rnd.normal(0, 1, n) + trend * at
    return pd.DataFrame({"time": [START + dt.timedelta(seconds=int(s)) for s in at], "n": range(n), "v": np.where(rnd.random(n) < holes, np.nan, v)})


def compare(spark, pdf, window, buckets, parts=3, rtol=1e-6):
    rows = [(t.to_pydatetime(), int(n), None if np.isnan(v) else float(v)) for t, n, v in pdf[["time", "n", "v"]].itertuples(index=False)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "time timestamp, n int, v double").repartition(parts)
    got = rolling.rolling_stats(df, window, "time", ["v"], buckets=buckets, tie=["n"]).toPandas().sort_values("n")
    assert len(got) == len(pdf)
    x = pdf.set_index("time")["v"]
    r = x.rolling(window, min_periods=1)
    low, high, count = r.min(), r.max(), r.count()
    want = {"mean": r.mean(), "median": r.median(), "min": low, "max": high, "range": high - low, "q1": r.quantile(0.25), "q3": r.quantile(0.75), "iqr": r.quantile(0.75) - r.quantile(0.25),
            "sum": r.sum().where(count > 0), "count": count}
    for stat, ref in want.items():
        assert np.allclose(got[f"v_{stat}"].astype(float), ref.to_numpy(), equal_nan=True, rtol=rtol, atol=1e-9), stat
    w = pd.Timedelta(window)
    for i in range(0, len(pdf), max(1, len(pdf) // 60)):  # moments straight from the window's values
        t = pdf["time"].iloc[i]
        own = pdf.iloc[: i + 1]
        own = own[own["time"] > t - w]["v"].dropna().to_numpy()
        row = got.iloc[i]
        if len(own) > 1:
            assert row["v_var"] == pytest.approx(own.var(ddof=1), rel=rtol, abs=1e-12)
        if len(own) > 3 and own.min() < own.max():
            assert row["v_skew"] == pytest.approx(pd.Series(own).skew(), rel=1e-5, abs=1e-7)
            assert row["v_kurt"] == pytest.approx(pd.Series(own).kurt(), rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("window", ["30s", "2h", "1D", "3D", "365D"])
@pytest.mark.parametrize("limit", [500_000, 0])
def test_windows_of_any_length(spark, monkeypatch, window, limit):
    monkeypatch.setattr(rolling, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(radix, "BROADCAST_ROWS", limit)
    compare(spark, series(900, 1, 400_000), window, 12)


@pytest.mark.parametrize("case", [dict(ties=True, span=3000), dict(span=400_000, trend=0.01), dict(span=400_000, few=True), dict(span=400_000, holes=0.95)])
def test_odd_series(spark, case):
    compare(spark, series(800, 2, **case), "1D" if case["span"] > 3000 else "10min", 9)


def test_dense_and_sparse_stretches(spark):
    dense, sparse = series(600, 3, 3600), series(60, 4, 10_000_000)
    pdf = pd.concat([dense, sparse]).sort_values("time", kind="stable").reset_index(drop=True)
    pdf["n"] = range(len(pdf))
    compare(spark, pdf, "5D", 20)
    compare(spark, pdf, "200D", 20)


def test_groups_undated_rows_and_clashing_names(spark):
    rnd = random.Random(5)
    rows = [(START + dt.timedelta(minutes=i), rnd.choice(["a", "a", "a", "b", None]), rnd.random(), i, 7.0) for i in range(400)] + [(None, "a", 1.0, 900, 7.0)]
    df = spark.createDataFrame(rows, "time timestamp, g string, v double, _b long, column double")
    got = rolling.rolling_stats(df, "2h", "time", ["v", "column"], by=["g"], stats=["count", "median", "kurt"], buckets=10)
    assert got.columns == ["time", "g", "v", "_b", "column", "v_median", "v_kurt", "v_count", "column_median", "column_kurt", "column_count"]
    pdf = got.toPandas()
    for g in ("a", "b", None):
        own = pd.DataFrame([r for r in rows if r[1] == g and r[0]], columns=["time", "g", "v", "n", "c"])
        mine = pdf[(pdf["g"] == g if g else pdf["g"].isna()) & pdf["time"].notna()].sort_values("_b")
        r = own.set_index("time")["v"].rolling("2h", min_periods=1)
        assert np.allclose(mine["v_median"].astype(float), r.median()) and np.allclose(mine["v_count"], r.count())
        assert (mine["column_median"] == 7.0).all()
        assert np.allclose(mine["column_kurt"].astype(float), np.where(r.count() > 3, -3.0, np.nan), equal_nan=True)
    undated = pdf[pdf["time"].isna()]
    assert len(undated) == 1 and undated["v_count"].iloc[0] == 0 and pd.isna(undated["v_median"].iloc[0])
    assert rolling.rolling_stats(df.where("false"), "2h", "time", ["v"]).collect() == []


def test_covered_buckets_are_few_nodes():
    plan = rolling.Buckets([1.0 * i for i in range(250, 4000, 250)], 0, 3999, 10**9)
    assert len(plan.low) == 16 and all(plan.covered[k] == 0 for k in range(16))
    for k in range(16):
        assert len(plan.nodes(k)) <= 8
        assert sorted(s for level, v in plan.nodes(k) for s in range(v << level, (v + 1) << level)) == list(range(k))


def test_a_task_is_given_little_of_a_long_window(spark, monkeypatch):
    """A window over all rows: what a bucket's task is told of the rows before is a few times its own rows."""
    n, buckets, kept = 6000, 30, []
    real = rolling._covered
    monkeypatch.setattr(rolling, "_covered", lambda *a: kept.append(real(*a)) or kept[0])
    rnd = random.Random(7)
    df = spark.createDataFrame([(START + dt.timedelta(minutes=i), rnd.gauss(0, 1)) for i in range(n)], "time timestamp, v double")
    rolling.rolling_stats(df, "365D", "time", ["v"], buckets=buckets).collect()
    told = {r["_b"]: r["count"] for r in kept[0].groupBy("_b").count().collect()}
    assert len(told) == buckets - 1 and max(told.values()) <= 12 * n / buckets


def test_buckets_and_their_edges():
    rnd = random.Random(6)
    for _ in range(300):
        times = sorted(rnd.randint(0, 2000) for _ in range(60))
        w = rnd.choice([1, 2, 5, 50, 400, 5000])
        plan = rolling.Buckets(sorted({times[i] + 0.0 for i in range(0, 60, rnd.choice([3, 7, 20]))}), times[0], times[-1], w)
        where = lambda t: sum(c <= t for c in plan.cuts)
        users = {s: (a, z) for s, a, z in rolling._users(plan)}
        for k in range(len(plan.low)):
            own = [t for t in times if where(t) == k]
            for t in own:
                for u in times:
                    if t - w < u <= t:
                        s = where(u)
                        assert plan.edge[k] <= s <= k
                    if plan.covered[k] <= where(u) < k:
                        assert t - w < u <= t
            for s in range(len(plan.low)):
                inside = plan.covered[k] <= s < k
                assert inside == (s in users and users[s][0] <= k <= users[s][1])
