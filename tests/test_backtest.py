"""The rolling backtest and its estimators against plain NumPy loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfold.operators import backtest as BT
from quantfold.operators import estimators as ES
from quantfold.operators import folds as FD

FEATURES = ["a", "b", "c", "flat"]


def rows_of(seed=1, years=range(2000, 2008), firms=25):
    rnd = random.Random(seed)
    out = []
    for firm in range(firms):
        for y in years:
            a, b, c = rnd.gauss(0, 1), rnd.gauss(5, 3), rnd.random()
            out.append((firm, dt.date(y, 12, 31), a, b, c, 1.0, 2 * a - b + (c > 0.5) * 3 + rnd.gauss(0, 0.1)))
    return out


SCHEMA = "gvkey long, datadate date, a double, b double, c double, flat double, y double"


def scaled_by_hand(rows, fold, train_years):
    """``(train x, train y, test x, test y)`` of a fold, features a, b, c."""
    tr = [r for r in rows if fold - train_years <= r[1].year < fold]
    te = [r for r in rows if r[1].year == fold]
    x, z = np.array([r[2:5] for r in tr]), np.array([r[2:5] for r in te])
    lo, hi = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    return [(np.clip(v, lo, hi) - lo) / (hi - lo) for v in (x, z)], tr, te


def test_wide_scaling_is_that_of_each_fold(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = FD.fold_scale(df, FEATURES, 2003, 2010, 3).collect()
    assert {r["fold"] for r in got} == {2003, 2004, 2005, 2006, 2007}
    for fold in (2003, 2007):
        (x, z), tr, te = scaled_by_hand(rows, fold, 3)
        for role, want, keys in (("train", x, tr), ("test", z, te)):
            mine = {(r["gvkey"], r["datadate"]): r["x"] for r in got if r["fold"] == fold and r["role"] == role}
            assert len(mine) == len(keys)
            for w, k in zip(want, keys):
                assert mine[k[0], k[1]][:3] == pytest.approx(list(w), abs=1e-12) and mine[k[0], k[1]][3] is None


def test_folds_that_are_not_usable(spark):
    rows = [r for r in rows_of() if r[1].year != 2004 or r[0] < 3]
    rows[0] = (*rows[0][:3], None, *rows[0][4:])  # a missing value in 2000
    stats = FD.fold_statistics(spark.createDataFrame(rows, SCHEMA), FEATURES, 2001, 2007, 1)
    # 2001 trains on the missing value, 2005 on three rows.
    assert sorted(r["fold"] for r in stats.collect()) == [2002, 2003, 2004, 2006, 2007]
    nan = spark.createDataFrame(rows_of(2), SCHEMA).withColumn("b", F.expr("if(datadate = date'2006-12-31' and gvkey = 1, double('NaN'), b)"))
    assert sorted(r["fold"] for r in FD.fold_statistics(nan, FEATURES, 2003, 2007, 2).collect()) == [2003, 2004, 2005]
    none = FD.fold_statistics(spark.createDataFrame(rows_of(2), SCHEMA), ["flat"], 2003, 2007, 2)
    assert none.collect() == []


@pytest.mark.parametrize("block", [1 << 16, 100])
def test_draws_do_not_depend_on_blocks(spark, block):
    sizes = spark.createDataFrame([(2001, 1000), (2002, 7), (2003, 1)], "fold int, _n long")
    got = FD.draws(sizes, 3, 0.6, block=block).collect()
    by = {}
    for r in got:
        assert 0 <= r["_pos"] < {2001: 1000, 2002: 7, 2003: 1}[r["fold"]]
        by[r["fold"], r["member"]] = by.get((r["fold"], r["member"]), 0) + r["weight"]
    assert by == {(f, m): n for f, n in ((2001, 600), (2002, 4), (2003, 1)) for m in range(3)}
    assert sum(hash(tuple(r)) for r in got) == sum(hash(tuple(r)) for r in FD.draws(sizes, 3, 0.6).collect())


def test_many_draws_in_one_fold(spark):
    sizes = spark.createDataFrame([(2001, 2_000_000)], "fold int, _n long")
    got = FD.draws(sizes, 1, 0.6)
    assert got.agg(F.sum("weight")).first()[0] == 1_200_000 and got.agg(F.max("_pos")).first()[0] < 2_000_000


def by_hand(spark, rows, estimator, folds, train_years, k, members, seed=42):
    """The backtest as a loop over folds, with the library's own places and draws."""
    df = spark.createDataFrame(rows, SCHEMA)
    train = FD.numbered(FD.walk_forward(df, folds[0], folds[-1], train_years).where("role = 'train'"), seed=seed).select("fold", "gvkey", "datadate", "_pos").collect()
    place = {(r["fold"], r["gvkey"], r["datadate"]): r["_pos"] for r in train}
    out = {}
    for fold in folds:
        (x, z), tr, te = scaled_by_hand(rows, fold, train_years)
        pos = np.array([place[fold, r[0], r[1]] for r in tr])
        order = np.argsort(pos)
        x, y, pos = x[order], np.array([r[6] for r in tr])[order], pos[order]
        assert pos.tolist() == list(range(len(pos)))
        scores = []
        for params in estimator.grid:
            errors = []
            for part in range(k):
                held = pos % k == part
                m = estimator.fit(x[~held], y[~held], np.ones((~held).sum()), params, seed + part)
                errors.append(np.mean((y[held] - estimator.predict(m, x[held])) ** 2))
            scores.append(np.mean(errors))
        g = int(np.argmin(scores))
        drawn = FD.draws(spark.createDataFrame([(fold, len(x))], "fold int, _n long"), members, 0.6, seed).collect()
        preds = []
        for member in range(members):
            picked = sorted((r["_pos"], r["weight"]) for r in drawn if r["member"] == member)
            at, w = np.array([p for p, _ in picked]), np.array([n for _, n in picked], float)
            m = estimator.fit(x[at], y[at], w, estimator.grid[g], seed + 1000 + member)
            preds.append(estimator.predict(m, z))
        for r, p in zip(te, np.mean(preds, axis=0)):
            out[fold, r[0], r[1]] = p
    return out


@pytest.mark.parametrize("estimator", [ES.Ridge(), ES.BinnedMeans(), ES.Mlp(hidden=((6,), (4, 3)), epochs=15)], ids=["ridge", "bins", "mlp"])
def test_backtest_is_a_loop_over_folds(spark, estimator):
    rows = rows_of(3)
    preds, metrics = BT.rolling_backtest(spark.createDataFrame(rows, SCHEMA).repartition(3), FEATURES, 2004, 2006, 3, k=3, members=4, estimator=estimator)
    want = by_hand(spark, rows, estimator, [2004, 2005, 2006], 3, 3, 4)
    got = {(r["fold"], r["gvkey"], r["datadate"]): r["y_predicted"] for r in preds.collect()}
    assert got.keys() == want.keys()
    for key, p in want.items():
        assert got[key] == pytest.approx(p, rel=1e-9, abs=1e-9)
    record = {r["fold"]: r for r in metrics.collect()}
    assert set(record) == {None, 2004, 2005, 2006} and record[2004]["n_train"] == 75 and record[2004]["best_params"].startswith("{")


def test_ridge_from_sums_is_ridge_through_the_interface(spark):
    df = spark.createDataFrame(rows_of(4), SCHEMA).repartition(4)
    sums, m1 = BT.rolling_backtest(df, FEATURES, 2004, 2007, 3, k=3, members=4)
    rows, m2 = BT.rolling_backtest(df, FEATURES, 2004, 2007, 3, k=3, members=4, estimator=ES.Ridge())
    a = {(r["gvkey"], r["datadate"]): r["y_predicted"] for r in sums.collect()}
    b = {(r["gvkey"], r["datadate"]): r["y_predicted"] for r in rows.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-7) for k in a)
    assert {r["fold"]: r["best_alpha"] for r in m1.collect() if r["fold"]} == {r["fold"]: float(r["best_params"].split(":")[1].rstrip("}")) for r in m2.collect() if r["fold"]}


def test_a_fold_beyond_the_bound_raises(spark):
    with pytest.raises(ValueError, match="max_cells"):
        BT.rolling_backtest(spark.createDataFrame(rows_of(4), SCHEMA), FEATURES, 2004, 2005, 3, estimator=ES.Ridge(), max_cells=50)


def test_test_rows_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(5), SCHEMA)
    whole, _ = BT.rolling_backtest(df, FEATURES, 2004, 2005, 3, k=3, members=3, estimator=ES.BinnedMeans())
    whole = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(BT, "TEST_ROWS", 4)
    parts, _ = BT.rolling_backtest(df, FEATURES, 2004, 2005, 3, k=3, members=3, estimator=ES.BinnedMeans())
    assert sorted(map(tuple, parts.collect())) == whole


def test_gradients_of_the_network():
    rnd = np.random.default_rng(6)
    model = ES.Mlp.start([3, 5, 4, 1], rnd)
    x, y = rnd.normal(size=(20, 3)), rnd.normal(size=20)
    _, grads = ES.Mlp.gradients(model, x, y)
    for w, g in zip(model, grads):
        for at in list(np.ndindex(w.shape))[::3]:
            old = w[at]
            w[at] = old + 1e-6
            up, _ = ES.Mlp.gradients(model, x, y)
            w[at] = old - 1e-6
            down, _ = ES.Mlp.gradients(model, x, y)
            w[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-4, abs=1e-7)


def test_the_network_learns():
    rnd = np.random.default_rng(7)
    x = rnd.random((800, 2))
    y = np.abs(x[:, 0] - 0.5) + (x[:, 1] > 0.5)
    net = ES.Mlp(hidden=((16, 8),), epochs=80)
    model = net.fit(x, y, np.ones(800), net.grid[0], 1)
    line = ES.Ridge((1e-5,))
    flat = line.fit(x, y, np.ones(800), line.grid[0], 1)
    assert np.mean((net.predict(model, x) - y) ** 2) < 0.5 * np.mean((line.predict(flat, x) - y) ** 2)


def test_network_is_trained_step_by_step():
    """The steps of Adam, written out on each layer, give the same numbers."""
    rnd = np.random.default_rng(8)
    x, net = rnd.random((210, 5)), ES.Mlp(epochs=4, patience=2)
    y, weight = 2 * x[:, 0] - x[:, 1], rnd.integers(0, 3, 210).astype(float)
    for params in net.grid:
        got = net.fit(x, y, weight, params, 3)
        rnd = np.random.default_rng(3)
        want, step = ES.Mlp.start([5, *params["hidden"], 1], rnd), 0
        first, second = ([np.zeros_like(w) for w in want] for _ in range(2))
        for _ in range(4):
            order = rnd.permutation(np.repeat(np.arange(210), weight.astype(int)))
            for at in range(0, len(order), net.batch):
                _, grads = ES.Mlp.gradients(want, x[order[at : at + net.batch]], y[order[at : at + net.batch]])
                step += 1
                for w, g, m, v in zip(want, grads, first, second):
                    g = g + params["alpha"] * w
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= net.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(got, want))
        assert all(a.base is None for a in got)  # the model that travels is its own arrays
