import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quantfold.operators import articles, prompts, quality, sampling, series, signals
from quantfold.sources import read_articles, read_rates, read_stage, read_timeseries, write_stage


def test_read_timeseries_and_stage_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="qf-src-")
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value").limit(50)
    src.write.mode("overwrite").option("header", True).csv(os.path.join(d, "ev"))
    ts = read_timeseries(spark, os.path.join(d, "ev"), "ts", schema="ts string, value double")
    assert ts.columns == ["time", "value"] and ts.count() == 50
    p = write_stage(ts, "events_stage")
    assert read_stage(spark, "events_stage").count() == 50 and "stages" in p


def test_read_rates_coerces_bad_values(spark):
    d = tempfile.mkdtemp(prefix="qf-rates-")
    spark.createDataFrame([("2020-01-01", "1.5"), ("2020-01-02", "NaN?")], "TIME_PERIOD string, OBS_VALUE string") \
        .coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(d, "usd"))
    r = read_rates(spark, {"USD": os.path.join(d, "usd")}).orderBy("date").collect()
    assert [x.value for x in r] == [1.5, None] and r[0].ccy == "USD"


def test_article_ordinals_are_file_positions(spark, tmp_path):
    rows = [(f"t{i}", "2024-01-01T00:00:00Z", f"text {i}\nsecond line, \"quoted\"", f"u{i}") for i in range(60)]
    for name, some in (("a", rows[:40]), ("b", rows[40:])):
        df = spark.createDataFrame(some, "Title string, Date string, `Full Text` string, URL string").coalesce(1)
        df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{tmp_path}/feed/{name}", mode="append")
    landed = articles.land_articles(spark, {"x": f"{tmp_path}/feed/a", "y": f"{tmp_path}/feed/b"}).collect()
    got = {r["source"]: [q["Title"] for q in sorted((q for q in landed if q["source"] == r["source"]), key=lambda q: q["ordinal"])] for r in landed}
    assert got == {"x": [f"t{i}" for i in range(40)], "y": [f"t{i}" for i in range(40, 60)]}
    assert sorted(r["ordinal"]["position"] for r in landed if r["source"] == "x") == list(range(40))
    with pytest.raises(ValueError):
        read_articles(spark, {"x": f"{tmp_path}/feed/a"}, {"x": "other"})


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from quantfold.session import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_required_columns_and_overlap(spark):
    df = spark.createDataFrame([(1, "a", None)], "n int, s string, x double")
    assert quality.columns(df) == ["n", "s", "x"]
    with pytest.raises(ValueError):
        quality.require_columns(df, ["absent"])
    with pytest.raises(TypeError):
        quality.require_columns(df, ["s"], numeric=True)
    with pytest.raises(ValueError):
        quality.assert_no_nulls(df, ["x"])
    with pytest.raises(ValueError):
        series.align_series(df.select(F.lit(1).alias("time")), df.select(F.lit(2).alias("time")))
    with pytest.raises(ValueError):
        series.series_frame(df, ["absent"], ["n"])


def test_samples_and_splits_are_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert sampling.sample_exact(df, 137, ["k"]).distinct().count() == 137
    assert sampling.sample_exact(df, 5000, ["k"]).count() == 1000
    sizes = {r["split"]: r["count"] for r in sampling.split_exact(df, 200, 0.8, ["k"]).groupBy("split").count().collect()}
    assert sizes == {"eval": 200, "train": 640, "test": 160}


def test_prompt_helpers(spark):
    table = {r["n_currencies"]: r["overhead_tokens"] for r in prompts.overhead_table(spark, [f"C{i}" for i in range(10)]).collect()}
    assert sorted(table) == [1, 2, 3, 5, 10] and len({table[2] - table[1], table[3] - table[2]}) == 1
    row = spark.range(1).select(prompts.messages(F.lit("q"), F.lit("a")).alias("m"), prompts.inst_wrap(F.lit("q")).alias("w")).first()
    assert [(x["role"], x["content"]) for x in row["m"]] == [("user", "q"), ("assistant", "a")] and row["w"] == "<s>[INST] q [/INST]"


def test_predictions_from_map(spark):
    df = spark.createDataFrame([(1, "2024-01-01", {"A_future": "appreciation"})], "id int, d string, m map<string,string>")
    got = {(r["ccy"], r["horizon"]): r["label"] for r in signals.predictions_from_map(df, "id", "d", "m", ["A", "B"]).collect()}
    assert got == {("A", "future"): "appreciation", ("A", "past"): "unchanged", ("B", "future"): "unchanged", ("B", "past"): "unchanged"}


def test_separators_are_white_space(spark):
    from quantfold.functions.text import has_min_words, strip_ws, word_count

    df = spark.createDataFrame([("a\x1cb",), ("\x1f a \u2003b c\x1d",)], "t string")
    rows = df.select(word_count("t").alias("n"), has_min_words("t", 2).alias("two"), strip_ws("t").alias("s")).collect()
    assert [(r["n"], r["two"]) for r in rows] == [(len("a\x1cb".split()), True), (3, True)] and rows[1]["s"] == "a \u2003b c"


def test_backtest_solver_is_numpy_on_sixty_features(spark):
    import numpy as np

    from quantfold.operators import backtest

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 60))
    y = x @ rng.normal(size=60) + rng.normal(size=900) + 3
    grp = np.array([f"cv{i % 5}" for i in range(600)] + ["m0"] * 150 + ["m1"] * 150)
    part = [int(g[2:]) if g.startswith("cv") else -1 for g in grp]
    rows = [(1, c, {int(g[1:]): 1} if c < 0 else None, list(map(float, a)), float(b)) for g, c, a, b in zip(grp, part, x, y)]
    df = spark.createDataFrame(rows, "fold int, cv int, times map<int,bigint>, x array<double>, y double").repartition(3)
    test = spark.createDataFrame([(1, i, "d", [float(i == j) for j in range(60)], 0.0) for i in range(-1, 60)], "fold int, gvkey int, datadate string, x array<double>, y double")
    preds, record = backtest._ridge(df, test, 60, (1e-2, 50.0), 5, 2, ("gvkey", "datadate"))
    at = {r["gvkey"]: r["y_predicted"] for r in preds.collect()}
    got = record.toPandas()

    def ridge(on, alpha):
        a = np.hstack([np.ones((on.sum(), 1)), x[on]])
        pen = np.eye(61) * alpha
        pen[0, 0] = 0
        return np.linalg.solve(a.T @ a + pen, a.T @ y[on])

    def error(on, w):
        return ((y[on] - w[0] - x[on] @ w[1:]) ** 2).mean()

    cv = np.char.startswith(grp, "cv")
    scores = {a: np.mean([error(grp == f"cv{i}", ridge(cv & (grp != f"cv{i}"), a)) for i in range(5)]) for a in (1e-2, 50.0)}
    best = min(scores, key=scores.get)
    want = np.mean([ridge(grp == m, best) for m in ("m0", "m1")], axis=0)
    assert got["best_alpha"].iloc[0] == best and abs(got["best_cv_mse"].iloc[0] - scores[best]) < 1e-8
    # The prediction at 0 is the intercept, at a unit vector the intercept and one coefficient.
    assert np.allclose([at[-1], *[at[i] - at[-1] for i in range(60)]], want, atol=1e-8)


def test_a_failed_rewrite_leaves_the_stage(spark, tmp_path):
    from quantfold.sources import read_stage, write_stage

    path = str(tmp_path / "stage")
    with pytest.raises(FileNotFoundError):
        read_stage(spark, "x", path)
    write_stage(spark.range(10), "x", path=path)
    held = read_stage(spark, "x", path)
    with pytest.raises(Exception, match="broken"):
        write_stage(spark.range(20).withColumn("id", F.when(F.col("id") == 15, F.raise_error(F.lit("broken"))).otherwise(F.col("id"))), "x", path=path)
    assert read_stage(spark, "x", path).count() == 10
    write_stage(spark.range(30).withColumn("k", F.col("id") % 3), "x", ["k"], path=path)
    assert read_stage(spark, "x", path).count() == 30 and held.count() == 10


def test_many_series_side_by_side(spark):
    from quantfold.sources import combine_series

    frames = [spark.createDataFrame([(t, float(10 * k + t)) for t in range(k, 6)] + ([(None, -1.0)] if k == 1 else []), f"time int, v{k} double") for k in range(5)]
    got = {r["time"]: r for r in combine_series(frames).collect()}
    assert set(got) == {None, 0, 1, 2, 3, 4, 5} and got[None]["v1"] == -1.0
    for t in range(6):
        assert [got[t][f"v{k}"] for k in range(5)] == [10.0 * k + t if t >= k else None for k in range(5)]
    assert sorted(r["time"] for r in combine_series(frames, how="inner").collect()) == [4, 5]
    plan = combine_series(frames)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    with pytest.raises(ValueError, match="share"):
        combine_series([frames[0], frames[0]])
