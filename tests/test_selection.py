"""Samples by threshold, stage counts, regression fills, flier rows, token budgets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfold.functions import text as TX
from quantfold.functions.hashing import hash_key
from quantfold.operators import regress, sampling, stats, tokens
from quantfold.operators.observed import StageCounts


# --- samples -----------------------------------------------------------------------------
def test_samples_are_the_smallest_hashes(spark):
    rows = [(i, random.Random(i).choice(["a", "b", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(3)
    h = {r["id"]: r["h"] for r in df.select("id", hash_key(F.col("id"), F.lit(42)).alias("h")).collect()}
    for n in (0, 1, 37, 499, 500, 900):
        got = sorted(r["id"] for r in sampling.sample_exact(df, n, ["id"]).collect())
        assert got == sorted(sorted(h, key=h.get)[:n])
    by = sampling.sample_exact(df, 20, ["id"], by=["g"]).collect()
    for g in ("a", "b", None):
        assert sorted(r["id"] for r in by if r["g"] == g) == sorted(sorted((i for i, x in rows if x == g), key=h.get)[:20])
    assert "windowgrouplimit" not in sampling.sample_exact(df, 5, ["id"])._jdf.queryExecution().toString().lower()


def test_equal_hashes_are_broken_by_ids(spark, monkeypatch):
    monkeypatch.setattr(sampling, "hash_key", lambda *a: F.lit(7).cast("bigint"))
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert [r["id"] for r in sampling.sample_exact(df, 4, ["id"]).orderBy("id").collect()] == [0, 1, 2, 3]
    split = sampling.split_exact(df, 10, 0.5, ["id"]).orderBy("id").collect()
    assert [r["split"] for r in split] == ["eval"] * 10 + ["train"] * 20 + ["test"] * 20


def test_split_sizes_and_columns(spark):
    df = spark.range(100).withColumn("x", F.lit("kept"))
    got = sampling.split_exact(df, 15, 0.8, ["id"])
    assert got.columns == ["id", "x", "split"]
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"eval": 15, "train": 68, "test": 17}
    assert {r["split"] for r in sampling.split_exact(df.limit(5), 15, 0.8, ["id"]).collect()} == {"eval"}
    assert sampling.split_exact(df.where("id < 0"), 15, 0.8, ["id"]).collect() == []


def test_balanced_labels(spark):
    rows = [(i, "abc"[min(i % 7, 2)]) for i in range(700)] + [(1000 + i, None) for i in range(9)]
    got = sampling.balance_labels(spark.createDataFrame(rows, "id long, label string"), "label", ["id"])
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {"a": 100, "b": 100, "c": 100}
    assert sampling.balance_labels(spark.createDataFrame([], "id long, label string"), "label", ["id"]).collect() == []


# --- stage counts ------------------------------------------------------------------------
def test_stage_counts(spark, tmp_path):
    counts = StageCounts()
    df = counts.mark(spark.range(1000), "read")
    df = counts.mark(df.where("id % 3 = 0"), "thirds")
    df = counts.mark(df.where("id < 0"), "none")
    df.write.parquet(str(tmp_path / "out"))
    assert counts.counts() == {"read": 1000, "thirds": 334, "none": 0}
    assert [tuple(r) for r in counts.table(spark).collect()] == [("read", 1000), ("thirds", 334), ("none", 0)]


def test_the_texts_are_read_once(spark):
    """Labelling with counts scans the articles as often as without."""
    import __spark_entry__ as entry

    from quantfold.plans import q_news

    sf = "/root/testdata/sf0.001"
    counts = StageCounts()
    labelled = q_news.labelled_articles(spark, sf, counts)
    n = labelled.count()
    got = counts.counts()
    assert got["labelled"] == n and got["read"] >= got["long enough"] >= got["without repeats"] >= got["mentioning"] >= n
    assert entry.queries()["news_stage_counts"](spark, sf).count() == 5


# --- regression --------------------------------------------------------------------------
def by_hand(rows, p, group=None):
    out = {}
    for i, r in enumerate(rows):
        if r[p] is not None:
            out[i] = r[p]
            continue
        at = [k for k in range(p) if r[k] is not None]
        fit = [q for q in rows if q[p] is not None and all(q[k] is not None for k in at) and (group is None or q[group] == r[group])]
        if not fit:
            out[i] = None
            continue
        x = np.array([[1.0] + [q[k] for k in at] for q in fit])
        w = np.linalg.lstsq(x, np.array([q[p] for q in fit]), rcond=None)[0]
        out[i] = float(w @ np.array([1.0] + [r[k] for k in at]))
    return out


@pytest.mark.parametrize("limit", [regress.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_regression_of_every_pattern(spark, monkeypatch, by, limit):
    monkeypatch.setattr(regress, "BROADCAST_ROWS", limit)
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        x = [rnd.gauss(1e4, 1), rnd.random() * 1e-3, rnd.choice([0.0, 1.0])]
        y = 3 * x[0] - 2e3 * x[1] + 5 * x[2] + rnd.gauss(0, 0.1)
        rows.append((*[None if rnd.random() < 0.3 else v for v in x], None if rnd.random() < 0.4 else y, rnd.choice(["a", "b"]), i))
    rows += [(1.0, 1.0, 1.0, None, "only gaps", 900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, g string, id int").repartition(4)
    got = {r["id"]: r["y"] for r in regress.fill_regression(df, "y", ["a", "b", "c"], by).collect()}
    want = by_hand(rows, 3, 4 if by else None)
    for i, r in enumerate(rows):
        if want[i] is None:
            assert got[r[5]] is None
        else:
            assert got[r[5]] == pytest.approx(want[i], rel=1e-6), r


def test_regression_cases(spark):
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (2.0, None), (None, None)], "x double, y double")
    assert [r["y"] for r in regress.fill_regression(flat, "y", ["x"]).collect()] == [1.0, 3.0, 2.0, 2.0]
    same = spark.createDataFrame([(float(i), float(i), 2.0 * i if i % 3 else None) for i in range(12)], "x double, z double, y double")
    assert all(r["y"] == pytest.approx(2 * r["x"]) for r in regress.fill_regression(same, "y", ["x", "z"]).collect())
    nan = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (float("nan"), None), (3.0, float("nan"))], "x double, y double")
    assert sorted(r["y"] for r in regress.fill_regression(nan, "y", ["x"]).collect()) == pytest.approx([1.0, 1.5, 2.0, 3.0])
    assert regress.fill_regression(flat.where("false"), "y", ["x"]).collect() == []
    assert [r["y"] for r in regress.fill_regression(flat.where("y is null"), "y", ["x"]).collect()] == [None, None]
    assert [r["y"] for r in regress.fill_regression(flat, "y", []).collect()] == [1.0, 3.0, 2.0, 2.0]
    odd = spark.createDataFrame([(1.0, 2.0, 9, "p"), (2.0, 4.0, 9, "q"), (3.0, None, 9, "r")], "v double, y double, _coef int, _x string")
    with pytest.raises(ValueError):
        regress.fill_regression(odd, "y", ["y"])


# --- fliers ------------------------------------------------------------------------------
def test_flier_rows(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", None]), rnd.gauss(0, 1) ** 3, 5.0) for i in range(400)] + [(900, "a", None, 5.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double, flat double")
    got = stats.box_fliers(df, ["v", "flat"], ["g"], 1.5, ["id"]).collect() + stats.box_fliers(df, ["v"], [], 1.5, ["id"]).collect()
    want = []
    for groups in ([["a"], [None]], [["a", None]]):
        for g in groups:
            xs = [(i, v) for i, h, v, _ in rows if h in g and v is not None]
            q1, q3 = np.quantile([v for _, v in xs], [0.25, 0.75])
            want += [(i, v) for i, v in xs if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)]
    assert len(want) > 20 and sorted((r["id"], r["x"]) for r in got) == sorted(want)


# --- tokens ------------------------------------------------------------------------------
TEXTS = ["", "one two  three", "Ünïcode straße 漢字 🙂 end", "x" * 300, "a\nb\tc ", None, "word " * 400]


@pytest.mark.parametrize("n", [0, 1, 3, 50, 100_000])
def test_truncation_by_a_file(spark, monkeypatch, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "PIECE", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    got = {r["id"]: r for r in tokens.truncated(df, "text", n, tokens.TokenizerFile(path)).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert (got[i]["n_tokens"], got[i]["truncated"]) == (0, None)
            continue
        code = model.encode(t, add_special_tokens=False)
        assert got[i]["n_tokens"] == len(code.ids)
        want = t if len(code.ids) <= n else t[: code.offsets[n - 1][1]] if n else ""
        assert got[i]["truncated"] == want and t.startswith(want)


def test_truncation_by_a_pattern(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    both = tokens.truncated(df, "text", 2, tokens.RegexTokens()).withColumn("jvm", TX.truncate_tokens("text", 2)).collect()
    assert all(r["truncated"] is None or r["truncated"].strip() == r["jvm"].strip() for r in both)
    with pytest.raises(ValueError, match="already"):
        tokens.counted(df.withColumn("n_tokens", F.lit(1)), "text", tokens.RegexTokens())


def test_overheads_count_distinct_lists_once(spark):
    from quantfold.operators import prompts as P

    df = spark.createDataFrame([(1, ["USD"]), (2, ["USD", "EUR"]), (3, ["USD"]), (4, [])], "id long, cur array<string>")
    got = {r["id"]: r for r in tokens.overheads(df, "cur", tokens.RegexTokens()).collect()}
    n, left = P.prompt_overhead(F.col("cur"))
    for r in df.select("id", n.alias("n"), left.alias("left")).collect():
        assert (got[r["id"]]["overhead_tokens"], got[r["id"]]["remaining_tokens"]) == (r["n"], r["left"])
    assert got[2]["n_currencies"] == 2


def test_labels_with_their_quotes(spark):
    df = spark.createDataFrame([('S0_past: "up"\nS0_future: \'down\'',)], "r string")
    assert df.select(TX.parse_response("r", strip_quotes=False).alias("m")).first()["m"] == {"S0_past": '"up"', "S0_future": "'down'"}
    assert df.select(TX.parse_response("r").alias("m")).first()["m"] == {"S0_past": "up", "S0_future": "down"}
