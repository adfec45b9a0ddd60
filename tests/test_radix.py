"""Radix selection against the bits of doubles and sorted values."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfold.operators import quantiles as Q
from quantfold.operators import radix


def bits(x):
    if x == 0:
        return 0
    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


def odd_doubles(rnd):
    out = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 1.0, -1.0, 0.1, 1 / 3]
    out += [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, s) for k in range(-1022, 1024, 31) for s in (0, math.inf)]
    out += [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(3000)]
    return [x for x in out if x == x]


def test_bits_are_those_of_the_double(spark):
    rows = [(x,) for x in odd_doubles(random.Random(1))]
    got = spark.createDataFrame(rows, "x double").select("x", radix.ordered_bits(F.col("x")).alias("b")).collect()
    assert all(r["b"] == bits(r["x"]) for r in got)


def frame(spark):
    rnd = random.Random(2)
    groups = {"narrow": [100 + rnd.random() for _ in range(3000)], "wide": [x for x in odd_doubles(rnd) if math.isfinite(x) and abs(x) < 1e150], "one": [7.25],
              "hot": [3.0] * 2000 + [rnd.gauss(0, 1) for _ in range(10)], "signs": [rnd.choice([-1, 1]) * rnd.choice([0.0, 1e-9, 1e9]) for _ in range(500)], None: [1.0, 2.0, 4.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("narrow", None), ("hot", math.nan), ("empty", None)]
    rnd.shuffle(rows)
    return groups, spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("limit, last", [(radix.BROADCAST_ROWS, radix.LAST_ROWS), (0, radix.LAST_ROWS), (radix.BROADCAST_ROWS, 0), (0, 0)])
def test_quantiles_of_groups(spark, monkeypatch, limit, last):
    monkeypatch.setattr(radix, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(radix, "LAST_ROWS", last)
    groups, df = frame(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in Q.quantiles(df, ["v"], probs, ["g"]).collect()}
    assert set(g for g, _ in got) == set(groups)
    for g, xs in groups.items():
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-300), (g, p)


def test_no_value_is_shuffled_or_sorted(spark):
    """What a pass shuffles are the cells of its groups."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.rand(3) + 1).alias("x"))
    cells = df.groupBy("g", F.shiftright(radix.ordered_bits(F.col("x")), 48)).count().count()
    assert cells <= 17
    text = Q.quantiles(df, ["x"], [0.5], ["g"])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in text


def test_overlapping_groups_are_counted_once_per_part(spark):
    rnd = random.Random(4)
    rows = [(y, rnd.choice("ab"), rnd.gauss(y, 5)) for y in range(2000, 2010) for _ in range(200)]
    df = spark.createDataFrame(rows, "year int, f string, x double")

    def windows(cells):
        return cells.withColumn("fold", F.explode(F.sequence(F.col("year") + 1, F.col("year") + 3))).where("fold between 2003 and 2010").drop("year")

    found = radix.select(df, ["fold", "f"], lambda n: radix.quantile_ranks([0.1, 0.9], n), base=["year", "f"], spread=windows)
    got = {(r["fold"], r["f"], r["p"]): r["value"] for r in radix.interpolated(found, ["fold", "f"]).collect()}
    for fold in range(2003, 2011):
        for f in "ab":
            xs = [x for y, g, x in rows if g == f and fold - 3 <= y < fold]
            for p in (0.1, 0.9):
                assert got[fold, f, p] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    assert len(got) == 32
