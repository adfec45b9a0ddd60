"""MaxScore against all inner products."""

import math

import numpy as np
import pytest

from quantfold.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_force(rows, k, modulus):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in sorted(i for i in whole if i % modulus == 0):
        own = min(whole[q])
        found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, vs in whole.items() if i != q for v in vs)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("per_round", [4096, 3])
def test_top_k(spark, per_round):
    rnd = np.random.default_rng(1)
    centre = rnd.normal(0, 0.3, (4, 16))
    rows = [(i, [float(x) for x in centre[i % 4] + rnd.normal(0, 0.05, 16)]) for i in range(-20, 3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(50)] + [(4000, [0.0] * 16), (4005, [0.5, -0.25]), (4010, []), (5, rows[9][1]), (50, rows[9][1])]
    rows += [(None, [1.0]), (6000, None), (6005, [1.0, None]), (6010, [float("nan")]), (6015, [float("inf")])]
    vectors = topk.whole_numbers(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(3))
    got = found(topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, per_round))
    assert got == by_force(rows, 5, 50)


def test_large_numbers_and_few_rows(spark):
    rows = [(0, [1e6, -3e5]), (50, [2.5e6, 1e6]), (51, [-1e6, 1e6])]
    vectors = topk.whole_numbers(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA))
    assert found(topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))) == by_force(rows, 5, 50)
    none = topk.whole_numbers(spark.createDataFrame([], SCHEMA))
    assert found(topk.top_k(none, none)) == []


def test_pruning_leaves_most_terms_unread():
    rnd = np.random.default_rng(3)
    rows = rnd.integers(-5, 5, (4000, 32))
    rows[::400] *= 50
    shard = topk.Shard(np.array([-1]), rows[:1] * 1, 5)
    for at in range(0, 4000, 500):
        shard.add(np.arange(at, at + 500), rows[at : at + 500])
    want = np.lexsort((np.arange(4000), -(rows @ rows[0])))[:5]
    assert shard.best[0][1].tolist() == want.tolist()
