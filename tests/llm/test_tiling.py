"""Greedy string tiling on planted passages, and tiles against a plain greedy search."""

import random

import pytest

from quantfold.llm import tiling

rnd = random.Random(4)
VOCAB = [f"v{i}" for i in range(3000)]
ITEMS = [(i, " ".join(rnd.choice(VOCAB) for _ in range(30))) for i in range(12)] + [(90, "too short"), (91, None), (92, ""), (None, "a b c d e f g")]


def filler(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def greedy(a, b, size):
    """Longest match first over all positions, ties by item then text position."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for p in range(len(a)):
                n = 0
                while p + n < len(a) and j + n < len(b) and a[p + n] == b[j + n] and not ma[p + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, p)
        n, j, p = best
        if n < size:
            return sum(x for _, _, x in out), out
        ma[p : p + n] = [True] * n
        mb[j : j + n] = [True] * n
        out.append((p, j, n))


def test_tiles_are_greedy():
    for seed in range(60):
        r = random.Random(seed)
        b = [r.choice("abc") for _ in range(14)]
        a = [r.choice("abc") for _ in range(10)] + b[6:12] + [r.choice("abc")] + b[:7]
        seeds = [(p, j) for p in range(len(a) - 2) for j in range(len(b) - 2) if a[p : p + 3] == b[j : j + 3]]
        assert tiling.tiles(seeds, 3) == greedy(a, b, 3)[1]


@pytest.mark.parametrize("block_words", [10**6, 100])
def test_planted(spark, frame, block_words):
    w = ITEMS[3][1].split()
    docs = {0: filler(200), 1: f"{filler(50)} {ITEMS[0][1]} {filler(50)}", 2: f"{ITEMS[1][1].upper().replace(' ', ', ')}.", 3: " ".join([*w[20:], "x", *w[10:20], "y", *w[:10]]),
            4: " ".join(w[:15]), 5: None, 6: "", 7: "too short", 8: f"{ITEMS[5][1]} {filler(9)} {ITEMS[6][1]}", 9: "a b c d e f g " * 4000, 10: filler(30_000)}
    rows = [*docs.items(), (1, docs[1]), (None, docs[1])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((str(r["doc_id"]), tuple(r["items"]), round(r["coverage"], 6)) for r in tiling.judged(frame(rows), bench, block_words=block_words).collect())
    want = {0: (), 1: (0,), 2: (1,), 3: (3,), 4: (), 5: (), 6: (), 7: (), 8: (5, 6), 9: (), 10: ()}
    assert [x[:2] for x in got] == sorted((str(d), want[d if d is not None else 1]) for d, _ in rows)
    assert dict((x[0], x[2]) for x in got)["4"] == 0.5
    kept = tiling.clean(frame(rows), bench)
    assert kept.columns == frame(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5, 6, 7, 9, 10]


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert tiling.judged(frame([(1, "some text")]), bench).select("coverage").first()[0] == 0
    assert tiling.judged(frame([]), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_repeats_are_runs_not_pairs():
    import time

    import pyarrow as pa

    items = tiling.Items([1], ["again " * 400])
    for pairs in (tiling.PAIRS, 1000):
        tiling.PAIRS, before = pairs, tiling.PAIRS
        try:
            assert items.judge(pa.array(["again " * 600, "x " + "again " * 100 + "y"], pa.large_string())) == [[(1, 1.0)], [(1, 0.25)]]
        finally:
            tiling.PAIRS = before
    start = time.time()
    assert items.judge(pa.array(["again " * 5000], pa.large_string())) == [[(1, 1.0)]]
    assert time.time() - start < 3
    same = " ".join(f"pre{k}" for k in range(15))
    many = tiling.Items(list(range(2000)), [f"{same} " + " ".join(f"i{n}w{k}" for k in range(20)) for n in range(2000)])
    start = time.time()
    got = many.judge(pa.array([f"{same} t{k} " + " ".join(f"i7w{x}" for x in range(15)) for k in range(50)], pa.large_string()))
    assert all(max(c for _, c in g) == pytest.approx(30 / 35) and [i for i, c in g if c >= 0.8] == [7] for g in got)
    assert time.time() - start < 5
