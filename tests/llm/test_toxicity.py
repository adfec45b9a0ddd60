"""Toxicity: held-out ranking on planted words, the network's tables, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quantfold.llm import toxicity
from quantfold.llm.convnet import ConvNet


def corpus(n=700):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        lang = rnd.choice(["en", "de"])
        vocab = [f"{lang}{rnd.randint(0, 300)}" for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(3):
                vocab[rnd.randrange(len(vocab))] = rnd.choice(["schurke", "schurkerei", "Schurken!"] if lang == "de" else ["scoundrel", "Scoundrels,", "rogue"])
        rows.append((i, " ".join(vocab), lang))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, marks, dict((i, t) for i, _, t in labels)


def test_held_out(trained):
    docs, marks, truth = trained
    rows = toxicity.toxicity_query(docs, marks).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 700 and 80 < len(held) < 220
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_tables_are_the_network():
    net = ConvNet(toxicity.BUCKETS, toxicity.EMBED, toxicity.WIDTHS, toxicity.FILTERS, 3, seed=4)
    texts = ["one two three two", "", "!!! four", "five"]
    offsets, number, rows = toxicity.symbols(pa.array(texts, pa.large_string()))
    want = net.outputs([number[a:z] for a, z in zip(offsets[:-1], offsets[1:])], rows)
    assert np.allclose(toxicity.responses(net.p, offsets, number, rows), want, atol=1e-4)


def test_gradients():
    rnd = np.random.default_rng(0)
    net = ConvNet(20, 3, (1, 2), 2, 2, seed=1)
    net.p = {k: v.astype(np.float64) + 0.05 * (k[0] == "b") for k, v in net.p.items()}  # away from the bend at 0
    texts, rows = [rnd.integers(0, 10, n) for n in (4, 7, 0)], rnd.integers(0, 20, (10, 2))
    dout = rnd.normal(size=(3, 2))
    hidden, context = net.pooled(*net.laid(texts), rows)
    g, on = net.gradients(dout, hidden, context)
    full = np.zeros_like(net.p["embed"])
    full[on] = g["embed"]
    g["embed"] = full
    for k, p in net.p.items():
        for at in list(np.ndindex(p.shape))[:25]:
            old = p[at]
            f = []
            for e in (1e-5, -1e-5):
                p[at] = old + e
                f.append((net.outputs(texts, rows) * dout).sum())
            p[at] = old
            assert abs((f[0] - f[1]) / 2e-5 - g[k][at]) < 1e-4, (k, at)


def test_odd_rows(trained, frame):
    docs, marks, _ = trained
    model = toxicity.train(toxicity.labelled_sample(docs, marks))
    rows = [(1, None), (2, ""), (3, "en5 " * 30_000), (4, "rogue scoundrel rogue"), (4, "rogue scoundrel rogue"), (None, "..."), (5, " \n")]
    got = toxicity.score(frame(rows).coalesce(1), model).collect()
    assert len({got[i]["score"] for i in (0, 1, 6)}) == 1 and got[3]["score"] == got[4]["score"] and got[3]["predicted"] == 1 and got[2]["predicted"] == 0


def test_no_labels_and_empty(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.toxicity_query(frame([(1, "a")]), none).collect()] == [0.0]
    assert toxicity.toxicity_query(frame([]), none).collect() == []


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    rows, labels = corpus(800)
    rows[5] = (5, rows[5][1] + " en7" * 20_000, "en")  # whole, whatever its length
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame(labels + [(9999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 400)
    for limit in (1_000_000, 0):  # looked up by broadcast and by shuffle
        monkeypatch.setattr(toxicity, "BROADCAST_ROWS", limit)
        got = toxicity.labelled_sample(docs, marks)
        assert sorted((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == rows
        assert got.select("shard").distinct().count() == 3
    model = toxicity.train(got)
    assert model["langs"] == ["de", "en"]
    truth = {i: t for i, _, t in labels}
    scored = toxicity.score(docs, model).collect()
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in scored) >= 0.97 * len(scored)


def test_thresholds_of_all_rows(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), round(rnd.gauss(0, 2), 1)) for _ in range(600)]
    rows = [(own, x, int(own < 2 and rnd.random() < 1 / (1 + 2.7 ** -(x - own)))) for own, x in rows]
    got = toxicity.best_thresholds(spark.createDataFrame(rows, "own int, logit double, toxic int"), range_rows=20)
    for own in (-1, 0, 1, 2):
        of = [(x, t) for k, x, t in rows if own in (k, -1)]
        xs, hits, best = sorted({x for x, _ in of}, reverse=True), sum(t for _, t in of), None
        for i, x in enumerate(xs):
            above = [t for v, t in of if v >= x]
            f = 1.25 * sum(above) / (len(above) + 0.25 * hits)
            if best is None or f > best[0]:
                best = (f, (x + xs[i + 1]) / 2 if i + 1 < len(xs) else x - 1)
        assert got[own] == (pytest.approx(best[1]), hits), own
