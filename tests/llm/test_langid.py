"""Language ID: held-out accuracy on the small tables, whole-text windows, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from quantfold.llm import langid
from quantfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(langid.labelled_sample(docs))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = QUERIES["op1_language_id"](spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"] and len(r["text"]) > 60]
    assert len(rows) == 1000 and len(held) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_tables_are_the_network(model):
    from quantfold.llm.convnet import ConvNet, softmax

    net = ConvNet(256, langid.EMBED, langid.WIDTHS, langid.FILTERS, len(model[0]))
    net.p = model[1]
    text = "Die Heiten und der Ungen zu verstehen, nicht wahr, und so weiter."
    numbers = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int64)
    own = np.append(numbers, np.full(langid.WINDOW - len(numbers), -1))
    want = softmax(net.outputs([own], np.arange(256)[:, None]))[0]
    score, which = langid.score_texts(langid.Windows(model[1]), pa.array([text], pa.large_string()))
    assert which[0] == want.argmax() and abs(score[0] - want.max()) < 1e-3


def test_odd_rows(frame, model):
    long = "the of and that with " * 20_000
    rows = [(1, None), (2, ""), (3, "123 !? 45"), (4, long), (5, "the"), (5, "the"), (None, "die und der nicht"), (6, "漢字")]
    got = {(r["doc_id"], i): r for i, r in enumerate(langid.predict(frame(rows).coalesce(1), model).collect())}
    said = [r["lang_pred"] for _, r in sorted(got.items(), key=lambda x: x[0][1])]
    assert said[:3] == ["und"] * 3 and said[3] == "en" and said[4] == said[5] and said[6] == "de" and said[7] in model[0]
    kept = langid.accepted(frame(rows), model, 0.3)
    assert kept.columns == frame(rows).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "5", "6", "None"]


def test_no_labels_and_empty(frame):
    assert langid.train(langid.labelled_sample(frame([(1, "text")]))) is None
    assert [r["lang_pred"] for r in langid.language_query(frame([(1, "text"), (None, None)])).collect()] == ["und", "und"]
    assert langid.language_query(frame([])).collect() == []
