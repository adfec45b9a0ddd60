"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import corpus_pipeline
import pytest
from test_pii import plain
from test_simhash import by_force
from test_tokens import check_packing, ids_of

from quantfold.llm import pii
from quantfold.llm.queries import tokenizer_path
from quantfold.llm.tokens import Encoder

WORDS = {"en": "the of and to in is that with for was this are by from".split(), "de": "der die das und nicht von zu mit sich auf für ist im dem".split(), "fr": "le la les des et un une que qui dans pour pas sur avec".split()}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rnd = random.Random(6)
    stem = lambda lang: "".join(rnd.choice({"en": ["th", "er", "ing", "ou"], "de": ["sch", "ung", "ei", "keit"], "fr": ["eau", "ent", "ier", "aux"]}[lang]) for _ in range(3))
    text = lambda lang, n: " ".join(rnd.choice([rnd.choice(WORDS[lang]), stem(lang)]) for _ in range(n))
    rows = []
    for i in range(150):
        lang = rnd.choice(list(WORDS))
        rows.append((i, text(lang, rnd.choice([8, 60, 200])), lang))
    items = [(k, text("en", 25)) for k in range(4)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(300 + k, f"{text('en', 20)} {t} {text('en', 20)}", "en") for k, t in items]
    rows += [(400, None, "en"), (401, "", None), (402, "12 34 !", "en"), (403, "the of and " * 9000, "en"), (404, f"{text('fr', 30)} a.b@c.example.org 10.0.0.1", "fr"), (404, rows[3][1], None)]
    rows = [(*r, f"src{i % 3}", None if r[1] is None else len(r[1])) for i, r in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, table, tmp_path):
    path, items = table
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        after = now.collect()
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if re.search(r"[^\W\d_]", r["text"] or ""))
        elif name == "simhash_near_dedup":
            least = sorted({c for _, _, c in by_force([(r["doc_id"], r["text"]) for r in before])}, key=int)
            assert sorted((str(r["doc_id"]) for r in after), key=int) == least and set(map(str, after)) <= set(map(str, before))
        elif name == "benchmark_decontamination":
            held = [r for r in before if not any(t in r["text"] for _, t in items)]
            assert sorted(map(str, after)) == sorted(map(str, held)) and len(before) - len(after) == len(items)
        elif name == "pii":
            want = sorted((r["doc_id"], pii.masked(r["text"], plain(r["text"]))) for r in before)
            assert sorted((r["doc_id"], r["text"]) for r in after) == want and all(r["n_chars"] == len(r["text"]) for r in after)
            assert any("[EMAIL] [IP]" in r["text"] for r in after)
        else:
            code = Encoder(tokenizer_path())
            total = sum(len(ids_of(code, r["text"])) for r in before)
            assert sum(r["length"] for r in after) == total and check_packing(after, 2048) <= 0.02 * total
        docs, before = now, after


def test_run_and_empty(spark, table, tmp_path):
    path, _ = table
    assert corpus_pipeline.run(spark, path).count() > 50
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
