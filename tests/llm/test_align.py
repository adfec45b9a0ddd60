"""Token alignment against the libraries and a plain pairing of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantfold.llm import align
from quantfold.llm.queries import QUERIES, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", " a  b  ", "x\ny", "x\n y \n", "\n", "\t\t", "\r\n", "x\x00y z", "é　b c", "x▁y z", "▁", "<|endoftext|> a<|endoftext|>b", "<s>a</s> <unk> <0x41>",
       "ﬁ ½ x y", "漢字 テスト 漢", "🙂 smile 🙂🙂", "it's they'll don't 'S", "a\u0085b", "​ zero", "1234567 12,5% x=3", "naïve Ünïcode straße", "tail   ", "  ogham", "a‮b c", "word﻿ bom"]


@pytest.fixture(scope="module")
def coders():
    return align.ByteLevel(A), align.PieceModel(B)


def plain(coders, text):
    """``(ids of A, ids of B, groups, links)`` of one text, from the libraries and byte ranges."""
    if not text:
        return None
    ids = [list(coders[0].model.encode(" " + text, add_special_tokens=False).ids), coders[1].model.encode(text)]
    pieces = [[c.pieces[i] for i in x] for c, x in zip(coders, ids)]
    if any(b"".join(p) != (" " + text).encode() for p in pieces):
        return None
    spans = []
    for p in pieces:
        ends = np.cumsum([len(x) for x in p]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends)))
    links = []
    for i, (s, e) in enumerate(spans[0]):
        links += [(ids[0][i], ids[1][j]) for j, (u, v) in enumerate(spans[1]) if u < e and s < v]
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, start = [], 0
    for c in common:
        groups.append(tuple([x for x, (_, e) in zip(own, span) if start < e <= c] for own, span in zip(ids, spans)))
        start = c
    return *ids, groups, links


def rows_of(coders, docs):
    done = [plain(coders, t) for _, t in docs]
    held = Counter(p for d in done if d for p in set(d[3]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc_id, _), d in zip(docs, done):
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in d[2])
        out.append((doc_id, len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def documents(rnd, n):
    words = ["the", "of", "naïve", "it's", "straße", "x1", "&&&", "qzxv", "unbelievably", "漢字", "Ünï", "3,14", "e-mail@example.org", "\n", " ", "\t"]
    return [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", ".", "s"]) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


def test_tokens_are_those_of_the_libraries(coders):
    rnd = random.Random(1)
    texts = ODD + [t for _, t in documents(rnd, 300)] + ["".join(rnd.choice("ab é'\n\t 1.🙂") for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    two = align.TwoEncoders(A, B)
    assert two.by_stretch
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        which, a, b = two.tokens(pa.array(part, pa.large_string()))
        done = {i: ([a[1][a[0][k] : a[0][k + 1]].tolist(), b[1][b[0][k] : b[0][k + 1]].tolist()]) for k, i in enumerate(which.tolist())}
        for i, t in enumerate(part):
            want = plain(coders, t)
            assert done.get(i) == (None if want is None else [want[0], want[1]]), repr(t)


def test_forgetting_stretches_changes_nothing(coders, monkeypatch):
    monkeypatch.setattr(align, "MEMORY", 20)
    monkeypatch.setattr(align, "TOGETHER", 3)
    two = align.TwoEncoders(A, B)
    for _, t in documents(random.Random(2), 40):
        which, a, _ = two.tokens(pa.array([t], pa.large_string()))
        assert (a[1].tolist() if len(which) else None) == ((plain(coders, t) or [None])[0])


def test_gallop_is_a_search():
    rnd = np.random.default_rng(3)
    for n, m in ((0, 5), (1, 1), (40, 4000), (5000, 6000), (3, 100_000)):
        long = np.unique(rnd.integers(0, 3 * m, m))
        keys = np.unique(rnd.integers(0, 3 * m, n))
        got = align.ranks(keys, np.zeros(len(keys), np.int64), np.arange(len(keys)), long, np.array([0]), np.array([len(long)]))
        assert got.tolist() == np.searchsorted(long, keys).tolist()


def test_groups(coders, frame):
    docs = [(i, t) for i, t in enumerate(ODD)] + documents(random.Random(4), 30)
    for r, (_, t) in zip(align.aligned(frame(docs).coalesce(1), A, B, groups=True).orderBy("row").collect(), docs):
        d = plain(coders, t) or ([], [], [], [])
        assert (r["a_ids"], r["b_ids"]) == (d[0], d[1])
        assert (r["a_sizes"], r["b_sizes"]) == ([len(a) for a, _ in d[2]], [len(b) for _, b in d[2]])
        n_b = len(coders[1].pieces)
        assert dict(zip(r["pairs"], r["times"])) == Counter(a * n_b + b for a, b in d[3]) and r["pairs"] == sorted(r["pairs"])


@pytest.mark.parametrize("broadcast_rows", [align.BROADCAST_ROWS, 40, 0])
def test_query(coders, frame, broadcast_rows):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in documents(random.Random(5), 120)] + [(500, None), (501, "same words here"), (501, "same words here"), (None, "no id"), (502, "word " * 3000)]
    got = align.alignment_query(frame(docs).repartition(3), A, B, broadcast_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == rows_of(coders, docs)


def test_defined_cases(frame, spark):
    assert align.alignment_query(frame([]), A, B).collect() == []
    odd = spark.createDataFrame([(1, "a b", 3, "k", 1.0, 5)], "doc_id long, text string, row int, pairs string, n double, times int")
    assert align.alignment_query(odd, A, B).first()["n_links"] == 2


def test_whole_table(coders, spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r["text"]) < 4000]
    got = align.alignment_query(spark.createDataFrame(docs, "doc_id long, text string"), A, B).collect()
    assert sorted((tuple(r) for r in got), key=str) == rows_of(coders, docs)
    assert QUERIES["op13_token_alignment"](spark, sf).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_ranks_encode_like_the_file(coders):
    assert coders[0].by_rank is not None
    rnd = random.Random(7)
    letters = "aabcdeghinorstuvz éßüñ'.,!&0123456789  \n\tABŠ"
    texts = [" " + "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(5000)] + [" " + c * n for c in "a &é1'\n-=" for n in range(1, 40)]
    texts += [" " + p.decode() for p in coders[0].pieces if not p.decode(errors="replace").count("�")]
    for t, want in zip(texts, coders[0].model.encode_batch(texts, add_special_tokens=False)):
        assert coders[0].encode(t).tolist() == want.ids, t
