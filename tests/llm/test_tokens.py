"""Token files and packing against the tokenizers library, text by text."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quantfold.llm import packing, tokenfile
from quantfold.llm.queries import tokenizer_path
from quantfold.llm.tokens import Encoder

ODD = ["", " ", "It's they'll 'Sound don''t", "İstanbul ΣΑΣ ςσ", "a<|endoftext|>b  <|startoftext|>", "x\x1cy z w", "é É é",
       "123abc4 !!'s ''re", "ªº µ ×÷ ẞß", "\n\n", "漢字 テスト", "a\u0085b", "'", "don't'll", "\x00a", "two  spaces\tand\x0btabs "]
CASES = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "word " * 5000), (52, "same text"), (53, "same text"), (53, "same text"), (None, "no id")]


def ids_of(code, text):
    return [*code.full.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


@pytest.fixture(scope="module")
def code():
    return Encoder(tokenizer_path())


def test_encoder_is_the_library(code):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abcéß'!1 \n ́sST") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    offsets, ids = code.encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == code.full.encode(t, add_special_tokens=False).ids, t


def test_token_files_round_trip(spark, frame, code, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(frame(CASES), path, tokenizer_path())
    got = tokenfile.read_tokens(spark, path).collect()
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted((str(d), tuple(ids_of(code, t))) for d, t in CASES)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == [None, *sorted(x for x in ordered if x is not None)]
    meta = {(r["doc_id"], r["start"], r["n_tokens"]) for r in tokenfile.read_meta(spark, path).collect()}
    assert meta == {(r["doc_id"], r["start"], r["n_tokens"]) for r in got}
    digests = {(r["start"], r["ids_crc32"]) for r in tokenfile.id_digests(tokenfile.read_tokens(spark, path)).collect()}
    assert digests == {(r["start"], crc(r["ids"])) for r in got}


@pytest.mark.parametrize("op", [lambda d: tokenfile.token_file_query(d, tokenizer_path()), lambda d: packing.pack(d, tokenizer_path())])
def test_empty_table(frame, op):
    assert op(frame([])).collect() == []


def check_packing(rows, size):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padded = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padded += 0 if not at & (at - 1) else size - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padded


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_packing(frame, code, broadcast_rows):
    rnd = random.Random(2)
    docs = [(d, t) for d, t in CASES if d not in (None, 53)] + [(100 + i, "the " * rnd.choice([3, 700, 1500, 1500, 2100])) for i in range(60)]
    rows = packing.pack(frame(docs).repartition(5), tokenizer_path(), broadcast_rows=broadcast_rows).collect()
    for d, t in docs:
        want, own = ids_of(code, t), sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert [i for r in own for i in np.frombuffer(r["ids"], "<u2")] == want
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert {r["doc_tokens"] for r in own} == {len(want)}
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 2048) <= 0.02 * total


def test_shortest_pack_first_keeps_counts():
    rnd = random.Random(3)
    for size in (16, 64):
        histogram = {n: rnd.randint(1, 50) for n in rnd.sample(range(1, size + 1), size // 2)}
        got = {}
        for n, lengths in packing.shortest_pack_first(histogram, size):
            assert sum(lengths) <= size
            for x in lengths:
                got[x] = got.get(x, 0) + n
        assert got == histogram
    assert packing.shortest_pack_first({3: 2, 2: 2, 1: 1}, 5) == [(2, (3, 2)), (1, (1,))]
