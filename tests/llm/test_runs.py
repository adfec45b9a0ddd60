"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quantfold.llm import runs
from quantfold.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, shortest=6, repeats=4):
    out, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if j > i and length >= max(shortest, repeats * q):
                own = words[start : start + length]
                if all(own[d:] != own[: len(own) - d] for d in range(1, q)):
                    out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def edited(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row_of(doc_id, text):
    words = edited(doc_id, text)
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest())


def texts(rnd, n):
    for _ in range(n):
        kind = rnd.randint(0, 4)
        few = "ab" if kind < 3 else "abc"
        body = [rnd.choice(few) for _ in range(rnd.randint(0, 40))]
        if kind > 1:
            unit = [rnd.choice("abcde") for _ in range(rnd.randint(1, 7))]
            at = rnd.randint(0, len(body))
            body[at:at] = (unit * 9)[: rnd.randint(len(unit), 9 * len(unit))]
        if kind == 4:
            body = body * rnd.randint(2, 6)
        yield " ".join(body)


CASES = [(1, None), (2, ""), (3, "\t \x0b\n"), (4, "a " * 5), (5, "a\n" * 6), (6, "a b " * 3 + "a"), (7, "a b " * 4), (None, "x y z " * 6), (8, "same " * 9), (8, "same " * 9),
         (9, "a b c d e f " * 700), (10, "w " * 30_000), (11, " x  x " * 4), (12, "aab aab aab aab aab aab b " * 5)]


@pytest.mark.parametrize("shortest, repeats", [(6, 4), (2, 2), (9, 2), (5, 3)])
def test_runs_are_those_of_a_plain_search(shortest, repeats):
    import pyarrow as pa

    rnd = random.Random(shortest)
    docs = [t.split() for t in texts(rnd, 400)]
    offsets = np.cumsum([0] + [len(d) for d in docs])
    got = runs.slice_runs(offsets, pa.array([w for d in docs for w in d], pa.large_string()), shortest, repeats)
    by_doc = {}
    for s, length, q in got.tolist():
        d = int(np.searchsorted(offsets, s, "right")) - 1
        by_doc.setdefault(d, []).append((s - int(offsets[d]), length, q))
    for d, w in enumerate(docs):
        assert by_doc.get(d, []) == brute(w, shortest, repeats), w


def test_every_level_is_united_in_any_order():
    """Classes that meet in the middle of each other: a phrase among other words, many times."""
    import pyarrow as pa

    rnd = random.Random(5)
    words = []
    for k in range(300):
        words += ["p", "q", "r", "s", "t", "u"] * rnd.choice([1, 1, 1, 5]) + [f"f{k % 7}"] * rnd.randint(0, 7)
    got = runs.slice_runs(np.array([0, len(words)]), pa.array(words, pa.large_string()), 6, 4)
    assert [tuple(r) for r in got.tolist()] == brute(words)


def test_operator_and_defined_cases(frame):
    got = runs.find(frame(CASES)).collect()
    want = []
    for d, t in CASES:
        words = WORD.findall(t or "")
        found = brute(words) if len(words) < 10_000 else [(0, len(words), 1)]
        want.append((str(d), len(words), found, collapsed(words, found)))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in got) == sorted(want)


def test_empty_table_and_clashing_columns(frame, spark):
    assert runs.find(frame([])).collect() == []
    odd = spark.createDataFrame([(1, "a " * 8, 1, 2, "x", 5)], "doc_id long, text string, runs int, n_words int, start string, h int")
    row = runs.digests(runs.find(runs.repeat_tails(odd))).first()
    assert tuple(row) == row_of(1, "a " * 8)


def test_query_over_a_whole_table(spark, tmp_path, frame):
    rnd = random.Random(8)
    rows = [(i, t) for i, t in enumerate(texts(rnd, 300))] + [(1000 + i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 90)))) for i in range(200)]
    rows += [(2000 + i, t) for i, (_, t) in enumerate(CASES) if t is None or len(t) < 10_000] + [(None, "no id " * 5)]
    frame(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect(), key=str)
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted((spark.createDataFrame([row_of(*r) for r in rows], QUERIES["op11_periodic_runs"](spark, str(tmp_path)).schema).collect()), key=str)]
    assert sum(r["n_runs"] for r in got) > 100
