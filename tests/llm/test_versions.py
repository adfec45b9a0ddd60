"""Invertible sketches against plain bags of paragraphs, and document pairs against a plain loop."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from quantfold.llm import versions
from quantfold.llm.queries import QUERIES

MASK = (1 << 64) - 1


def mix(x, salt):
    x = (x + salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & MASK
    x = ((x ^ (x >> 29)) * 0xC4CEB9FE1A85EC53) & MASK
    return x ^ (x >> 32)


def pieces(text):
    """The pieces of a text, one after the other."""
    out, data = [], text.encode()
    lines = data.split(b"\n")
    for i, line in enumerate(lines):
        start = 0
        for at, byte in enumerate(line):
            if byte == 32:
                tail = int.from_bytes(line[max(0, at - 8) : at], "big")
                if len(data) <= versions.SMALL or len(line) < versions.SHORT or mix(tail, 7) % versions.WORDS == 0:
                    out.append(line[start : at + 1])
                    start = at + 1
        rest = line[start:] + (b"\n" if i + 1 < len(lines) else b"")
        if rest:
            out.append(rest)
    assert b"".join(out) == data
    return out


def bag(text):
    seen, out = Counter(), set()
    for p in pieces(text):
        h, n = xxhash.xxh3_64_intdigest(p), seen[p]
        seen[p] += 1
        out.add(h if not n else (mix(h, 11) + n * 0xFF51AFD7ED558CCD) & MASK)
    assert len(out) == sum(seen.values())
    return out


def alike(a, b):
    x, y = bag(a), bag(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def prose(rnd, n):
    return "".join(rnd.choice(["the ", "of ", "é\n", "long-word-here ", "a", " ", "Ende.\n", "b c "]) + rnd.choice(["x", "yy ", ""]) for _ in range(n))


def test_digests_are_those_of_the_pieces():
    rnd = random.Random(1)
    texts = ["", " ", "\n", "\n\n", "a", "a\n", "one two", "x " * 300, "w" * 500, "é ü " * 40] + [prose(rnd, rnd.randint(0, 200)) for _ in range(150)]
    owner, digest = versions.digests([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert set(digest[owner == i].tolist()) == bag(t) and (owner == i).sum() == len(bag(t))


def test_peeling_recovers_every_difference():
    rnd = np.random.default_rng(2)
    texts = [np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 3, 10, 200, 3000)]
    texts += [np.concatenate([texts[4][:150], texts[3]]), texts[5][5:]]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    left, right = map(np.ravel, np.meshgrid(range(len(texts)), range(len(texts))))
    pair, got, sign, took = versions.differences(owner, np.concatenate(texts), left, right, len(texts))
    for k, (a, b) in enumerate(zip(left, right)):
        x, y = set(texts[a].tolist()), set(texts[b].tolist())
        mine = pair == k
        assert set(got[mine & (sign == 1)].tolist()) == x - y and set(got[mine & (sign == -1)].tolist()) == y - x
        assert mine.sum() == len(x ^ y) and took[k] >= versions.CELLS
    assert took.max() > 16 * versions.CELLS and took[left == right].max() == versions.CELLS


def test_changes(frame, spark):
    rnd = random.Random(3)
    base = "\n".join(prose(rnd, 12) for _ in range(60))
    lines = base.split("\n")
    rows = [(1, base, base), (2, base, "\n".join(lines[:40] + ["new line"] + lines[40:])), (3, None, ""), (4, None, base), (5, base, prose(rnd, 300)), (None, "a", "b")]
    got = versions.changes(spark.createDataFrame(rows, "doc_id long, text string, new_text string")).collect()
    for r, (_, a, b) in zip(sorted(got, key=lambda r: r["doc_id"] or 99), rows):
        x, y = bag(a or ""), bag(b or "")
        assert {i & MASK for i in r["removed"]} == x - y and {i & MASK for i in r["added"]} == y - x
        assert r["likeness"] == pytest.approx(alike(a or "", b or ""))
        assert (r["fingerprint"] == r["new_fingerprint"]) == (x == y)
    assert min(r["cells"] for r in got) == versions.CELLS < max(r["cells"] for r in got)


def plain(rows):
    """The query by a loop over the ordered documents."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + following[: n // 2]
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, following), 9)))
    return sorted(out, key=str)


def columns(found):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 30, 2000, 60])
def test_query_is_the_plain_loop(frame, block_bytes):
    rnd = random.Random(4)
    rows = [(i * 3 + rnd.randint(0, 1), prose(rnd, rnd.choice([0, 1, 5, 30, 120]))) for i in range(120)] + [(1000, None), (1001, "é" * 501), (1002, "word " * 9000), (None, "without an id")]
    copy = dict(rows)
    rows += [(5000 + i, copy[1002]) for i in range(3)]
    got = versions.edited_versions(frame(rows).repartition(4), block_bytes).collect()
    assert columns(got) == plain(rows)
    name = {r["doc_id"]: r["fingerprint"] for r in got}
    assert len({name[5000 + i] for i in range(3)} | {name[1002]}) == 1
    for r in got:
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1.0)


def test_defined_cases(frame, spark):
    assert versions.edited_versions(frame([])).collect() == []
    assert versions.fingerprints(frame([])).collect() == []
    one = versions.edited_versions(frame([(7, "only document here")])).first()
    assert (one["near_next"], one["n_chars"]) == (1.0, 18)
    repeated = versions.edited_versions(frame([(1, "same"), (1, "same"), (1, "other one")])).collect()
    assert [r["n_chars"] for r in sorted(repeated, key=lambda r: r["n_chars"])] == [4, 4, 9]
    odd = spark.createDataFrame([(1, "a b", 3, "k", True), (2, "c", 4, "l", False)], "doc_id long, text string, block int, key string, guest boolean")
    assert versions.edited_versions(odd).count() == 2


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_fingerprints"](spark, sf).collect()
    assert columns(got) == plain(rows)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.95
