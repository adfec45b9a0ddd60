"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from quantfold.llm import substrings


def by_force(rows, size):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((str(d), len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in rnd.sample(range(1000), 200):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 40))]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    same = " ".join(passages[0] * 3)
    return rows + [(2000 + i, same) for i in range(70)] + [(3000, "a " * 30_000), (3001, "a " * 14), (3002, None), (3003, ""), (-5, same), (None, same), (7000, same), (7000, same)]


def found(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, -1])
def test_remove_repeats(frame, monkeypatch, broadcast_bytes):
    rows = corpus(broadcast_bytes)
    got = substrings.remove_repeats(frame(rows).repartition(7), range_bytes=20_000, broadcast_bytes=broadcast_bytes)
    assert found(got) == by_force(rows, 13)


@pytest.mark.parametrize("range_bytes, fan", [(20_000, 4), (300, 16), (300, 5)])
def test_many_ranges_in_levels(frame, range_bytes, fan):
    """More ranges than a batch may write to: the same result by two, three or four levels."""
    rows = corpus(1)
    got = substrings.remove_repeats(frame(rows).repartition(7), range_bytes=range_bytes, fan=fan)
    assert found(got) == by_force(rows, 13)


def test_empty_table(frame):
    assert found(substrings.remove_repeats(frame([]))) == []


def test_rolled_is_the_polynomial_of_each_window():
    w = np.random.default_rng(1).integers(0, 1 << 63, 40).astype(np.uint64)
    w[20:] = w[:20]
    for size in (1, 2, 5, 13, 16):
        h = substrings.rolled(w, size)
        assert len(h) == 41 - size and len(set(h.tolist())) > 15
        assert all(h[i] == h[i + 20] for i in range(21 - size))


def test_pack_round_trip():
    rnd = np.random.default_rng(2)
    h = np.sort(rnd.integers(0, 1 << 64, 500, dtype=np.uint64))
    doc, position = rnd.integers(-(10**12), 10**12, 500), rnd.integers(0, 70_000, 500)
    for a, b in zip(substrings.unpack(substrings.pack(h, doc, position)), (h, doc, position)):
        assert (a == b).all()


def test_covered_joins_touching_intervals():
    got = substrings.covered(np.array([2, 1, 1, 1]), np.array([0, 13, 0, 40]), np.array([13, 26, 13, 53]))
    assert [x.tolist() for x in got] == [[1, 1, 2], [0, 40, 0], [26, 53, 13]]
