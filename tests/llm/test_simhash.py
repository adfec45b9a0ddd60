"""SimHash near-duplicates against brute force over all pairs."""

import random
import re

import xxhash

from quantfold.llm import simhash
from quantfold.llm.graph import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_force(rows):
    fp = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), f"{f:016x}", str(least.get(root(i)))) for i, ((d, _), f) in enumerate(zip(rows, fp)))


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([4, 40, 150]))] for _ in range(30)]
    rows = [(1000 - i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(150):  # near copies, most of them of one text
        w = list(base[0] if i % 3 else rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, (" " if i % 2 else "\n\t").join(w)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "one"), (2005, "É one"), (2006, "w1 " * 20_000), (2006, "w1 " * 20_000), (None, "no id"), (None, None)]


def found(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def test_near_duplicates(frame):
    rows = corpus(1)
    assert found(simhash.near_duplicates(frame(rows).repartition(3))) == by_force(rows)


def test_hot_keys_are_cut(frame):
    rows = corpus(2)
    assert found(simhash.near_duplicates(frame(rows), chunk=4)) == by_force(rows)


def test_every_text_of_a_table_larger_than_a_slice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sum(len(t.encode()) for t in texts.values()) > 2 << 20
    got = {r["doc_id"]: r["fp"] % 2**64 for r in simhash.fingerprints(docs).collect()}
    assert got == {d: fingerprint(t) for d, t in texts.items()}


def test_no_id_and_empty(frame):
    assert found(simhash.near_duplicates(frame([]))) == []
    assert {x[2] for x in found(simhash.near_duplicates(frame([(None, "a"), (None, "a")])))} == {"None"}


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}


def test_first_of_each(frame):
    rows = corpus(3) + [(3000, "w7 w8 w9 same id"), (3000, "w7 w8 w9 same id"), (3000, "quite another text of the same id")]
    of = {(d, f): c for d, f, c in by_force(rows)}
    want = sorted({(d, f) for d, f, c in by_force(rows) if d == c})
    for how in ({}, {"broadcast_rows": -1}):
        kept = simhash.first_of_each(frame(rows), **how)
        assert kept.columns == frame(rows).columns
        got = sorted((str(r["doc_id"]), f"{fingerprint(r['text']):016x}") for r in kept.collect())
        assert len(got) == len({of[x] if x[0] != "None" else x for x in got}) + 1  # id 3000 names two components
        assert set(got) <= set(want) and {of[x] for x in got} == {of[x] for x in want}


def test_hot_fingerprints_are_looked_up_apart(frame, monkeypatch):
    from functools import partial

    rows = corpus(4) + [(5000 + i, "the very same words in very many rows") for i in range(200)]
    want, kept = found(simhash.near_duplicates(frame(rows))), found_rows(simhash.first_of_each(frame(rows)))
    monkeypatch.setattr(simhash, "looked_up", partial(simhash.looked_up, hot_rows=20))
    assert found(simhash.near_duplicates(frame(rows))) == want and found_rows(simhash.first_of_each(frame(rows))) == kept


def found_rows(df):
    return sorted(map(str, df.collect()))
