"""Personal data: base spans against the plain expressions, and planted contexts."""

import hashlib
import random
import re

import pytest

from quantfold.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def keep(kind, s):
    digits = [c for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def plain(text):
    return [(i, m.start(), m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if keep(k, m.group())]


def test_base_spans_are_those_of_the_expressions():
    rnd = random.Random(1)
    texts = ["a@b.c_d@e.f", "x@y", "@a.b", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "001.002.3.255", "4111 1111-1111 1111", "4111111111111111 42", "+1 (487) 555-7209 4", "+12", "é+44 20 7946 0958-", "a%+@b-.c-", "+1+2 345 678 901", "0" * 5000]
    texts += ["".join(rnd.choice("ab@.-_ 0123456789+()") for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def card(rnd):
    body = "".join(rnd.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def corpus():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(40):
        rows.append((i, f"{word()} {word()} please call me +1 202 555 0{100 + i} {word()} and pay with card {card(rnd)} {word()}."))
    rows += [(100, f"{word()} please call me 5550199123, {word()}"), (101, "please call me 555-0199-77 now"), (102, f"order number 5550199123 {word()}"), (103, "please call me tomorrow"), (104, "nothing here"), (105, None), (106, ""),
             (107, "write to a.b@c.example.org now " * 2000), (108, "please call me 5550199123"), (108, "other text 1234567"), (None, "please call me 5550199124"), (None, None)]
    return rows + [(109, rows[41][1]), (109, rows[41][1])]


@pytest.mark.parametrize("broadcast_rows", [10**6, -1])
def test_contexts_find_unseen_identifiers(frame, broadcast_rows):
    rows = corpus()
    got = pii.find(frame(rows).repartition(3), broadcast_rows=broadcast_rows).collect()
    base = sorted((str(r["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]) for r in got)
    assert base == sorted((str(d), plain(t)) for d, t in rows)
    more = sorted((str(r["doc_id"]), s["kind"], s["start"], s["end"]) for r in got for s in r["spans"] if not s["base"])
    want = []
    for d, t in rows:
        for m in re.finditer(r"call me ([0-9]{10}|555-0199-77)", t or ""):
            want.append((str(d), 3, m.start(1), m.end(1)))
    assert more == sorted(want) and len(more) == 6


def test_redact(frame):
    rows = [(1, "to a@b.example.org or 1.2.3.4", "en"), (2, None), (3, ""), (4, "clean text 12", "fr"), *[(10 + i, f"please call me +1 202 555 0{100 + i} ok") for i in range(12)], (30, "please call me 5550199123 ok")]
    df = frame(rows)
    got = pii.redact(df)
    assert got.columns == df.columns
    texts = {r["doc_id"]: (r["text"], r["lang"], r["n_chars"]) for r in got.collect()}
    assert texts[1] == ("to [EMAIL] or [IP]", "en", 18) and texts[2] == (None, None, None) and texts[3][0] == "" and texts[4][0] == "clean text 12"
    assert texts[12][0] == texts[30][0] == "please call me [PHONE] ok"


def test_empty_table(frame):
    assert pii.find(frame([])).collect() == [] and pii.redact(frame([])).collect() == []


def test_query_digests(spark, tmp_path):
    from quantfold.llm.queries import QUERIES

    rows = [(1, "x a@b.co 1.2.3.4"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op7_personal_data"](spark, str(tmp_path)).collect()}
    assert got[1]["spans"] == "email:2:8,ip:9:16" and got[1]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"], got[2]["spans"]) == (1, 1, 0, 0, "")


def test_unseen_identifiers_cannot_veto_their_context(frame):
    rows = [(i, f"please call me +1 202 555 0{100 + i} ok") for i in range(12)] + [(100 + i, f"please call me 55501991{10 + i} ok") for i in range(40)]
    rows += [(200 + i, f"we met +1 202 555 0{300 + i} there") for i in range(12)] + [(300 + i, f"we met {'abcdefghijkl'[i] * 3} there") for i in range(12)] + [(400, "we met 5550199177 there")]
    got = {r["doc_id"]: [s["base"] for s in r["spans"]] for r in pii.find(frame(rows)).collect()}
    assert all(got[100 + i] == [False] for i in range(40)) and got[400] == []


def test_unseen_identifiers_of_other_shapes(frame):
    rows = [(i, f"please call me +1 202 555 0{100 + i} ok") for i in range(12)] + [(50 + i, f"please mail to u{i}@example.org ok") for i in range(12)]
    odd = ["020 7946 0958", "1234 5678 9012 3456", "AB-123-456"]
    rows += [(100 + i, f"please call me {x} ok") for i, x in enumerate(odd)] + [(110, "please mail to john at example dot com ok"), (111, "please call me 5 times ok")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]] for r in pii.find(frame(rows)).collect()}
    assert not pii.luhn("1234567890123456")
    assert [got[100 + i] for i in range(3)] == [[(3, 15, 15 + len(x), False)] for x in odd]
    assert got[110] == [(0, 15, 38, False)] and got[111] == []


def test_other_numbers_in_a_context_of_phones(frame):
    """Order numbers, dates and amounts in the slot of known phones are no phones, however many."""
    phones = [(i, f"reference number +44 20 7946 1{100 + i} was noted") for i in range(30)]
    orders = [(1000 + i, f"reference number {400000 + 7 * i} was noted") for i in range(300)]
    dates = [(2000 + i, f"reference number {1990 + i % 30}-{1 + i % 12:02d}-{1 + i % 28:02d} was noted") for i in range(300)]
    few = [(3000 + i, f"reference number 1,{200 + i}.50 was noted") for i in range(2)] + [(3100, "reference number 2024-03-09 was noted"), (3101, "reference number 123456 was noted"), (3102, "reference number 020 7946 1234 was noted")]
    for rows in (phones + orders, phones + dates, phones + orders + dates):
        assert all(s["base"] for r in pii.find(frame(rows)).collect() for s in r["spans"])
    got = {r["doc_id"]: [(s["kind"], s["base"]) for s in r["spans"]] for r in pii.find(frame(phones + [(500 + i, f"reference number +44 20 7946 2{100 + i} was noted") for i in range(30)] + few)).collect()}
    # The context stays confident; what can't be a phone is left alone, what can be one is found.
    assert got[3000] == got[3001] == got[3100] == got[3101] == [] and got[3102] == [(3, False)]


def test_long_identifiers_are_one_span(frame):
    rows = [(i, f"please transfer to +44 20 7946 {1000 + i} today") for i in range(30)] + [(50, "please transfer to DE89 3704 0044 0532 0130 00 today")]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in pii.find(frame(rows)).collect()}
    assert got[50] == [(19, 46)]


def brute_patterns(texts, support=pii.SUPPORT, confidence=pii.CONFIDENCE):
    """Confident patterns of one round over texts whose spans are all seeds or free of digits, by plain sets."""
    known, words = {}, {}
    for t in texts:
        for s in pii.seen_tokens(t, pii.base_spans(t)):
            for p in s["patterns"]:
                if s["kind"] >= 0:
                    known.setdefault(p, set()).add(s["instance"])
        w = ["^", "^", *[re.sub(r"\d", "0", x.strip(pii.EDGES).lower()) for x in t.split()], "$"]
        for i in range(2, len(w) - 1):
            if w[i].isalpha():
                for slot in (f"{w[i - 2]}|{w[i - 1]}|_", f"{w[i - 1]}|_|{w[i + 1]}"):
                    words.setdefault(slot, set()).add(w[i])
    return {p for p, x in known.items() if len(x) >= support and len(x) / (len(x) + len(words.get(p[2:], ()))) >= confidence}


def test_patterns_are_those_of_plain_sets(frame):
    rnd = random.Random(9)
    texts = []
    for i in range(600):
        context = rnd.choice(["call me {} now", "ring {} please", "we met {} there", "see {} at home"])
        what = f"+1 202 555 0{rnd.randint(100, 140)}" if rnd.random() < {"c": 0.97, "r": 0.99, "w": 0.5, "s": 0.9}[context[0]] else "".join(rnd.choice("abc") for _ in range(3))
        texts.append(context.format(what))
    df = frame(list(enumerate(texts)))
    rows = pii.stored(pii.found(df), "found")
    edges = rows.select(pii.F.explode("seen").alias("s")).select(pii.F.explode("s.patterns").alias("pattern"), "s.instance", "s.kind").distinct()
    got = {r["pattern"] for r in pii.confident_patterns(edges, df).collect()}
    assert got == brute_patterns(texts) and 0 < len(got)


ODD_NAMES = ["spans", "of_id", "of_hash", "gone_id", "gone_hash", "nth_of_key", "text_hash", "base", "kind", "root", "items", "coverage", "salt", "fp", "stays", "N_CHARS_"]


def test_clashing_columns_in_every_filter(spark):
    from quantfold.llm import simhash, tiling

    rows = [(i, f"please call me +1 202 555 0{100 + i} about these plain words number {i}", "en", i) for i in range(8)] + [(8, "please call me +1 202 555 0100 about these plain words number 0", "en", 5), (8, "please call me +1 202 555 0100 about these plain words number 0", "en", 5), (9, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for n in ODD_NAMES:
        df = df.withColumn(n, pii.F.lit(7))
    bench = spark.createDataFrame([(1, "please call me about these things")], "item_id long, text string")
    for stage in (pii.redact, simhash.first_of_each, lambda d: tiling.clean(d, bench)):
        got = stage(df)
        assert got.columns == df.columns
        assert all(r[n] == 7 for r in got.collect() for n in ODD_NAMES)
