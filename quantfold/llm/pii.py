"""Personal data: base patterns, and bootstrapped contextual extraction.

Base: emails, IPv4 addresses, card numbers that pass the Luhn check and international phone numbers,
leftmost and non-overlapping within a kind.

Bootstrapping: base matches are the seed entities.  Around each seed, and around each other span that could
be an identifier, two lexical patterns are induced.  Such a span is a token with an inner @ or with six digits or more
among digits and separators; else a whole run of neighbouring tokens that each hold a digit, with no punctuation
between them and ``LEAST`` letters and digits or more in all; or an address in words (john at example dot com).  The patterns: the two words before, and the word before with the word after, each with the token's class.
Patterns and instances form a bipartite graph in Spark.  Round by round a pattern's confidence is its distinct
known instances against these and its distinct known wrong ones: plain words (without digit or @) that stand
in its slot, counted in a pass over the texts for the patterns that have support, and unknown instances of another shape
than all known ones (``foreign``: dates, times and amounts, plain numbers of other lengths, codes with letters, far more digits).  Other unknown
instances don't count, so what is to be discovered can't veto its context.  Patterns with ``SUPPORT`` instances that are known and a confidence of ``CONFIDENCE``
raise the scores of the unknown instances they match (one minus the product of the doubts), which count in the next
round.  In the end unknown tokens in confident patterns are spans of their pattern's
commonest kind, but for those that can't be such an identifier: foreign ones without letters.  Base spans always stay; added spans don't overlap them.

Defined cases: null and empty texts have no spans; equal rows get equal spans; rows that share a doc_id are told apart by
their texts; an empty table gives no rows; other columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, stored, tidy, with_text_hash

LEAST = 6
KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, ROUNDS, BROADCAST_ROWS = 5, 0.9, 3, 500_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
NUMERIC = re.compile(r"[+(]?[0-9][0-9()./:-]*[0-9]")
SPELT = re.compile(r"(?i)(?<!\S)[\w.+-]{1,64}\s[(\[]?at[)\]]?\s[\w-]{1,64}(?:\s[(\[]?dot[)\]]?\s[\w-]{1,64}){1,3}")
EDGES = ".,;:!?\"'()[]{}<>*#%&$|"

# Dates, times and amounts as they are written.
DATED = r"^(\d{4}[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])|(0?[1-9]|[12]\d|3[01])[-/.](0?[1-9]|[12]\d|3[01])[-/.](\d{4}|\d{2}))([T ]\d{1,2}:.*)?$|^\d{1,2}:\d{2}(:\d{2})?$"
AMOUNT = r"^\d{1,3}([.,]\d{3})*[.,]\d{1,2}$|^\d{1,3}(,\d{3})+$"

FOUND = "doc_id long, text_hash long, base array<struct<kind:int,start:int,end:int>>, seen array<struct<patterns:array<string>,instance:string,kind:int,start:int,end:int>>"
SPANS = "array<struct<kind:int,start:int,end:int,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back to the longest local part and on to the domain; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    out = [(0, a, z) for a, z in emails(text)]
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                out.append((1, at, end))
            at = end + 1
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def seen_tokens(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and other possible identifiers of a text with their patterns."""
    spots = [(a, z, k) for k, a, z in base]
    taken = sorted((a, z) for _, a, z in base)
    tokens = [m.span() for m in TOKEN.finditer(text)]
    run: list[tuple[int, int]] = []

    def within(a: int, z: int) -> bool:
        i = bisect_left(taken, (z, z))  # spans from here on start behind
        return any(y > a for _, y in taken[max(0, i - 4) : i])

    def offer(a: int, z: int):
        if not within(a, z):
            spots.append((a, z, -1))
            insort(taken, (a, z))

    def flush():
        if run and sum(map(str.isalnum, text[run[0][0] : run[-1][1]])) >= LEAST:
            offer(run[0][0], run[-1][1])
        run.clear()

    for m in SPELT.finditer(text) if "dot" in text.lower() else ():
        offer(*m.span())
    for first, last in tokens:
        a, z = first, last
        while a < z and text[a] in EDGES and text[a] != "(":
            a += 1
        while z > a and text[z - 1] in EDGES:
            z -= 1
        word = text[a:z]
        if "@" in word[1:-1] or sum(map(str.isdigit, word)) >= 6 and NUMERIC.fullmatch(word):
            flush()
            offer(a, z)
        elif any(map(str.isdigit, word)) and not within(a, z):
            if a > first:
                flush()
            run.append((a, z))
            if z < last:
                flush()
        else:
            flush()
    flush()
    out = []
    for a, z, kind in spots:
        before = [w.strip(EDGES).lower() for w in text[max(0, a - 200) : a].split()[-2:]]
        after = [w.strip(EDGES).lower() for w in text[z : z + 100].split()[:1]]
        before, after = ([re.sub(r"\d", "0", w) for w in x] for x in (["^", "^", *before][-2:], [*after, "$"][:1]))
        sort = "9" if any(map(str.isdigit, text[a:z])) and "@" not in text[a:z] and not SPELT.fullmatch(text[a:z]) else "@"
        out.append({"patterns": [f"{sort}|{before[0]}|{before[1]}|_", f"{sort}|{before[1]}|_|{after[0]}"], "instance": text[a:z], "kind": kind, "start": a, "end": z})
    return out


def found(docs: DataFrame) -> DataFrame:
    """``FOUND`` rows: base spans, and the possible identifiers with their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts, bases, seen = b.column("text"), [[]] * b.num_rows, [[]] * b.num_rows
            some = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|(?is:\sat[)\]]?\s.*\sdot[)\]]?\s)"), False).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
            for i in some:
                text = texts[i].as_py()
                base = base_spans(text)
                bases[i] = [dict(zip(("kind", "start", "end"), x)) for x in base]
                seen[i] = seen_tokens(text, base)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(bases, base_type), pa.array(seen, seen_type)], names=["doc_id", "text_hash", "base", "seen"])

    span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    base_type = pa.list_(pa.struct(span))
    seen_type = pa.list_(pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.string()), *span]))
    return with_text_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(tidy(run), FOUND)


def wrong_words(docs: DataFrame, slots: DataFrame, confidence: float = CONFIDENCE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``slot, wrong``: how many distinct plain words stand in the slots (patterns without the token's class).

    ``slots`` has the known instances ``n``.  A task that alone has seen enough words to refute a slot looks for no more of
    them: the count is exact for slots that stay confident, and large enough for the others."""
    few = slots.count() <= broadcast_rows
    sent = docs.sparkSession.sparkContext.broadcast({r["slot"]: r["n"] for r in slots.collect()} if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        ends = wanted and {x.split("|")[1 if x.endswith("_") else 0] for x in wanted}
        had: dict[str, set[str]] = defaultdict(set)  # without broadcast slots: of one slice
        for b in slices(batches, "text"):
            out: list[tuple[str, str]] = []
            if wanted is None:
                had.clear()
            for text in b.column("text").to_pylist():
                words = ["^", "^", *[re.sub(r"\d", "0", w.strip(EDGES).lower()) for w in (text or "").split()], "$"]
                for i in range(2, len(words) - 1):
                    if (ends is None or words[i - 1] in ends) and words[i].isalpha():
                        for slot in (f"{words[i - 2]}|{words[i - 1]}|_", f"{words[i - 1]}|_|{words[i + 1]}"):
                            if wanted is not None and (slot not in wanted or wanted[slot] / (wanted[slot] + len(had[slot])) < confidence):
                                continue
                            if words[i] not in had[slot]:
                                had[slot].add(words[i])
                                out.append((slot, words[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["slot", "word"])

    seen = docs.select("text").where("text is not null").mapInArrow(tidy(run), "slot string, word string")
    seen = seen if few else seen.join(slots, "slot", "left_semi")
    return seen.distinct().groupBy("slot").agg(F.count("*").alias("wrong"))


def shape(instance):
    """``{sort, digits}`` of an instance: date, amount, plain (only digits), letters, address or grouped."""
    sort = (F.when(F.contains(instance, F.lit("@")) | instance.rlike(r"(?i)\s[(\[]?at[)\]]?\s"), "address").when(instance.rlike(DATED), "date").when(instance.rlike(AMOUNT), "amount")
            .when(instance.rlike(r"^\d+$"), "plain").when(instance.rlike(r"\p{L}"), "letters").otherwise("grouped"))
    return F.struct(sort.alias("sort"), F.length(F.regexp_replace(instance, r"\D", "")).alias("digits"))


def foreign(of, known):
    """Whether a shape is another one than those of known instances (``{sorts, fewest, most}``)."""
    new = ~F.array_contains(known["sorts"], of["sort"])
    far = (of["digits"] < known["fewest"] - 2) | (of["digits"] > known["most"] + 2)
    return (new & of["sort"].isin("date", "amount", "letters")) | ((of["sort"] == "plain") & new & far) | ((of["sort"] != "address") & (of["digits"] > 2 * known["most"] + 4))


def confident_patterns(edges: DataFrame, docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pattern, kind, known`` (the shapes of its known instances) from distinct ``pattern, instance, kind`` edges (kind -1: unknown) and the texts."""
    first = edges.groupBy("instance").agg(F.max("kind").alias("kind"))
    scores = first.select("instance", "kind", F.when(F.col("kind") >= 0, 1.0).otherwise(0.0).alias("score"))
    links = stored(edges.select("pattern", "instance").distinct(), "pattern-edges")
    good, judged = None, None
    slot = F.regexp_replace("pattern", "^[@9][|]", "")
    for _ in range(rounds):
        scores = stored(scores, "instance-scores")
        known = F.when(F.col("kind") >= 0, F.col("kind"))
        both = links.join(scores, "instance").select("pattern", shape(F.col("instance")).alias("shape"), known.alias("kind"), (F.col("score") >= confidence).alias("sure"))
        by_shape = stored(both.groupBy("pattern", "shape", "kind").agg(F.count_if("sure").alias("n"), F.count_if(~F.col("sure")).alias("unknown")), "pattern-shapes")
        sure = F.col("n") > 0
        kinds = by_shape.where("kind is not null").groupBy("pattern", "kind").agg(F.sum(F.col("n") + F.col("unknown")).alias("of"))
        kinds = kinds.groupBy("pattern").agg(F.max(F.struct("of", -F.col("kind"))).alias("k")).select("pattern", (-F.col("k.col2")).alias("kind"))
        shapes = F.struct(F.collect_set(F.when(sure, F.col("shape.sort"))).alias("sorts"), F.min(F.when(sure, F.col("shape.digits"))).alias("fewest"), F.max(F.when(sure, F.col("shape.digits"))).alias("most"))
        of = by_shape.groupBy("pattern").agg(F.sum("n").alias("n"), shapes.alias("known")).where(F.col("n") >= support).join(kinds, "pattern")
        strange = by_shape.where("unknown > 0").join(of.select("pattern", "known"), "pattern").where(foreign(F.col("shape"), F.col("known"))).groupBy("pattern").agg(F.sum("unknown").alias("foreign"))
        of = stored(of.join(strange, "pattern", "left").na.fill(0, ["foreign"]).withColumn("slot", slot), "supported-patterns")
        slots = of.groupBy("slot").agg(F.max("n").alias("n"))
        new_slots = stored(slots if judged is None else slots.join(judged.select("slot", F.col("n").alias("of_n")), "slot", "left").where("of_n is null or of_n < n").select("slot", "n"), "new-slots")
        if not new_slots.isEmpty():
            more = new_slots.join(wrong_words(docs, new_slots, confidence, broadcast_rows), "slot", "left").na.fill(0, ["wrong"])
            judged = stored((more if judged is None else judged.unionByName(more)).groupBy("slot").agg(F.max("wrong").alias("wrong"), F.max("n").alias("n")), "wrong-words")
        of = of.withColumn("wrong", F.lit(0)) if judged is None else of.join(judged.select("slot", "wrong"), "slot")
        good = stored(of.withColumn("confidence", F.col("n") / (F.col("n") + F.col("wrong") + F.col("foreign"))).where(F.col("confidence") >= confidence).select("pattern", "kind", "known", "confidence"), "patterns")
        if good.isEmpty():
            break
        doubt = F.sum(F.ln(1 - F.least("confidence", F.lit(0.999))))
        new = links.join(good, "pattern").where(possible()).groupBy("instance").agg((1 - F.exp(doubt)).alias("raised"), F.mode("kind", deterministic=True).alias("as_kind"))
        now = scores.join(new, "instance", "left")
        sure = F.coalesce(F.col("raised"), F.lit(0.0)) >= confidence
        scores = now.select("instance", F.when((F.col("kind") < 0) & sure, F.col("as_kind")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("score") == 1, 1.0).otherwise(F.coalesce("raised", F.lit(0.0))).alias("score"))
    return good.select("pattern", "kind", "known")


def possible():
    """Rows with ``instance`` and a pattern's ``known`` whose instance can be such an identifier: not foreign, but for letters."""
    of = shape(F.col("instance"))
    return ~foreign(of, F.col("known")) | ((of["sort"] == "letters") & (of["digits"] <= 2 * F.col("known.most") + 4))


def added(rows: DataFrame, docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, text_hash, more``: spans that confident patterns add to documents; ``rows``: stored ``FOUND`` of ``docs``."""
    seen = rows.select("doc_id", "text_hash", F.explode("seen").alias("s")).select("doc_id", "text_hash", "s.*")
    spots = stored(seen.withColumn("pattern", F.explode("patterns")).drop("patterns"), "identifier-spots")
    good = confident_patterns(spots.select("pattern", "instance", "kind").distinct(), docs, support, confidence, rounds, broadcast_rows)
    hits = spots.where("kind < 0").drop("kind").join(good, "pattern").where(possible())
    each = hits.groupBy("doc_id", "text_hash", "start", "end").agg(F.min("kind").cast("int").alias("kind"))
    return each.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end", F.lit(False).alias("base"))).alias("more"))


def _with_added(rows: DataFrame, more: DataFrame, broadcast_rows: int) -> DataFrame:
    """Left join on doc_id (null equals null) and text."""
    more = stored(more, "added-spans").withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
    more = F.broadcast(more) if more.count() <= broadcast_rows else more
    return rows.join(more, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left").drop("of_id", "of_hash")


def find(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, spans`` of every row; spans as of ``SPANS``, by kind, then start; kind: its number in ``KINDS``."""
    rows = stored(found(docs), "personal-data")
    both = _with_added(rows.select("doc_id", "text_hash", "base"), added(rows, docs, support, confidence, rounds, broadcast_rows), broadcast_rows)
    own = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base")))
    return both.select("doc_id", F.array_sort(F.concat(own, F.coalesce(F.col("more"), F.array().cast(SPANS)))).alias("spans"))


def redact(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in brackets, and ``n_chars`` of the new text.

    Only texts with a span leave the JVM."""
    rows = stored(found(docs), "personal-data").where("size(base) > 0 or size(seen) > 0")
    both = _with_added(rows.select("doc_id", "text_hash", "base"), added(rows, docs, broadcast_rows=broadcast_rows), broadcast_rows)
    spans = F.concat(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))),
                     F.coalesce(F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    marked = stored(both.select("doc_id", "text_hash", spans.alias("spans")).where("size(spans) > 0").dropDuplicates(["doc_id", "text_hash"]), "marked-rows")
    of_id, of_hash, marks = fresh(docs, "of_id", "of_hash", "spans")
    of = marked.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("spans").alias(marks))
    of = F.broadcast(of) if marked.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0))).first()[0] <= broadcast_rows else of
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_hash))
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [masked(t, [(s["kind"], s["start"], s["end"]) for s in spans]) for t, spans in zip(b.column("text").to_pylist(), b.column(marks).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names=names)

    new = docs.join(of, same).select(*[f"`{c}`" for c in names], marks).mapInArrow(tidy(run), schema)
    out = docs.join(of.select(of_id, of_hash), same, "left_anti").unionByName(new)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans become one, named by the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
