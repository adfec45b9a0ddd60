"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed rows, of the whole word and of its first letters
(``STEMS``), so unseen forms of a known stem count.  Filters of several widths run over the words, their
largest responses over the whole text are pooled, and a linear layer gives the toxicity logit and,
as a second task, language logits.  Every labelled row is learned from, with its whole text: the rows are
stored once in shards of about ``SHARD_ROWS`` by a hash of the doc_id; in each epoch every shard takes the
common weights through its rows by Adam, in a task, and the changes of weights and of Adam's averages are
averaged in Spark (of an embedding row: over the shards that touched it).  What reaches the driver are these.

Thresholds are calibrated by language on a fifth of the labelled rows, which the weights are not fitted to:
the logit with the best F0.5 over all of them, found by running sums over ranges of logits, shrunk to the
common threshold where a language has few toxic rows.  At scoring the language is the network's own second
output, so only the text is an input.  ``score`` is the logistic of the logit less its threshold:
0.5 is the threshold of the text's language.

Defined cases: null and empty texts are texts without words and get the network's answer for no
words; rows without a label are not learned from; without any labelled row of each class every
score is 0; rows with a null doc_id are not learned from; equal rows are scored one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, large, merged, slices, stored, tidy, words
from .convnet import ConvNet, softmax

BUCKETS, STEMS, EMBED, WIDTHS, FILTERS = 1 << 17, (4, 6), 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 4, 32, 0.01
#: Labelled rows that one task learns from before weights are averaged; more of them are looked up by a shuffle.
SHARD_ROWS, BROADCAST_ROWS = 32768, 1_000_000
#: Text that is learned from in random order, in bytes.
SEGMENT = 16 << 20
#: Changes of a block of ``EMBED`` weights and of both of Adam's averages, counted in ``UNIT``.
MOVED, UNIT = [f"d{i}" for i in range(3 * EMBED)], 2.0**-44
#: Different logits in one range.
RANGE_ROWS = 100_000
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def hashed(distinct: pa.Array) -> np.ndarray:
    """Embedding rows of each word: of itself and of its stems; 0 for one without letters or digits."""
    plain = pc.replace_substring_regex(pc.utf8_lower(distinct), EDGES, "")
    parts = [plain, *(pc.utf8_slice_codeunits(plain, 0, n) for n in STEMS)]
    out = np.zeros((len(plain), len(parts)), np.int64)
    for i, x in enumerate(parts):
        coded = x.dictionary_encode()
        of = np.array([zlib.crc32(w.encode(), i) % (BUCKETS - 1) + 1 if w else 0 for w in coded.dictionary.to_pylist()], np.int64)
        out[:, i] = of[coded.indices.to_numpy()] if len(of) else 0
    return out


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(offsets, number of the distinct word, its embedding rows)``."""
    offsets, flat = words(texts)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy().astype(np.int64), hashed(coded.dictionary)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(shard, doc_id, text, lang, toxic, held)`` of every labelled row of ``docs`` that has a text, stored; ``held``: not
    for the weights.  Nothing is left out."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marked.count()
    shards = max(1, -(-n // SHARD_ROWS))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = F.broadcast(marked) if n <= BROADCAST_ROWS else marked.hint("merge")
    rows = texts.join(found, "doc_id").repartition(shards, "doc_id")
    rows = rows.sortWithinPartitions(F.xxhash64("doc_id", F.lit(3)), "doc_id", F.xxhash64("text"), "lang")
    held = (crc_bucket(F.col("doc_id"), 5) == 1).alias("held")
    return stored(rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), "toxic", held), "labelled")


def blocks(p: dict) -> np.ndarray:
    """All weights as rows of ``EMBED`` numbers, the embedding first."""
    rest = np.concatenate([p[k].ravel() for k in sorted(p) if k != "embed"])
    return np.concatenate([p["embed"], np.resize(np.append(rest, np.zeros(-len(rest) % EMBED, rest.dtype)), (-(-len(rest) // EMBED), EMBED))])


def weights(table: np.ndarray, like: dict) -> dict:
    """The weights of :func:`blocks`, in the shapes of ``like``."""
    p, rest, at = {"embed": table[:BUCKETS].copy()}, table[BUCKETS:].ravel(), 0
    for k in sorted(like):
        if k != "embed":
            p[k], at = rest[at : at + like[k].size].reshape(like[k].shape).copy(), at + like[k].size
    return p


def _vary(t: np.ndarray, rnd) -> np.ndarray:  # words drop out, so that no single word decides
    return t[rnd.random(len(t)) < 0.9]


def _learned(langs: list[str], given, done: int, passes: int, steps: int, epochs: int, seed: int):
    """``passes`` passes over each shard of a task, after ``done`` ones, from the common weights and averages of Adam (None: from
    the start): the changes of the blocks that changed, as whole numbers of ``UNIT``, so that sums don't depend on their order."""
    number_of = {x: i for i, x in enumerate(langs)}

    def change(net: ConvNet, moments: tuple[dict, dict], state: tuple) -> pa.RecordBatch:
        moved = np.concatenate([blocks(x) for x in (net.p, *moments)], 1) - np.concatenate([blocks(x) for x in state], 1)
        on = np.flatnonzero(moved.any(1))
        d = np.rint(moved[on].astype(np.float64) / UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *(pa.array(x) for x in d.T)], names=["block", *MOVED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = state = net = None
        for t in merged(batches, "text", SEGMENT):
            of = t.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                state = state or (given.value if given else start(langs, seed))
                if of[a] != shard:
                    if net:
                        yield change(net, moments, state)
                    shard, step, net = of[a], 0, ConvNet(2, EMBED, WIDTHS, FILTERS, 1 + len(langs))
                    net.p, *moments = ({k: v.copy() for k, v in x.items()} for x in state)
                    rnd = np.random.default_rng([seed, done, int(shard)])
                part = t.slice(a, z - a)
                offsets, number, pair = symbols(large(part.column("text")))
                truth = part.column("toxic").to_numpy()
                lang = np.array([number_of[x] for x in part.column("lang").to_pylist()])

                def gradient(rows, outputs):
                    g = np.empty_like(outputs)
                    g[:, 0] = 1 / (1 + np.exp(-outputs[:, 0])) - truth[rows]
                    g[:, 1:] = softmax(outputs[:, 1:])
                    g[np.arange(len(rows)), 1 + lang[rows]] -= 1
                    g[:, 1:] *= 0.3
                    return g / len(rows)

                for _ in range(passes):
                    order = rnd.permutation(len(truth))
                    for i in range(0, len(order), BATCH):
                        rows = order[i : i + BATCH]
                        step += 1
                        rate = RATE * (1 - (done * steps + min(step, passes * steps)) / (epochs * steps + 1))
                        net.step(rows, [_vary(number[offsets[j] : offsets[j + 1]], rnd) for j in rows], pair, gradient, moments, done * steps + step, rate)
        if net:
            yield change(net, moments, state)

    return tidy(run)


def start(langs: list[str], seed: int) -> tuple[dict, dict, dict]:
    """Weights and averages of Adam before the first step."""
    net = ConvNet(BUCKETS, EMBED, WIDTHS, FILTERS, 1 + len(langs), seed)
    return (net.p, *net.moments())


def train(rows: DataFrame, seed: int = 0) -> dict | None:
    """Weights, languages and thresholds, from the rows of :func:`labelled_sample`."""
    n = {(r["held"], r["toxic"]): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}
    if len({toxic for _, toxic in n}) < 2:
        return None
    apart = len(n) == 4  # else all rows serve both
    fitted, judged = (rows.where(~F.col("held")), rows.where("held")) if apart else (rows, rows)
    size = sum(x for (held, _), x in n.items() if not (apart and held))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    shards, length = fitted.agg(F.countDistinct("shard"), F.sum(F.octet_length("text"))).first()
    state, steps = start(langs, seed), -(-size // (shards * BATCH))
    epochs = EPOCHS * max(1, min(8, 3000 * shards // size))
    passes = epochs if shards == 1 and length <= SEGMENT else 1  # nothing to average: one task goes on
    for done in range(0, epochs, passes):
        given = rows.sparkSession.sparkContext.broadcast(state) if done else None
        moved = fitted.select("shard", "text", "lang", "toxic").mapInArrow(_learned(langs, given, done, passes, steps, epochs, seed), "block int, " + ", ".join(f"{c} long" for c in MOVED))
        mean = moved.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in MOVED)).toArrow()  # a row a block
        table = np.concatenate([blocks(x) for x in state], 1).astype(np.float64)
        table[mean.column("block").to_numpy()] += np.stack([mean.column(c).to_numpy() for c in MOVED], 1) * (UNIT / mean.column("n").to_numpy()[:, None])
        table[:, 2 * EMBED :] = np.maximum(table[:, 2 * EMBED :], 0)
        state = tuple(weights(x.astype(np.float32), state[0]) for x in np.split(table, 3, 1))
        if given:
            given.destroy()  # its files go as well
    p = state[0]
    best = best_thresholds(logits(judged, p))
    common = best[-1][0]
    found = [best.get(k, (common, 0)) for k in range(len(langs))]
    return {"net": p, "langs": langs, "thresholds": np.array([(few * t + 20 * common) / (few + 20) for t, few in found])}


def logits(rows: DataFrame, p: dict) -> DataFrame:
    """``(own, logit, toxic)``: the language that the network sees, and its toxicity logit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            out = responses(p, *symbols(large(b.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 1:].argmax(1).astype(np.int32)), pa.array(out[:, 0].astype(np.float64)), b.column("toxic")], names=["own", "logit", "toxic"])

    return rows.select("text", "toxic").mapInArrow(tidy(run), "own int, logit double, toxic int")


def best_thresholds(scored: DataFrame, range_rows: int = RANGE_ROWS) -> dict[int, tuple[float, int]]:
    """For each ``own``, and -1 for all rows: the middle of the range of logits that cuts with the best F0.5, which weighs
    precision more, and the number of toxic rows.  Logits are dealt in ranges, whose sums the driver adds up."""
    every = scored.select(F.explode(F.array("own", F.lit(-1))).alias("own"), "logit", "toxic")
    same = stored(every.groupBy("own", "logit").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hit")), "logits")
    ranged = same.repartitionByRange(max(1, -(-same.count() // range_rows)), "own", F.desc("logit")).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "logit-ranges")
    sums = ranged.groupBy("own", "part").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.max("logit").alias("top")).collect()  # a row a range and language
    sums = sorted(sums, key=lambda r: (r["own"], r["part"]))
    total = {}
    for r in sums:
        total[r["own"]] = total.get(r["own"], 0) + r["hit"]
    before, own, n, hit = [], None, 0, 0
    for r, after in zip(sums, [*sums[1:], None]):
        if r["own"] != own:
            own, n, hit = r["own"], 0, 0
        before.append((own, r["part"], n, hit, total[own], after["top"] if after and after["own"] == own else None))
        n, hit = n + r["n"], hit + r["hit"]
    known = scored.sparkSession.createDataFrame(before, "own int, part int, n0 long, hit0 long, hits long, below double")
    falling = Window.partitionBy("own", "part").orderBy(F.desc("logit"))
    sofar = falling.rowsBetween(Window.unboundedPreceding, 0)
    f = 1.25 * (F.col("hit0") + F.sum("hit").over(sofar)) / (F.col("n0") + F.sum("n").over(sofar) + 0.25 * F.col("hits"))
    after = F.coalesce(F.lead("logit").over(falling), F.col("below"))
    cut = F.coalesce((F.col("logit") + after) / 2, F.col("logit") - 1)
    at = ranged.join(F.broadcast(known), ["own", "part"]).select("own", "logit", f.alias("f"), cut.alias("cut"))
    best = at.groupBy("own").agg(F.max_by("cut", F.struct("f", "logit")).alias("cut")).collect()
    return {r["own"]: (r["cut"], total[r["own"]]) for r in best}


def responses(p: dict, offsets: np.ndarray, number: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Outputs of the network for texts, with one table row for each distinct word."""
    n = np.diff(offsets)
    e = np.concatenate([p["embed"][pair].sum(1), np.zeros((1, EMBED), np.float32)])  # the last: padding
    pad = max(WIDTHS)
    laid = np.full(len(number) + pad * len(n), len(pair), np.int64)
    starts = offsets[:-1] + pad * np.arange(len(n))
    laid[np.arange(len(number)) + np.repeat(pad * np.arange(len(n)), n)] = number
    spans = np.stack([starts, starts + n + 1], 1).ravel()  # a text and one padding
    top = []
    for w in WIDTHS:
        r = (e @ p[f"w{w}"][0] + p[f"b{w}"])[laid]
        for j in range(1, w):
            r[:-j] += (e @ p[f"w{w}"][j])[laid[j:]]
        top.append(np.maximum.reduceat(r, spans, axis=0)[::2])
    return np.maximum(np.concatenate(top, 1), 0) @ p["out"] + p["bias"]


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            s = np.zeros(b.num_rows)
            if model:
                out = responses(model["net"], *symbols(large(b.column("text"))))
                s = 1 / (1 + np.exp(-np.clip(out[:, 0] - model["thresholds"][out[:, 1:].argmax(1)], -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of rows whose crc32 of the doc_id is not 0 modulo 5 and score every row."""
    bucket = crc_bucket(F.col("doc_id"), 5)
    model = train(labelled_sample(docs, labels.where(bucket != 0)))
    return score(docs, model).select("doc_id", F.coalesce(bucket == 0, F.lit(False)).alias("held_out"), "score", "predicted")
