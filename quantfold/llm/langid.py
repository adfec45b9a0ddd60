"""Language ID: a byte convolutional network over fixed-length windows.

Training: a bounded sample of labelled rows (at most about ``SAMPLE`` rows a language, chosen by a hash of
doc_id) reaches the driver, as ``CROP`` characters at a hashed place of each text; the network is
trained there with numpy on windows of varied length.

Prediction: every byte of the whole lower-cased text, in windows of ``WINDOW`` bytes.  A window's
log-probabilities count by its bytes; the text's language is the one with the largest weighted mean.
``score`` is the share of that language among the exponentials of these means.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ``held_out`` is false
for a null doc_id, and such rows are not learned from; if no labelled row exists every row is
``und``; equal rows are predicted one by one; an empty table gives no rows.  Only the text is an
input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, large, slices, tidy, with_text_hash, without_rows
from .convnet import ConvNet, softmax

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 8
SAMPLE, CROP, STEPS = 1500, 600, 900


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """``(lang, text)`` rows, ``per_language`` of each in expectation (all, if fewer)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003)) / 1_000_003
    place = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.lit(1), F.length("text") - CROP + 1).cast("long")).cast("int") + 1
    rows = known.where(draw < share[F.col("lang")]).select("lang", F.substring("text", place, F.lit(CROP)).alias("t"))
    return sorted((r["lang"], r["t"]) for r in rows.collect())


def train(sample: list[tuple[str, str]], seed: int = 0) -> tuple[list[str], dict] | None:
    """``(languages, weights)``."""
    if not sample:
        return None
    langs = sorted({x for x, _ in sample})
    truth = np.array([langs.index(x) for x, _ in sample])
    texts = [np.frombuffer(t.lower().encode(), np.uint8).astype(np.int64) for _, t in sample]
    net = ConvNet(256, EMBED, WIDTHS, FILTERS, len(langs), seed)

    def vary(t: np.ndarray, rnd) -> np.ndarray:
        n = WINDOW if rnd.random() < 0.6 else rnd.integers(6, WINDOW)
        a = rnd.integers(0, max(1, len(t) - n + 1))
        return t[a : a + n]

    def gradient(rows, outputs):
        p = softmax(outputs)
        p[np.arange(len(rows)), truth[rows]] -= 1
        return p / len(rows)

    net.fit(texts, np.arange(256)[:, None], gradient, -(-STEPS * 64 // len(texts)), seed=seed, vary=vary)
    return langs, net.p


class Windows:
    """The trained network as two tables over pairs of neighbouring bytes."""

    def __init__(self, p: dict):
        e = p["embed"].copy()
        e[0] = 0  # padding
        first, second = [], []
        for w in WIDTHS:
            row = [e @ p[f"w{w}"][j] for j in range(w)] + [np.zeros((256, FILTERS), np.float32)] * (4 - w)
            first.append(row[0][:, None] + row[1][None] + p[f"b{w}"])
            second.append(row[2][:, None] + row[3][None])
        self.first = np.ascontiguousarray(np.concatenate(first, -1).reshape(65536, -1))
        self.second = np.ascontiguousarray(np.concatenate(second[1:], -1).reshape(65536, -1))
        self.out, self.bias = p["out"], p["bias"]
        self.padding = np.concatenate([p[f"b{w}"] for w in WIDTHS])  # every filter's response to padding

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """``windows``: uint8, a window a row, followed by two zero bytes in three more columns."""
        out = np.empty((len(windows), len(self.bias)))
        for a in range(0, len(windows), 64):
            x = windows[a : a + 64].astype(np.int64)
            pair = (x[:, :-1] << 8) | x[:, 1:]
            r = self.first[pair[:, :WINDOW]]
            r[:, :, FILTERS:] += self.second[pair[:, 2 : WINDOW + 2]]
            o = np.maximum(np.maximum(r.max(1), self.padding), 0) @ self.out + self.bias
            out[a : a + 64] = o - o.max(1, keepdims=True)
        return out - np.log(np.exp(out).sum(1, keepdims=True))


def predict(docs: DataFrame, model: tuple[list[str], dict] | None, *keep: str) -> DataFrame:
    """``doc_id, *keep, lang_pred, score`` of every row of ``docs`` (doc_id, text); ``keep``: more long columns."""
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Windows(model[1]) if model else None
        for b in slices(batches, "text", 4 << 20):
            texts = large(b.column("text"))
            known = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) & (net is not None)
            score, lang = np.zeros(b.num_rows), np.full(b.num_rows, "und", object)
            if known.any():
                score[known], which = score_texts(net, texts.filter(pa.array(known)))
                lang[known] = np.array(model[0], object)[which]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    rows = docs.select(*(F.col(c).cast("long").alias(c) for c in names), "text")
    return rows.mapInArrow(tidy(run), ", ".join([*(f"{c} long" for c in names), "lang_pred string, score double"]))


def accepted(docs: DataFrame, model: tuple[list[str], dict] | None, least: float) -> DataFrame:
    """Rows of ``docs`` that have a language with at least that score."""
    rows = with_text_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return without_rows(docs, predict(rows, model, "text_hash").where((F.col("lang_pred") == "und") | (F.col("score") < least)))


def score_texts(net: Windows, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lower = large(pc.utf8_lower(texts))
    at = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2], np.uint8)
    n = np.diff(at)
    count = -(-n // WINDOW)
    first = np.cumsum(count) - count
    laid = np.zeros(int(count.sum()) * WINDOW + 3, np.uint8)
    for a, z, w in zip(at[:-1].tolist(), at[1:].tolist(), (first * WINDOW).tolist()):
        laid[w : w + z - a] = data[a:z]
    windows = np.zeros((int(count.sum()), WINDOW + 3), np.uint8)
    windows[:, :WINDOW] = laid[:-3].reshape(-1, WINDOW)
    size = np.full(len(windows), float(WINDOW))
    size[first + count - 1] = n - (count - 1) * WINDOW
    mean = np.add.reduceat(net.log_probabilities(windows) * size[:, None], first, axis=0) / n[:, None]
    p = softmax(mean)
    which = p.argmax(1)
    return p[np.arange(len(p)), which], which


def language_query(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32 of the doc_id is not 2 modulo 4 and predict every row."""
    bucket = crc_bucket(F.col("doc_id"), 4)
    model = train(labelled_sample(docs.where(bucket != 2)))
    return predict(docs, model).select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
