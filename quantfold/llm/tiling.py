"""Benchmark decontamination by greedy string tiling.

Words are compared lower-cased and without punctuation at their edges.  Seeds are the Karp-Rabin hashes of every
``SEED`` words of the benchmark items, joined to the same hashes rolled over every whole text.  For each
pair of a text and an item that share a seed, neighbouring seeds on a diagonal are runs of equal words;
the longest run that no tile overlaps is marked as a tile again and again, what overlaps a tile is cut,
and runs shorter than ``SEED`` words end.  Tiles may lie in any order, so reordered passages count.  A
text is contaminated by an item of whose words tiles cover at least ``COVERAGE``.

The benchmark goes to the executors in blocks of at most ``BLOCK_WORDS`` words (16 bytes each); each
further block takes another pass over the texts.

Defined cases: items of fewer than ``SEED`` words, null ones included, match nothing; null and empty
texts are clean; equal rows are judged one by one, and so are rows with a null doc_id; items that
repeat are matched one by one; empty tables give clean texts or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import large, slices, stored, tidy, with_text_hash, without_rows, words
from .substrings import rolled

SEED, COVERAGE, BLOCK_WORDS = 5, 0.8, 1_000_000
#: Pairs of places with equal seeds that are looked at together (about ten arrays of 8 bytes each).
PAIRS = 2_000_000
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
VERDICT = ("coverage", "items")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, 64-bit hashes)`` of the words that have a letter or digit."""
    from xxhash import xxh64_intdigest

    offsets, flat = words(texts)
    coded = flat.dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), EDGES, "").to_pylist()
    of = np.fromiter((xxh64_intdigest(x, 9) if x else 0 for x in plain), np.uint64, len(plain))
    h = of[coded.indices.to_numpy()] if len(plain) else np.zeros(0, np.uint64)
    full = h != 0
    return np.concatenate([[0], np.cumsum(full)])[offsets], h[full]


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, ids: list[int], texts: list[str], size: int = SEED):
        offsets, h = word_hashes(pa.array(texts, pa.large_string()))
        self.ids, self.size = ids, size
        self.lens = np.diff(offsets)
        seeds = rolled(h, size)
        n = np.maximum(self.lens - size + 1, 0)
        item = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        seeds = seeds[offsets[:-1][item] + at]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.at = seeds[order], item[order], at[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def judge(self, texts: pa.Array, least: float = COVERAGE) -> list[list[tuple[int, float]]]:
        """``(item_id, coverage)`` for each text: all items covered by ``least`` or more, and the one that is covered most."""
        offsets, h = word_hashes(texts)
        seeds = rolled(h, self.size)
        hit = np.flatnonzero(self.maybe[(seeds & np.uint64((1 << 20) - 1)).astype(np.int64)])
        a = np.searchsorted(self.seeds, seeds[hit], "left")
        n = np.searchsorted(self.seeds, seeds[hit], "right") - a
        hit, a, n = hit[n > 0], a[n > 0], n[n > 0]
        text = np.searchsorted(offsets, hit, "right") - 1
        inside = hit + self.size <= offsets[text + 1]
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(offsets) - 1)]
        text, at, a, n = text[inside], (hit - offsets[text])[inside], a[inside], n[inside]
        total, lo, parts = np.cumsum(n), 0, []
        while lo < len(n):  # a bounded number of pairs at a time; what is kept are runs
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
            row = np.repeat(np.arange(lo, hi), n[lo:hi])
            s = np.arange(len(row)) + np.repeat(a[lo:hi] - (np.cumsum(n[lo:hi]) - n[lo:hi]), n[lo:hi])
            parts.append(_joined(text[row], self.item[s], at[row], self.at[s], np.ones(len(row), np.int64)))
            lo = hi
        if parts:
            t, i, p, j, count = (np.concatenate(x) for x in zip(*parts)) if len(parts) == 1 else _joined(*(np.concatenate(x) for x in zip(*parts)))
            self._tile(t, i, p, j, count + self.size - 1, least, out)
        return out

    def _tile(self, t: np.ndarray, i: np.ndarray, p: np.ndarray, j: np.ndarray, length: np.ndarray, least: float, out: list[list[tuple[int, float]]]) -> None:
        """Of each text, items are tiled by falling bound as long as they can reach ``least`` or more than the best so far."""
        # Words of the item that any run holds: no tiling covers more.
        order = np.lexsort((j, i, t))
        pair = np.cumsum(np.append(True, (np.diff(t[order]) != 0) | (np.diff(i[order]) != 0))) - 1
        shift = pair * (int(self.lens.max()) + 1)
        reach = np.maximum.accumulate(shift + j[order] + length[order])
        held = np.maximum(0, shift + j[order] + length[order] - np.maximum(shift + j[order], np.append(0, reach[:-1])))
        first = np.flatnonzero(np.append(True, np.diff(pair) != 0))
        most = np.add.reduceat(held, first) / self.lens[i[order][first]]
        runs = np.stack([p, j, length])[:, order]
        ends = np.append(first[1:], len(order))
        best: dict[int, float] = {}
        for k in np.lexsort((-most, t[order][first])).tolist():
            of, item = int(t[order[first[k]]]), int(i[order[first[k]]])
            if most[k] < least and most[k] <= best.get(of, 0.0):
                continue
            marked = tile_runs(runs[:, first[k] : ends[k]], self.size)
            coverage = sum(m for _, _, m in marked) / int(self.lens[item])
            best[of] = max(best.get(of, 0.0), coverage)
            out[of].append((self.ids[item], coverage))


def _joined(t: np.ndarray, i: np.ndarray, p: np.ndarray, j: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of seeds (text, item, places in both, seeds) that follow one another on a diagonal as one, by text and item."""
    order = np.lexsort((p, p - j, i, t))
    t, p, i, j, count = t[order], p[order], i[order], j[order], count[order]
    new = np.append(True, (np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(p - j) != 0) | (p[1:] != p[:-1] + count[:-1]))
    head = np.flatnonzero(new)
    return t[head], i[head], p[head], j[head], np.add.reduceat(count, head)


def tile_runs(runs: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(text position, item position, words)`` from runs (rows: text position, item position, words)."""
    p0, j0 = int(runs[0].min()), int(runs[1].min())
    in_text = np.zeros(int((runs[0] + runs[2]).max()) - p0, bool)
    in_item = np.zeros(int((runs[1] + runs[2]).max()) - j0, bool)
    heap = [(-n, j - j0, p - p0) for p, j, n in runs.T.tolist()]
    heapify(heap)
    out = []
    while heap:
        n, j, p = heappop(heap)
        taken = in_text[p : p - n] | in_item[j : j - n]
        if not taken.any():
            in_text[p : p - n] = in_item[j : j - n] = True
            out.append((p + p0, j + j0, -n))
            if in_item.all():
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]])))  # what the tiles leave of the run
        for a, z in edges.reshape(-1, 2).tolist():
            if z - a >= size:
                heappush(heap, (a - z, j + a, p + a))
    return out


def tiles(seeds: list[tuple[int, int]], size: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(text position, item position, words)`` from positions of shared seeds."""
    runs, now = [], None
    for p, j in sorted(seeds, key=lambda x: (x[0] - x[1], x[0])):
        if now and p - j == now[0] - now[1] and p == now[0] + now[2] - size + 1:
            now[2] += 1
        else:
            now = [p, j, size]
            runs.append(now)
    return tile_runs(np.array(runs).T, size) if runs else []


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items, read one block after another; a hash of the id and text decides on the block."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        got = sorted((r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())
        yield Items([i for i, _ in got], [t for _, t in got])


def judged(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows of ``docs`` with its columns but text, ``coverage`` (the largest) and ``items`` (ids of the items that contaminate)."""
    own = [c for c in docs.columns if c not in (*VERDICT, "text")]
    df = docs.select(*own, "text", F.lit(0.0).alias("coverage"), F.array().cast("array<long>").alias("items"))
    now, last = next(parts := blocks(benchmark, block_words)), False
    while not last:
        after = next(parts, None)
        last = after is None
        df = _pass(df, docs.sparkSession.sparkContext.broadcast(now), least, keep_text=not last)
        now, df = after, df if last else stored(df, "judged")
    return df


def _pass(df: DataFrame, sent, least: float, keep_text: bool) -> DataFrame:
    names = [c for c in df.columns if keep_text or c != "text"]
    schema = T.StructType([df.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = sent.value.judge(large(b.column("text")), least)
            coverage = [max([x, *(c for _, c in f)]) for x, f in zip(b.column("coverage").to_pylist(), found)]
            items = [sorted([*x, *(i for i, c in f if c >= least)]) for x, f in zip(b.column("items").to_pylist(), found)]
            done = {"coverage": pa.array(coverage, pa.float64()), "items": pa.array(items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([done[c] if c in done else b.column(c) for c in names], names=names)

    return df.mapInArrow(tidy(run), schema)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` that no item contaminates."""
    found = judged(with_text_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), benchmark, least)
    return without_rows(docs, found.where(F.size("items") > 0).select("doc_id", "text_hash"))
