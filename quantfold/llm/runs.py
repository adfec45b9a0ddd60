"""Periodic runs of words: descending-LCP Kruskal over suffix classes.

A run is a stretch of words with smallest period q, at least ``max(shortest, repeats * q)`` long, that
no neighbouring word extends with that period.

1. The suffixes of every text are sorted by prefix doubling (numpy; groups of one are left alone), which also
   gives the length of the longest common prefix (LCP) of neighbours in that order.
2. Neighbours are united by decreasing LCP.  A class (union-find) holds its positions in order; at level
   ``l`` it holds suffixes that share ``l`` words.  Positions ``i < j`` that become adjacent in a class
   share exactly ``l`` words, so ``j - i <= l`` makes ``[i, j + l)`` periodic: a seed of a run.
3. A run ``[s, e)`` of period q is seeded by ``(s, s + q)`` at level ``e - s - q``: no other suffix
   between them shares so many words, since q is the smallest period.  A seed that can be extended to the left belongs to a run
   that another seed gives, and is skipped; to the right a seed ends where its words differ.  So every run
   comes out once, with its smallest period and its exact ends.

A run that is long enough needs an LCP of at least ``least_lcp``; texts in which no so many words occur
twice are done without sorting, and classes below that level are never united.

Scale: a text is judged by itself, so nothing is shuffled.  Tasks work on slices of a few MB of text; the
longest text bounds a task's memory (about 4 bytes a word for every doubling of its longest repeat).

Defined cases: a null or empty text has no words and no runs; rows are judged one by one, so repeated rows and
null ids stay as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, large, merged, tidy, words

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
SHORTEST, REPEATS = 6, 4
SLICE = 4 << 20


def least_lcp(shortest: int, repeats: int) -> int:
    """The smallest LCP of a seed of an accepted run: ``max(shortest, repeats * q) - q`` over all q.

    >>> least_lcp(6, 4), least_lcp(2, 2), least_lcp(9, 2)
    (5, 1, 5)
    """
    return min(max(shortest, repeats * q) - q for q in range(1, shortest + 1))


def repeated_grams(codes: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Which documents may hold ``k`` equal words in a row twice (hashes: some more may be named)."""
    n = len(codes) - k + 1
    out = np.zeros(n_docs, bool)
    if n < 2:
        return out
    h = doc[:n].astype(np.uint64)
    for i in range(k):
        h = (h ^ codes[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
    h = h[whole]
    order = np.argsort(h)
    s = h[order]
    out[doc[whole[order[np.flatnonzero(s[1:] == s[:-1])]]]] = True
    return out


def suffix_neighbours(codes: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(left, right, lcp)`` of neighbours in the order of suffixes of each document, where they share a word.

    ``ends``: the end of the document of every position."""
    n = len(codes)
    key = (doc.astype(np.int64) << 32) | codes.astype(np.int64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels, lcp, slots, width = [], np.zeros(n, np.int64), at, 1
    while True:
        alone = new & np.append(new[1:], True)
        slots, first = slots[~alone], new[~alone]
        if not len(slots):
            break
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        pos = order[slots]
        after = pos + width
        inside = after < ends[pos]
        key = rank[pos] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        pos, key = pos[o], key[o]
        order[slots] = pos
        new = np.append(True, key[1:] != key[:-1])
        split = np.flatnonzero(new & ~first)  # neighbours that shared ``width`` words and part here
        x, y = pos[split - 1] + width, pos[split] + width
        shared = np.full(len(split), width, np.int64)
        for t in reversed(range(len(levels) - 1)):
            both = np.flatnonzero((x < ends[pos[split - 1]]) & (y < ends[pos[split]]))
            both = both[levels[t][x[both]] == levels[t][y[both]]]
            shared[both] += 1 << t
            x[both] += 1 << t
            y[both] += 1 << t
        lcp[slots[split]] = shared
        rank[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        width *= 2
    right = np.flatnonzero(lcp)
    return order[right - 1], order[right], lcp[right]


def _accepted(u: int, v: int, shared: int, codes: np.ndarray, starts: np.ndarray, shortest: int, repeats: int) -> bool:
    length = v - u + shared
    if length < shortest or length < repeats * (v - u):
        return False
    return u == starts[u] or codes[u - 1] != codes[v - 1]


def periodic_runs(codes: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> np.ndarray:
    """Rows ``(start, length, period)`` by start, then period, over all documents.

    ``starts``, ``ends``: those of the document of every position; positions count over all documents."""
    left, right, lcp = suffix_neighbours(codes, ends, doc)
    keep = np.flatnonzero(lcp >= least_lcp(shortest, repeats))
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    parent: dict[int, int] = {}
    classes: dict[int, list[int]] = {}
    found = []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    for i, j, shared in zip(left[keep].tolist(), right[keep].tolist(), lcp[keep].tolist()):
        a, b = root(i), root(j)
        big, small = classes.get(a) or [a], classes.get(b) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        parent[b] = a
        classes.pop(b, None)
        if small[0] > big[-1]:
            touching = [(big[-1], small[0])]
            big.extend(small)
        elif len(small) == 1:
            x = small[0]
            k = bisect_left(big, x)
            touching = [(x, big[k])] if not k else [(big[k - 1], x), (x, big[k])]
            big.insert(k, x)
        else:
            touching, before, places = [], -1, [bisect_left(big, x) for x in small]
            for n, (x, k) in enumerate(zip(small, places)):
                if k and k != before:
                    touching.append((big[k - 1], x))
                if k < len(big) and (n + 1 == len(small) or places[n + 1] != k):
                    touching.append((x, big[k]))
                before = k
            big.extend(small)
            big.sort()  # two ordered runs: one merge
        classes[a] = big
        for u, v in touching:
            if v - u <= shared and _accepted(u, v, shared, codes, starts, shortest, repeats):
                found.append((u, v - u + shared, v - u))
    found.sort(key=lambda r: (r[0], r[2]))
    return np.array(found, np.int64).reshape(-1, 3)


def slice_runs(offsets: np.ndarray, flat: pa.Array, shortest: int, repeats: int) -> np.ndarray:
    """The runs of texts given as words; only texts that repeat ``least_lcp`` words are sorted."""
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    repeated = repeated_grams(codes, doc, len(n), least_lcp(shortest, repeats))
    at = np.flatnonzero(repeated[doc])
    if not len(at):
        return np.zeros((0, 3), np.int64)
    size = np.where(repeated, n, 0)
    begin = np.cumsum(size) - size
    own = doc[at]
    runs = periodic_runs(codes[at], own, begin[own], (begin + size)[own], shortest, repeats)
    runs[:, 0] = at[runs[:, 0]]
    return runs


def find(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """``SCHEMA``: the runs of every text (word numbers, by start, then period) and its text with one period of each run.

    A word stays unless a run holds it after the run's first period; kept words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in merged(batches, "text", SLICE):
            offsets, flat = words(large(t["text"]))
            runs = slice_runs(offsets, flat, shortest, repeats)
            n, total = np.diff(offsets), int(offsets[-1])
            owner = np.searchsorted(offsets, runs[:, 0], "right") - 1
            edge = np.bincount(runs[:, 0] + runs[:, 2], minlength=total + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=total + 1)
            keep = np.cumsum(edge)[:total] == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            left = flat if keep.all() else flat.filter(pa.array(keep))
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept), left), pa.scalar(" ", left.type))
            of_doc = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
            fields = [runs[:, 0] - offsets[owner], runs[:, 1], runs[:, 2]]
            listed = pa.ListArray.from_arrays(pa.array(of_doc.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], names=["start", "length", "period"]))
            doc_id = t["doc_id"].combine_chunks()
            for at in range(0, len(n), 2000):
                size = min(2000, len(n) - at)
                yield pa.RecordBatch.from_arrays([doc_id.slice(at, size), pa.array(n[at : at + size]), listed.slice(at, size), text.slice(at, size).cast(pa.string())],
                                                 names=["doc_id", "n_words", "runs", "text"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(tidy(run), SCHEMA)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where documents whose crc32(doc_id) is divisible by 10 end in a repeated stretch.

    With g = crc32 div 10 and n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), each word i from a on becomes
    word a + (i - a) mod p.  Texts without words and rows without an id stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in merged(batches, "text", SLICE):
            offsets, flat = words(large(t["text"]))
            n = np.diff(offsets)
            g = t["h"].to_numpy() // 10
            a = g % np.maximum(n, 1)
            p = 1 + (n - a) // (3 + g % 8)
            doc = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(doc)) - offsets[doc]
            source = offsets[doc] + np.where(i < a[doc], i, a[doc] + (i - a[doc]) % p[doc])
            again = flat.take(pa.array(source))
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), again), pa.scalar(" ", again.type))
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), text.cast(pa.string())], names=["doc_id", "text"])

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = F.coalesce(crc_bucket(F.col("doc_id"), 10) == 0, F.lit(False))
    edited = narrow.where(chosen).select("doc_id", "text", h.alias("h")).mapInArrow(tidy(run), "doc_id long, text string")
    return narrow.where(~chosen).unionByName(edited)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from those of ``find``."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))

    def sha(text):
        return F.sha2(text.cast("binary"), 256)

    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), sha(lines).alias("runs_sha256"), sha(F.col("text")).alias("collapsed_sha256"), best.alias("best"),
    ).select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
