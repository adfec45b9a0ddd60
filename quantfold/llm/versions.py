"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a bag of paragraphs: its lines, long ones cut after words chosen by their own bytes (so that an edit moves
no cut elsewhere), lines under ``SHORT`` bytes and texts of up to ``SMALL`` word by word.  The pieces cover the text; each has a 64-bit
digest, and the n-th occurrence of a piece has a digest of its own.

A sketch of ``m`` cells adds each digest to one cell of each of its three parts: a count, the sum of
digests and the sum of check values (mod 2^64).  Subtracting the sketches of two versions cancels what they
share; *peeling* takes cells that hold one digest (count 1 or -1, matching check), removes it from its other cells and
goes on.  If cells are left over, both versions are sketched anew with twice the cells, until all differing digests are
recovered.  Likeness is shared over all digests of both (Jaccard), exact from the recovered ones.

The fingerprint of a text is its smallest sketch (``CELLS`` cells) with the number of digests, in base 64.

Scale: ``successive`` deals documents to blocks of neighbouring ids in one shuffle of the texts; the first document of
each block travels a second time, to the end of the block before it.  Within a task rows stream by in slices of a few
MB.  Equal ids share a block.

Defined cases: a null text is an empty one; two texts without digests are alike (1.0); rows with equal ids are
ordered by text; null ids come last; the only document of a table is its own next one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import merged, slices, stored, tidy

#: Cells of a fingerprint; bytes of a line that is cut word by word; one of so many words ends a piece of a longer line.
CELLS, SHORT, WORDS = 12, 64, 6
#: Texts of up to so many bytes are cut word by word, so that half of a short text is more than one piece.
SMALL = 256
SLICE = 2 << 20
#: Text of a block, and the most blocks (their bounds are one array in the plan).
BLOCK_BYTES, MAX_BLOCKS = 8 << 20, 1 << 16

_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LOWEST = -(1 << 63)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, digest)`` of every piece of every text."""
    data = b"\n".join(texts) + b"\n"
    byte = np.frombuffer(data, np.uint8)
    text_end = np.cumsum([len(t) + 1 for t in texts]) - 1  # places of the joints
    line_end = np.flatnonzero(byte == 10)
    space = np.flatnonzero(byte == 32)
    line = np.searchsorted(line_end, space)
    begin = np.where(line, line_end[np.maximum(line, 1) - 1] + 1, 0)
    # The eight bytes before a space, within its line.
    tail = np.zeros(len(space), np.uint64)
    for k in range(1, 9):
        at = space - k
        tail |= np.where(at >= begin, byte[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
    small = np.array([len(t) <= SMALL for t in texts], bool)[np.searchsorted(text_end, space)]
    cut = (_mix(tail, 7) % np.uint64(WORDS) == 0) | (line_end[line] - begin < SHORT) | small
    after = np.union1d(space[cut], line_end) + 1  # a piece ends behind its white space
    joint = text_end + 1
    joins = np.zeros(len(data) + 1, np.int64)
    joins[joint] = 1
    end = after - joins[after]  # a joint belongs to no text
    start = np.append(0, after[:-1])
    full = end > start
    start, end = start[full], end[full]
    owner = np.searchsorted(joint, start, "right")
    view = memoryview(data)
    out = np.fromiter((xxhash.xxh3_64_intdigest(view[a:z]) for a, z in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    key = _mix(out, 3) ^ _mix(owner.astype(np.uint64), 5)
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) != 0)[: len(order)]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = order[nth > 0]
    out[again] = _mix(out[again], 11) + nth[nth > 0].astype(np.uint64) * _A
    return owner, out


class Sketches:
    """``n`` sketches of ``m`` cells each: counts, digest sums, check sums."""

    def __init__(self, n: int, m: int):
        self.m = m
        self.count, self.total, self.check = np.zeros(n * m, np.int64), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)

    def add(self, which: np.ndarray, digest: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        part, ones = self.m // 3, np.broadcast_to(np.asarray(sign, np.int64), digest.shape)
        amount, proof = digest * ones.astype(np.uint64), _mix(digest, 1) * ones.astype(np.uint64)
        for j in range(3):
            cell = which * self.m + j * part + ((_mix(digest, 20 + j + self.m) >> np.uint64(32)) * np.uint64(part) >> np.uint64(32)).astype(np.int64)
            np.add.at(self.count, cell, ones)
            np.add.at(self.total, cell, amount)
            np.add.at(self.check, cell, proof)
        return self

    def pure(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(sketch, digest, sign)`` of those of the cells that hold one digest."""
        cells = cells[np.abs(self.count[cells]) == 1]
        sign = self.count[cells]
        digest = self.total[cells] * sign.astype(np.uint64)
        right = self.check[cells] * sign.astype(np.uint64) == _mix(digest, 1)
        return cells[right] // self.m, digest[right], sign[right]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(sketch, digest, sign)`` of all that can be recovered, and the sketches that still hold something."""
        out = []
        where = np.flatnonzero(np.abs(self.count) == 1)
        while len(where):
            which, digest, sign = self.pure(where)
            if not len(which):
                break
            key = _mix(digest, 2) ^ _mix(which.astype(np.uint64), 4)  # once, though several cells may hold it alone
            _, first = np.unique(key, return_index=True)
            which, digest, sign = which[first], digest[first], sign[first]
            out.append((which, digest, sign))
            self.add(which, digest, -sign)
            touched = np.unique(which)
            where = (touched[:, None] * self.m + np.arange(self.m)).ravel()
            where = where[np.abs(self.count[where]) == 1]
        left = np.unique(np.flatnonzero((self.count != 0) | (self.total != 0) | (self.check != 0)) // self.m)
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return (*(np.concatenate(x) for x in zip(*out or [none])), left)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(group, place)`` for runs of places."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def differences(owner: np.ndarray, digest: np.ndarray, left: np.ndarray, right: np.ndarray, n_texts: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(pair, digest, sign)`` of what text ``left[pair]`` (1) or ``right[pair]`` (-1) alone holds, and the cells it took.

    ``owner`` ascends."""
    size = np.bincount(owner, minlength=n_texts)
    start = np.cumsum(size) - size
    todo, found, took, m = np.arange(len(left)), [], np.zeros(len(left), np.int64), cells
    while len(todo):
        s = Sketches(len(todo), m)
        for side, sign in ((left, 1), (right, -1)):
            group, place = _ragged(start[side[todo]], size[side[todo]])
            s.add(group, digest[place], sign)
        which, got, sign, failed = s.peel()
        done = np.ones(len(todo), bool)
        done[failed] = False
        own = done[which]
        found.append((todo[which[own]], got[own], sign[own]))
        took[todo[done]] = m
        todo, m = todo[~done], 2 * m
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (*(np.concatenate(x) for x in zip(*found or [none])), took)


def likeness(size: np.ndarray, left: np.ndarray, right: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Shared digests over all of each pair, from the recovered differences."""
    both = size[left] + size[right]
    shared = (both - np.bincount(pair, minlength=len(left))) / 2
    return np.where(both > 0, shared / np.maximum(both - shared, 1), 1.0)


def names(owner: np.ndarray, digest: np.ndarray, n_texts: int) -> list[str]:
    """The fingerprints: count of digests and the smallest sketch."""
    s = Sketches(n_texts, CELLS).add(owner, digest)
    cell = np.empty((n_texts * CELLS, 3), "<u8")
    cell[:, 0], cell[:, 1], cell[:, 2] = s.count.astype(np.uint64), s.total, s.check
    rows = np.concatenate([cell[:, 0].astype("<u4").view(np.uint8).reshape(-1, 4), cell[:, 1].copy().view(np.uint8).reshape(-1, 8), cell[:, 2].astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1).reshape(n_texts, -1)
    n = np.bincount(owner, minlength=n_texts)
    return [f"{k}:{base64.b64encode(r).decode()}" for k, r in zip(n.tolist(), rows)]


def _narrow(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", *more)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_digests long, fingerprint`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in merged(batches, "text", SLICE):
            owner, digest = digests([x.encode() for x in t["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(np.bincount(owner, minlength=len(t))), pa.array(names(owner, digest, len(t)))], names=["doc_id", "n_digests", "fingerprint"])

    return _narrow(docs).mapInArrow(tidy(run), "doc_id long, n_digests long, fingerprint string")


def changes(pairs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, new_fingerprint, removed array<long>, added array<long>, likeness, cells`` of (doc_id, text, new_text) rows.

    ``removed`` and ``added`` are the recovered digests; ``cells`` is the size of the sketch that gave them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "text", SLICE), "new_text", SLICE):
            n = b.num_rows
            owner, digest = digests([x.encode() for c in ("text", "new_text") for x in b.column(c).to_pylist()])
            left, right, name = np.arange(n), np.arange(n) + n, names(owner, digest, 2 * n)
            pair, got, sign, took = differences(owner, digest, left, right, 2 * n)
            lists = []
            for s in (1, -1):
                own = np.flatnonzero(sign == s)
                own = own[np.lexsort((got[own], pair[own]))]
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(pair[own], np.arange(n + 1)).astype(np.int32)), pa.array(got[own].view(np.int64))))
            alike = likeness(np.bincount(owner, minlength=2 * n), left, right, pair)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(name[:n]), pa.array(name[n:]), *lists, pa.array(alike), pa.array(took)], names=[c.split()[0] for c in schema.split(", ")])

    schema = "doc_id long, fingerprint string, new_fingerprint string, removed array<long>, added array<long>, likeness double, cells long"
    return _narrow(pairs, "new_text").mapInArrow(tidy(run), schema)


def _block(key, bounds: list[int]):
    """How many of the ascending ``bounds`` are at most ``key``, by halving."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    own = F.lit(bounds).cast("array<bigint>")

    def further(at, step):
        fits = (at + step <= len(bounds)) & (F.get(own, at + step - 1) <= key)
        return at + F.when(fits, step).otherwise(F.lit(0))

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), further)


def successive(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text, block, guest``: blocks in descending order of ids, dealt whole to partitions and sorted in them.

    Each block ends with a guest, the document that follows its last one (after the last: the first of all)."""
    rows = _narrow(docs).withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = int(min(max(1, size // block_bytes), MAX_BLOCKS))
    bounds: list[int] = []
    if blocks > 1:
        shares = [k / blocks for k in range(1, blocks)]
        bounds = sorted(set(rows.agg(F.percentile_approx("key", shares, 20 * blocks).alias("q")).first()["q"]))
    rows = rows.withColumn("block", _block(F.col("key"), bounds) if bounds else F.lit(0))
    heads = rows.groupBy("block").agg(F.max("key").alias("key"))  # at most MAX_BLOCKS + 1 rows
    w = Window.orderBy("block")
    heads = heads.select("block", "key", F.coalesce(F.lead("block").over(w), F.min("block").over(Window.partitionBy())).alias("target"))
    heads = stored(heads, "block-heads")
    guests = rows.join(F.broadcast(heads), ["block", "key"]).select("doc_id", "text", "key", F.col("target").alias("block"), F.lit(True).alias("guest"))
    dealt = rows.select("doc_id", "text", "key", "block", F.lit(False).alias("guest")).unionByName(guests)
    dealt = dealt.repartitionByRange(blocks, "block") if blocks > 1 else dealt.coalesce(1)
    return dealt.sortWithinPartitions("block", "guest", F.desc("key"), F.xxhash64("text"), "text").select("doc_id", "text", "block", "guest")


def edited_versions(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document beside its edited version (the last half of its code points replaced by the first as many of the next document) and beside the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        subject = [i for i in range(len(rows) - 1) if not rows[i][3]]
        edited = []
        for i in subject:
            n = len(texts[i])
            edited.append((texts[i][: n - n // 2] + texts[i + 1][: n // 2]).encode())
        own = np.array(subject, np.int64)
        total = len(texts) + len(edited)
        owner, digest = digests([x.encode() for x in texts] + edited)
        left, right = np.concatenate([own, own]), np.concatenate([np.arange(len(own)) + len(texts), own + 1])
        pair, _, _, _ = differences(owner, digest, left, right, total)
        alike = likeness(np.bincount(owner, minlength=total), left, right, pair)
        name = names(owner, digest, total)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in subject], pa.int64()), pa.array([len(texts[i]) for i in subject], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            pa.array([name[i] for i in subject], pa.string()), pa.array(name[len(texts) :], pa.string()), pa.array(alike[: len(own)]), pa.array(alike[len(own) :])], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for t in merged(batches, "text", SLICE):
            for b in t.to_batches():
                held += zip(*[c.to_pylist() for c in b.columns])
            yield compared(held)
            held = held[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return successive(docs, block_bytes).mapInArrow(tidy(run), schema)
