"""Packing by shortest-pack-first over the length histogram.

1. Every document is encoded; its ids are cut into pieces of ``size`` and a remainder.
2. The histogram of piece lengths (``size`` numbers, whatever the corpus) is packed on the driver:
   lengths longest first, each into the shortest pack that still has room, where packs of one
   pattern are placed together by their count.
3. Each pattern slot is a range of ranks of its length.  Pieces get a rank among the pieces of their
   length (a count per task and length, then a position within the task: no group in one task) and
   find their slot by it.

Packs that are left with more than ``slack`` free tokens are dissolved: their pieces, laid end to end
by length and rank, are cut at every ``size`` ids, and the last such sequence is cut into powers of
two, which need no padding.

Defined cases: a null text is an empty one (one piece, the end id alone); equal rows are packed one
by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import large, merged, stored, tidy
from .tokens import encoder

SIZE, SLICE = 2048, 4 << 20
#: ``ids``: little-endian, 2 bytes an id if the vocabulary allows it, else 4.
PIECES = "doc_id long, start long, length int, doc_tokens long, task int, nth long, ids binary"
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Rows of (task, length) counts up to which the table of first ranks is broadcast (24 bytes each).
BROADCAST_ROWS = 1_000_000


def id_type(tokenizer: str, end_id: int) -> str:
    """Decided on the driver, so that tasks that only move ids don't load the tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """Pieces of at most ``size`` ids; ``nth``: position among the task's pieces of that length."""

    kind = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for t in merged(batches, "text", SLICE):
            offsets, ids = code.encode(large(t["text"]))
            ids = np.insert(ids, offsets[1:], end_id).astype(kind)
            offsets = offsets + np.arange(len(offsets))
            n = np.diff(offsets)
            count = -(-n // size)
            doc = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
            length = np.minimum(size, n[doc] - start)
            order = np.argsort(length, kind="stable")
            by = length[order]
            head = np.flatnonzero(np.diff(by, prepend=0))
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by)))) + seen[by]
            seen += np.bincount(length, minlength=size + 1)
            a = offsets[:-1][doc] + start
            ends = np.append(a, a[-1] + length[-1]) * ids.itemsize  # the pieces follow one another in ids
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
            doc_id = t["doc_id"].combine_chunks()
            for x in range(0, len(doc), 2000):
                y = min(x + 2000, len(doc))
                yield pa.RecordBatch.from_arrays([
                    doc_id.take(pa.array(doc[x:y])), pa.array(start[x:y]), pa.array(length[x:y].astype(np.int32)), pa.array(n[doc[x:y]]),
                    pa.array(np.full(y - x, task, np.int32)), pa.array(nth[x:y]), data.slice(x, y - x).cast(pa.binary())], names=[c.split()[0] for c in PIECES.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(tidy(run), PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` patterns for ``{length: count}``.

    >>> shortest_pack_first({3: 2, 2: 2, 1: 1}, 5)
    [(2, (3, 2)), (1, (1,))]
    """
    open_at: dict[int, list[list]] = defaultdict(list)  # room -> packs [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in range(size, length - 1, -1):  # most room: the shortest pack
            if not left:
                break
            for pack in [p for p in open_at.get(room, [])]:
                if not left:
                    break
                n = min(left, pack[0])
                left -= n
                pack[0] -= n
                open_at[room - length].append([n, (*pack[1], length)])
            if room in open_at:
                open_at[room] = [p for p in open_at[room] if p[0]]
        if left:
            open_at[size - length].append([left, (length,)])
    return [(n, lengths) for room in sorted(open_at) for n, lengths in open_at[room]]


class Plan:
    """Slots of the patterns and the stream of dissolved pieces, as arrays sorted by (length, rank)."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE, slack: int = SIZE // 64):
        self.size = size
        self.kept = np.zeros(size + 1, np.int64)
        slots, self.sequences = [], 0
        for n, lengths in shortest_pack_first(histogram, size):
            total = sum(lengths)
            if size - total > slack and total & (total - 1):
                continue
            at = 0
            for length in lengths:
                slots.append((length, int(self.kept[length]), self.sequences, at))
                self.kept[length] += n
                at += length
            self.sequences += n
        slots.sort()
        self.slot = np.array(slots, np.int64).reshape(-1, 4)
        self.key = (self.slot[:, 0] << 48) + self.slot[:, 1]
        left = np.zeros(size + 1, np.int64)
        for length, n in histogram.items():
            left[length] = n - self.kept[length]
        lengths = np.arange(size + 1) * left
        self.base = np.cumsum(lengths[::-1])[::-1] - lengths  # longest first
        total = int(lengths.sum())
        self.full = total // size * size
        rest = total - self.full
        self.tail = [self.full]  # where the last, smaller sequences begin
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.tail.append(self.tail[-1] + (1 << bit))

    def place(self, length: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """``(row, begin, length, sequence, offset)`` arrays: one part per row, more where it is cut."""
        rows, out = np.arange(len(length)), []
        own = rank < self.kept[length]
        if own.any():
            s = self.slot[np.searchsorted(self.key, (length[own] << 48) + rank[own], "right") - 1]
            out.append((rows[own], np.zeros(own.sum(), np.int64), length[own], s[:, 2] + rank[own] - s[:, 1], s[:, 3]))
        row = rows[~own]
        at = self.base[length[row]] + (rank[row] - self.kept[length[row]]) * length[row]
        begin, left, tail = np.zeros(len(row), np.int64), length[row].copy(), np.array(self.tail, np.int64)
        while len(row):
            last = at >= self.full
            k = np.searchsorted(tail, at, "right") - 1
            first = np.where(last, tail[np.maximum(k, 0)], at // self.size * self.size)
            end = np.where(last, tail[np.minimum(k + 1, len(tail) - 1)], first + self.size)
            n = np.minimum(left, end - at)
            out.append((row, begin, n, self.sequences + np.where(last, self.full // self.size + k, at // self.size), at - first))
            more = left > n
            row, begin, left, at = row[more], (begin + n)[more], (left - n)[more], (at + n)[more]
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, slack: int | None = None,
         broadcast_rows: int = BROADCAST_ROWS, digests: bool = False) -> DataFrame:
    """``PACKED`` rows, one per piece; ``ids`` as in ``PIECES``.  With ``digests`` they are replaced by ``ids_crc32``,
    the crc32 of the ids as little-endian 32-bit numbers."""
    cut = stored(pieces(docs, tokenizer, end_id, size), "pieces")
    counts = stored(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    plan = Plan(histogram, size, size // 64 if slack is None else slack)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")  # a row per task
    first = counts.select("length", "task", before.alias("first"))
    ranked = cut.join(F.broadcast(first) if counts.count() <= broadcast_rows else first, ["length", "task"])
    kind = id_type(tokenizer, end_id)
    width = np.dtype(kind).itemsize
    schema = PACKED.replace("ids binary", "ids_crc32 long") if digests else PACKED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b.column(c).to_numpy() for c in ("start", "length", "nth", "first", "doc_tokens")}
            row, begin, n, sequence, offset = map(np.concatenate, zip(*plan.place(col["length"].astype(np.int64), col["first"] + col["nth"])))
            ids = b.column("ids")
            data = [ids[r].as_buffer().slice(x * width, k * width).to_pybytes() for r, x, k in zip(row.tolist(), begin.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(row)), pa.array(col["start"][row] + begin), pa.array(n),
                pa.array([zlib.crc32(np.frombuffer(x, kind).astype("<u4")) for x in data], pa.int64()) if digests else pa.array(data, pa.binary()),
                pa.array(col["doc_tokens"][row]), pa.array(sequence), pa.array(offset)], names=[c.split()[0] for c in schema.split(", ")])

    return ranked.select("doc_id", "start", "length", "doc_tokens", "nth", "first", "ids").mapInArrow(tidy(run), schema)

