"""Substring dedup by Rabin-Karp hashes of every window of ``size`` words.

1. Each task hashes every window of its texts (a polynomial modulo 2^64 over 64-bit word hashes) in
   batches of about ``BATCH`` bytes of text.  Of equal windows in a batch only those of the
   smallest doc_id go on; the others are already known to repeat.  A batch's windows, sorted by hash,
   are cut by hash range into as many packed rows as there are ranges.
2. One shuffle by range counts the windows: per range, the smallest doc_id of each hash.  A
   hash that half the corpus holds is one entry per batch here, whatever its frequency.
3. Positions of repeated windows go, packed by a hash of doc_id, to where a document's are merged
   into maximal intervals of words.
4. The intervals are joined to the texts: broadcast if they are smaller than ``BROADCAST_BYTES``,
   shuffled otherwise.

Windows are equal if their 64-bit hashes are: of N distinct windows about N^2 / 2^65 pairs are
confused.  The number of ranges follows the bytes of text, so a range's windows fit a task.

Defined cases: null and empty texts have no words; a text shorter than a window is kept whole; rows
with a null doc_id are kept whole and remove nothing; rows that share a doc_id don't remove each
other's words, and words that are removed from one of them are removed from all at the same place;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large, merged, slices, stored, tidy, words

SIZE, BATCH, RANGE_BYTES, BROADCAST_BYTES = 13, 8 << 20, 8 << 20, 32 << 20
BASE = 0x9E3779B97F4A7C15  # any odd number
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Ranges that one batch writes to; more ranges are dealt in levels, like the digits of their numbers in this base.
FAN = 2048
HEAD = struct.Struct("<qqBBB")
PACKED = "bucket int, payload binary"
SPANS = "doc_id long, spans array<struct<start:int,end:int>>"


def rolled(w: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes, mixed, of all windows of ``size`` numbers, by doubling."""
    if len(w) < size:
        return np.zeros(0, np.uint64)
    out, have, block, width = None, 0, w, 1
    while True:  # block: hashes of windows of width numbers
        if size & width:
            out = block if out is None else block[: len(out) - width] * np.uint64(pow(BASE, have, 1 << 64)) + out[width:]
            have += width
        if width * 2 > size:
            break
        block = block[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + block[width:]
        width *= 2
    out = out[: len(w) - size + 1]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return out ^ (out >> np.uint64(29))


def window_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, position, hash)`` of every window."""
    from xxhash import xxh64_intdigest

    offsets, flat = words(texts)
    coded = flat.dictionary_encode()
    of = np.fromiter((xxh64_intdigest(x, 7) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = rolled(of[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64), size)
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    position = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, position, h[offsets[:-1][text] + position]


def _narrow(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _width(x: np.ndarray) -> int:
    return max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1


def pack(h: np.ndarray, doc: np.ndarray, position: np.ndarray) -> bytes:
    """Entries sorted by hash: the hashes' differences and the other numbers in as few bytes as fit."""
    low = int(doc.min())
    parts = (np.diff(h, prepend=h[:1]), (doc - low).view(np.uint64), position.astype(np.uint64))
    widths = [_width(x) for x in parts]
    return HEAD.pack(low, int(h[:1].view(np.int64)[0]), *widths) + b"".join(map(_narrow, parts, widths))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, first, *widths = HEAD.unpack_from(data)
    n, at, parts = (len(data) - HEAD.size) // sum(widths), HEAD.size, []
    for w in widths:
        parts.append(_wide(data[at : at + n * w], w))
        at += n * w
    return np.cumsum(parts[0]) + np.int64(first).view(np.uint64), parts[1].view(np.int64) + low, parts[2].astype(np.int64)


def _later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries, sorted by hash, whose hash is also held by a smaller doc_id."""
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(h))))


def _verdicts(doc: np.ndarray, position: np.ndarray, groups: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Intervals of words, packed by group of doc_id; key -1 - group."""
    doc, start, end = covered(doc, position, position + size)
    group = (doc.view(np.uint64) * MIX >> np.uint64(33)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else []
    for a, z in zip(cut, [*cut[1:], len(order)]):
        on = order[a:z]
        yield -1 - int(group[on[0]]), doc[on].astype("<i8").tobytes() + start[on].astype("<i4").tobytes() + end[on].astype("<i4").tobytes()


def covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of each document: those that overlap or touch become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.append(True, doc[1:] != doc[:-1])
    shift = np.cumsum(new_doc) * (int(end.max()) + 2)  # documents one after another
    reach = np.maximum.accumulate(end + shift)
    head = np.append(True, (start + shift)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(doc) - 1)
    return doc[head], start[head], (reach - shift)[last]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Payloads of each bucket of rows that are sorted by bucket."""
    now, held = None, []
    for b in batches:
        for key, data in zip(b.column("bucket").to_pylist(), b.column("payload")):
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(data.as_py())
    if held:
        yield now, held


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), pa.array([v for _, v in pairs], pa.binary())], names=["bucket", "payload"])


def repeated_spans(docs: DataFrame, size: int = SIZE, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """``SPANS``: word intervals of each document that windows starting in a smaller doc_id cover.

    A batch writes at most ``fan`` rows of windows, however many ranges the corpus needs: beyond that its windows go to
    ranges of ranges, and batches of those on to the next level."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4, -(-total // range_bytes))

    levels = 1
    while fan**levels < ranges:
        levels += 1

    def emit(h: np.ndarray, doc: np.ndarray, position: np.ndarray, below: int) -> Iterator[pa.RecordBatch]:
        """Windows that repeat are decided; of the others, sorted by hash, one row a range of ``fan ** below`` ranges."""
        order = np.argsort(h, kind="stable")
        h, doc, position = h[order], doc[order], position[order]
        if not len(h):
            return
        later = _later(h, doc)
        yield from ([_rows(v)] if (v := list(_verdicts(doc[later], position[later], ranges, size))) else [])
        h, doc, position = h[~later], doc[~later], position[~later]
        bucket = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64) // fan**below
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        out = [(int(bucket[a]), pack(h[a:z], doc[a:z], position[a:z])) for a, z in zip(first, [*first[1:], len(h)])]
        for at in range(0, len(out), 64):
            yield _rows(out[at : at + 64])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in merged(batches, "text", BATCH):
            text, position, h = window_hashes(large(t["text"]), size)
            yield from emit(h, t["doc_id"].combine_chunks().to_numpy()[text], position, levels - 1)

    def split(below: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size_held, now = [], 0, None
            for b in batches:
                for key, data in zip(b.column("bucket").to_pylist(), b.column("payload")):
                    if key < 0:
                        yield _rows([(key, data.as_py())])
                        continue
                    if held and (key != now or size_held > BATCH):
                        yield from emit(*map(np.concatenate, zip(*map(unpack, held))), below)
                        held, size_held = [], 0
                    now = key
                    held.append(data.as_py())
                    size_held += len(held[-1])
            if held:
                yield from emit(*map(np.concatenate, zip(*map(unpack, held))), below)

        return run

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _by_bucket(batches):
            if key >= 0:
                h, doc, position = map(np.concatenate, zip(*map(unpack, held)))
                order = np.argsort(h, kind="stable")
                later = _later(h[order], doc[order])
                on = order[later]
                held = None
                pairs = list(_verdicts(doc[on], position[on], ranges, size))
            else:
                pairs = [(key, x) for x in held]
            for at in range(0, len(pairs), 64):
                yield _rows(pairs[at : at + 64])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for _, held in _by_bucket(batches):
            n = [len(x) // 16 for x in held]
            doc = np.concatenate([np.frombuffer(x, "<i8", k) for x, k in zip(held, n)])
            start = np.concatenate([np.frombuffer(x, "<i4", k, 8 * k) for x, k in zip(held, n)]).astype(np.int64)
            end = np.concatenate([np.frombuffer(x, "<i4", k, 12 * k) for x, k in zip(held, n)]).astype(np.int64)
            doc, start, end = covered(doc, start, end)
            head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(doc)).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([pa.array(doc[head]), lists], names=["doc_id", "spans"])

    packed = docs.mapInArrow(tidy(hashed), PACKED)
    for below in reversed(range(levels - 1)):
        packed = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(split(below)), PACKED)
    counts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(counted), PACKED)
    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(joined), SPANS)


def remove_repeats(docs: DataFrame, size: int = SIZE, range_bytes: int = RANGE_BYTES, broadcast_bytes: int = BROADCAST_BYTES, fan: int = FAN) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` of every row; ``text``: the kept words, one space between."""
    spans = stored(repeated_spans(docs, size, range_bytes, fan), "repeated-spans")
    held = spans.agg(F.coalesce(F.sum(F.size("spans") * 8 + 40), F.lit(0))).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = rows.join(F.broadcast(spans) if held <= broadcast_bytes else spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            offsets, flat = words(large(b.column("text")))
            n = np.diff(offsets)
            keep = np.ones(len(flat), bool)
            lists = b.column("spans")
            for i in np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False)).tolist():
                for s in lists[i].as_py():
                    keep[offsets[i] + s["start"] : min(offsets[i] + s["end"], offsets[i + 1])] = False
            left = np.concatenate([[0], np.cumsum(keep)])[offsets]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(keep)).cast(pa.string())), " ")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(n - np.diff(left)), texts], names=["doc_id", "n_words", "n_removed", "text"])

    return both.select("doc_id", "text", "spans").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, text string")
