"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Text handled at once inside a task; bounds the numpy temporaries whatever the row sizes are.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executors."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(a: pa.Array) -> pa.Array:
    """One string (or binary) array with 64-bit offsets that start at 0, without nulls.

    A cast slice keeps its place in the parent's data, and some Arrow kernels (``ascii_lower``) read
    such offsets wrongly, so they are taken back to 0 here; the data isn't copied."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    binary = pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type)
    kind = pa.large_binary() if binary else pa.large_string()
    a = pc.fill_null(a.cast(kind), b"" if binary else "")
    if not len(a):
        return pa.array([], kind)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2] or pa.py_buffer(b"")
    low, high = int(offsets[0]), int(offsets[-1])
    return pa.Array.from_buffers(kind, len(a), [None, pa.py_buffer(offsets - low), data.slice(low, high - low)])


def tidy(run):
    """A ``mapInArrow`` function that hands its memory back when a task ends: workers live on and
    serve other operators, and what the allocators keep would add up."""

    @wraps(run)
    def done(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return done


def give_back() -> None:
    """Hand memory that the allocators keep back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds at most ``limit`` bytes (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield b.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def merged(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Gather batches as long as ``column`` holds at most ``limit`` bytes, so that a task works on few, equal pieces."""
    held, size = [], 0
    for b in slices(batches, column, limit):
        n = int(pc.sum(pc.binary_length(b.column(column))).as_py() or 0)
        if held and size + n > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Hand long texts to Python in batches of fewer rows while a job runs, then restore the setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(offsets, words)`` of runs of anything but ASCII white space (space, U+0009-U+000D)."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values
    blank = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    if len(blank):  # an empty text gives one empty word
        keep = np.ones(len(flat), bool)
        keep[blank] = False
        offsets = offsets - np.searchsorted(blank, offsets, "left")
        flat = flat.filter(pa.array(keep))
    return offsets, flat


def ragged_take(starts: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[starts[i] : starts[i] + lens[i]]``."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    at = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    at += np.arange(total)
    return flat[at]


def crc_bucket(col, modulus: int):
    """crc32 of a doc_id written as text, modulo ``modulus`` (null id: null)."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def with_text_hash(docs: DataFrame) -> DataFrame:
    """Add ``text_hash``: with the doc_id it names a row, or equal rows, without the text."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where ``df`` has such columns (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without_rows(docs: DataFrame, keys: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text hash) is not in ``keys`` (doc_id, text_hash; null ids are equal).

    Texts don't leave the JVM.  The keys (16 bytes) are broadcast up to ``broadcast_rows``, else shuffled."""
    gone_id, gone_hash = fresh(docs, "gone_id", "gone_hash")
    gone = stored(keys.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct(), "removed-rows")
    if gone.isEmpty():
        return docs
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_hash))
    return docs.join(gone, same, "left_anti")
