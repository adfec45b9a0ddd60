"""Token-ID output: Parquet files of token lists that can be read selectively.

Layout: one file per range of ``doc_id``, rows in ascending ``doc_id``; ``ids`` is a list column with
dictionary pages (a vocabulary of 49 k needs at most 16 bits an id), the other columns are delta
encoded (writer version 2, no dictionary).  Row groups and pages have fixed sizes, and column
indexes hold the range of ``doc_id`` of each page, so a reader of few documents or of the metadata
columns alone skips the other pages.

Columns: ``doc_id``, ``part`` (number of the file), ``first`` (ids before the document in its file),
``n_tokens``, ``ids``.

Defined cases: a null text is an empty one (it holds the end id alone); rows with equal ``doc_id``
are kept and ordered by text; rows with a null ``doc_id`` come first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import large, merged, scratch, small_batches, tidy
from .tokens import encoder

SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES, PAGE_BYTES, SLICE = 32 << 20, 128 << 10, 5 << 20


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """``SCHEMA`` rows of each partition in its order."""
    ends = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, part, code = 0, TaskContext.get().partitionId(), encoder(tokenizer)
        for t in merged(batches, "text", SLICE):
            offsets, ids = code.encode(large(t["text"]))
            if ends:
                ids = np.insert(ids, offsets[1:], ends[0])
                offsets = offsets + np.arange(len(offsets))
            n = np.diff(offsets)
            for at in range(0, len(n), 1000):
                to = min(at + 1000, len(n))
                lists = pa.ListArray.from_arrays(pa.array((offsets[at : to + 1] - offsets[at]).astype(np.int32)), pa.array(ids[offsets[at] : offsets[to]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    t["doc_id"].slice(at, to - at).combine_chunks(), pa.array(np.full(to - at, part, np.int32)),
                    pa.array(first + offsets[at:to]), pa.array(n[at:to]), lists], names=["doc_id", "part", "first", "n_tokens", "ids"])
            first += int(offsets[-1])

    return docs.mapInArrow(tidy(run), SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Encode ``docs`` (doc_id, text) and write the token files to a new folder."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", tie, "text")
    w = encoded(ordered, tokenizer, end_id).write.option("maxRecordsPerFile", 0).option("compression", "zstd")
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "true"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "first", "n_tokens")}
    for k, v in options.items():
        w = w.option(k, v)
    with small_batches(docs.sparkSession):
        w.parquet(path)


def read_meta(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, part`` of every document; the ids are not read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return _started(df.select("doc_id", "part", "first", "n_tokens"), df).select("doc_id", "start", "n_tokens", "part")


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; filters on doc_id reach the page indexes."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return _started(df, df).select("doc_id", "start", "n_tokens", "ids")


def _started(df: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``start``.  The totals have one row per file, so their window and broadcast are bounded
    by the number of files."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return df.join(F.broadcast(before), "part").withColumn("start", F.col("first") + F.col("before"))


def id_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the ids that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            o, v = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(v[a:z]) for a, z in zip(o[:-1], o[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(o).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer)
    return id_digests(read_tokens(docs.sparkSession, path))
