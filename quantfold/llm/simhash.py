"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has a bit where more than half of its word shingles' XXH64 hashes have it.
Two fingerprints that differ in at most ``distance`` bits agree in at least two of ``distance + 2``
blocks of bits, so they share one of the keys made of two blocks.  Distinct fingerprints are joined
on these keys and every candidate pair's Hamming distance is verified.

A key with more fingerprints than ``chunk`` is cut into chunks by a hash, and each pair of chunks is
compared in a task of its own.  A group of compared fingerprints yields a spanning forest of its
verified links, never all its pairs; the components of the forests are those of all links.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal rows share
a fingerprint; a component without any non-null doc_id has a null ``component_id``; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, large, slices, stored, tidy, with_text_hash, without_rows, words
from .graph import components

SHINGLE, DISTANCE, SEED, CHUNK = 3, 3, 42, 1024
#: A fingerprint or component is hot if it has more rows than this and more than this share of all rows.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def shingle_hashes(texts: pa.Array, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, hashes)`` of the shingles of lower-cased (A-Z) texts; fewer words: one shingle."""
    from xxhash import xxh64_intdigest

    offsets, flat = words(pc.ascii_lower(texts))
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(offsets[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    last = first + np.repeat(np.minimum(n, size), count) - 1
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(length + 1) - length - 1
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(pa.string())), " ")[0].as_buffer().to_pybytes()
    spans = zip(begin[first].tolist(), (begin[last] + length[last]).tolist())
    return out, np.fromiter((xxh64_intdigest(joined[a:z], seed) for a, z in spans), np.uint64, int(out[-1]))


def majority(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of each group's hashes have; zero for an empty group."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > n[full][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` but text, and the 64 bits as ``fp`` (long)."""
    names = [c for c in docs.columns if c not in ("text", "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            fp = majority(*shingle_hashes(large(b.column("text")), size, seed))
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(fp.view(np.int64))], names=[*names, "fp"])

    return docs.select(*names, "text").mapInArrow(tidy(run), T.StructType([*(docs.schema[c] for c in names), T.StructField("fp", T.LongType())]))


def block_keys(distance: int) -> list:
    """Columns, one per two of ``distance + 2`` blocks: the number of the two and their bits of ``fp``."""
    n = distance + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]

    def bits(i):
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1)), width

    out = []
    for t, (i, j) in enumerate(combinations(range(n), 2)):
        (a, wa), (b, wb) = bits(i), bits(j)
        out.append(F.shiftleft(F.lit(t).cast("long"), wa + wb).bitwiseOR(F.shiftleft(a, wb)).bitwiseOR(b))
    return out


def forest(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """``a, b`` edges that connect what the links within each ``fps`` list connect."""
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for fps in batch.column("fps"):
            f = fps.values.to_numpy().view(np.uint64)
            seen = np.zeros(len(f), bool)
            for root in range(len(f)):
                if seen[root]:
                    continue
                seen[root] = True
                todo = [root]
                while todo:
                    near = np.flatnonzero((np.bitwise_count(f ^ f[todo.pop()]) <= distance) & ~seen)
                    seen[near] = True
                    todo += near.tolist()
                    a += [int(f[root : root + 1].view(np.int64)[0])] * len(near)
                    b += f[near].view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``fp`` that span all links."""
    members = distinct.select("fp", F.explode(F.array(*block_keys(distance))).alias("key"))
    keys = stored(members.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "block-keys")
    pairs = keys.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    more = members.join(keys.where("n > 2").select("key", parts.alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = more.select("key", "fp", "own", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    lists = dealt.groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"))
    return pairs.union(lists.where(F.size("fps") > 1).select("fps").mapInArrow(lambda x: forest(x, distance), "a long, b long"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Stored ``rows`` joined to a stored ``table`` of one row a key.

    Keys of more than ``hot_rows`` rows and of more than 1 / ``hot_keys`` of all rows, so fewer than ``hot_keys``, are looked up in a
    broadcast of their table rows; the others are shuffled."""
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(hot_rows, rows.count() // hot_keys))
    hot = stored(table.join(F.broadcast(hot.select(key)), key, "left_semi"), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key))


def grouped(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for every row of ``docs`` (doc_id, text); root: a fingerprint that names the component."""
    rows = with_text_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    prints = stored(fingerprints(rows, size, seed), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct, distance, chunk))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("smallest"))
    of = distinct.join(linked.join(smallest, "root").select("fp", "root", "smallest"), "fp", "left")
    component = F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("smallest"))
    of = stored(of.select("fp", F.coalesce("root", "fp").alias("root"), component.alias("component_id")), "of-fingerprints")
    return looked_up(prints, of, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (doc_id, text)."""
    return grouped(docs, **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, broadcast_rows: int = 1_000_000, **how) -> DataFrame:
    """One row of ``docs`` of each component: of its smallest doc_id (null if it has no other) and, where rows
    with other texts repeat that id, of the smallest fingerprint and text hash."""
    rows = stored(grouped(docs, **how), "grouped")
    keys = stored(rows.groupBy("doc_id", "text_hash", "fp", "root", "component_id").agg(F.count("*").alias("n")), "distinct-rows")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = stored(keys.where(own).groupBy("root").agg(F.min(F.struct("fp", "text_hash")).alias("first")), "first-rows")
    is_first = own & (F.struct("fp", "text_hash") == F.col("first"))
    named = stored(looked_up(keys, first, "root").select("doc_id", "text_hash", "n", is_first.alias("stays")), "row-keys")
    kept = without_rows(docs, named.where("not stays"), broadcast_rows)
    repeated = named.where("stays and n > 1").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return kept
    one = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*(c for c in docs.columns if c not in ("doc_id", "text")))
    of_id, of_hash, nth = fresh(docs, "of_id", "of_hash", "nth_of_key")
    again = repeated.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash))
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_hash))
    several = kept.join(again, same, "left_semi").withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1)
    return without_rows(kept, repeated, broadcast_rows).unionByName(several.select(*docs.columns))
