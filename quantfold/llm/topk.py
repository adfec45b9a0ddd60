"""Exact top-k search by MaxScore.

A vector of whole numbers is a bag of signed terms: component d is a posting of term (d, +) or (d, -)
with its absolute value.  A query's terms are those of its own signs; each has a score bound, its weight
times the largest posting.  Terms of the smallest bounds that together stay below the k-th best score so
far are non-essential.  Only the essential postings are traversed; a candidate's other terms are probed,
largest bound first, while its score plus the bounds left can reach the k-th best, and at last
the terms of the opposite sign, which only lower it.

Candidates stay where they are read: each task is a shard that passes its blocks of ``BLOCK`` rows
by the queries and returns k rows a query; shards are merged per query in Spark.  Queries come in rounds
of about ``ROUND``, so what a round sends to the executors is bounded whatever their number.

Defined cases: vectors that are null, hold null or non-finite components, or have a null id take no part;
missing components of a shorter vector are zero; a query leaves out the rows of its own id; rows
that repeat an id are candidates one by one and one query (of the smallest vector); ties go to the
smaller id; an empty table gives no rows.  Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored, tidy

BLOCK, ROUND, STEPS = 2048, 4096, 3
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, terms``: floor(scale * component) of the vectors that take part."""
    inf = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))
    terms = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """One row a list, ``width`` columns; what is missing is 0."""
    offsets, n = lists.offsets.to_numpy(), len(lists)
    lens = np.diff(offsets)
    out = np.zeros((n, width), np.int64)
    at = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lens)
    out[np.repeat(np.arange(n), lens), at] = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


class Shard:
    """Best ``k`` candidates of each query among the blocks seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.k, self.width = ids, k, queries.shape[1]
        self.queries = queries
        self.largest = int(np.abs(queries).max(initial=0))
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)  # scores, vec_ids

    def add(self, vec_ids: np.ndarray, rows: np.ndarray) -> None:
        """A block of candidates."""
        exact = self.largest * int(np.abs(rows).max(initial=0)) * self.width < 1 << 53
        kind = np.float64 if exact else np.int64
        postings = np.concatenate([np.maximum(rows, 0).T, np.maximum(-rows, 0).T]).astype(kind)  # terms (d, +), then (d, -)
        top = postings.max(1)
        for i, q in enumerate(self.queries):
            self._one(i, q, vec_ids, postings, top, kind)

    def _one(self, i: int, q: np.ndarray, vec_ids: np.ndarray, postings: np.ndarray, top: np.ndarray, kind) -> None:
        d = np.flatnonzero(q)
        weight = np.abs(q[d]).astype(kind)
        term = np.where(q[d] > 0, d, d + self.width)
        scores, ids = self.best[i]
        least = scores[-1] if len(scores) == self.k else None
        bound = weight * top[term]
        order = np.argsort(bound, kind="stable")
        below = 0 if least is None else int(np.searchsorted(np.cumsum(bound[order]), least, "left"))
        rest, essential = order[:below], order[below:]
        score = weight[essential] @ postings[term[essential]] if len(essential) else np.zeros(len(vec_ids), kind)
        left = bound[rest].sum()
        alive = np.flatnonzero(vec_ids != self.ids[i])
        if least is not None:
            alive = alive[score[alive] + left >= least]
        score = score[alive]
        for part in np.array_split(rest[::-1], min(STEPS, len(rest))) if len(rest) else ():
            score = score + weight[part] @ postings[term[part][:, None], alive]
            left -= bound[part].sum()
            on = score + left >= least
            alive, score = alive[on], score[on]
        opposite = (term + self.width) % (2 * self.width)
        score = (score - (weight @ postings[opposite[:, None], alive] if len(d) else 0)).astype(np.int64)
        if least is not None:
            on = score >= least
            alive, score = alive[on], score[on]
        if len(alive):
            scores, ids = np.concatenate([scores, score]), np.concatenate([ids, vec_ids[alive]])
            first = np.lexsort((ids, -scores))[: self.k]
            self.best[i] = scores[first], ids[first]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, per_round: int = ROUND) -> DataFrame:
    """``query_id, rank, vec_id, score``; both inputs as of ``whole_numbers``."""
    spark = candidates.sparkSession
    candidates = stored(candidates, "candidates")
    queries = stored(queries.groupBy("vec_id").agg(F.min("terms").alias("terms")), "queries")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("terms")), F.lit(0))).first()
    width = max(width, candidates.agg(F.coalesce(F.max(F.size("terms")), F.lit(0))).first()[0])
    rounds, path = max(1, -(-n // per_round)), scratch(spark, "found")
    for r in range(rounds):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow().combine_chunks()  # one round of queries
        ids = rows["vec_id"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, matrix(rows["terms"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64())), width)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard = Shard(*sent.value, k)
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    shard.add(part.column("vec_id").to_numpy(), matrix(part.column("terms"), width))
            size = [len(s) for s, _ in shard.best]
            if sum(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shard.ids, size)), pa.array(np.concatenate([x for _, x in shard.best])), pa.array(np.concatenate([s for s, _ in shard.best]))], names=["query_id", "vec_id", "score"])

        candidates.mapInArrow(tidy(run), FOUND).write.mode("append").parquet(path)
        sent.unpersist()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
