"""Duration-window rolling statistics.

Semantics: the window ending at row t covers ``(t - w, t]`` (left edge
excluded), NULLs are skipped, one observation is enough.  Of rows that share a
timestamp a later one sees the earlier ones (``tie`` gives their order).

Physical plan: time is cut into buckets of about equal row counts, also at the cuts plus ``w``, so that the left edges of a
bucket's windows stay within one such part.  The windows of a bucket's rows then consist of

* buckets that all of them cover whole: their moments and extremes combine (as nodes of a binary tree over the buckets, at
  most two a level), and of their values only those are needed that can be a quartile of some window.  Their ranks move by
  no more than the number of edge rows, so they lie between two exact order statistics of the covered buckets, which
  :mod:`radix` selects; equal values are one row with a count;
* edge rows: the bucket's own and those of the part in which its windows begin.

Each (group, bucket) is a task's group of at most about two parts of rows and a few times as many values, however long the
window is; a window that spans the data costs no more than a short one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_duration_us
from ..session import materialize
from . import radix
from .ordered import assign_bucket, order_bounds
from .quality import numeric_columns

ROLLING_STATS = ("mean", "median", "std", "var", "min", "max", "range", "q1", "q3", "iqr",
                 "skew", "kurt", "sum", "count")
#: Names accepted by the plotting-oriented selection (sum and count excluded).
PLOTTABLE_STATS = tuple(s for s in ROLLING_STATS if s not in ("sum", "count"))
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
#: Rows of a part (a bucket and its edge rows hold about two).
PART_ROWS = 100_000
#: Bounds of quartile values (a row a group, column, bucket and quartile) up to which they are broadcast.
BROADCAST_ROWS = 500_000


def validate_stats(stats: Sequence[str], allowed: Sequence[str] = PLOTTABLE_STATS) -> list[str]:
    bad = [s for s in stats if s not in allowed]
    if bad:
        raise ValueError(f"Invalid statistic(s) {bad}; valid options: {list(allowed)}")
    return list(stats)


class Buckets:
    """Where the windows of each bucket's rows begin, and which buckets they cover whole.

    Bucket k is [low[k], high[k]) in microseconds; ``covered[k]`` and ``edge[k]`` are the first bucket that
    all its windows cover and the first that some reach (k itself if none)."""

    def __init__(self, bounds: Sequence[float], first: int, last: int, w_us: int):
        cuts = sorted({int(x) for b in bounds for x in (b, b + w_us) if first < x <= last})
        self.cuts, n = cuts, len(cuts) + 1
        self.low, self.high = [first, *cuts], [*cuts, last + 1]
        self.covered = [min(k, bisect_left(self.low, self.high[k] - w_us)) for k in range(n)]
        self.edge = [min(self.covered[k], bisect_left(self.high, self.low[k] - w_us + 2)) for k in range(n)]

    def nodes(self, k: int) -> list[tuple[int, int]]:
        """(level, number) of the tree nodes that make up the covered buckets of k."""
        a, z, level, out = self.covered[k], k, 0, []
        while a < z:
            if a & 1:
                out.append((level, a))
                a += 1
            if z & 1:
                z -= 1
                out.append((level, z))
            a, z, level = a >> 1, z >> 1, level + 1
        return out


def rolling_stats(df: DataFrame, window: str, time: str = "time", cols: Sequence[str] | None = None,
                  by: Sequence[str] = (), stats: Sequence[str] = ROLLING_STATS, start=None, end=None,
                  buckets: int | None = None, check_rows: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Add ``<col>_<stat>`` rolling columns for every numeric column."""
    stats = validate_stats(stats, ROLLING_STATS)
    by = list(by)
    src = df
    if start is not None and end is not None:
        src = src.where(F.col(time).between(F.lit(start), F.lit(end)))
    if check_rows and src.limit(2).count() < 2:
        raise ValueError("Need at least 2 rows in the selected date range for rolling statistics")
    cols = [c for c in numeric_columns(src, cols) if c not in by]
    w_us = parse_duration_us(window)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    added = [T.StructField(f"{c}_{k}", T.LongType() if k == "count" else T.DoubleType()) for c in cols for k in ROLLING_STATS if k in stats]
    names = src.columns
    undated = src.where(t.isNull()).select("*", *[F.lit(0 if f.name.endswith("_count") else None).cast(f.dataType).alias(f.name) for f in added])
    dated = src.where(t.isNotNull())
    reach = dated.agg(F.min(t).alias("a"), F.max(t).alias("z"), F.count(F.lit(1)).alias("n")).first()
    if not reach["n"] or not cols:
        return undated.unionByName(dated.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added]))
    n = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-reach["n"] // PART_ROWS))
    plan = Buckets(order_bounds(dated, t, n), reach["a"], reach["z"], w_us)
    keys = [f"_g{i}" for i in range(len(by))]  # group keys under names of their own
    rows = assign_bucket(dated.withColumn("_t", t), F.col("_t"), [float(x) for x in plan.cuts], "_s")
    kept = [f"_c{i}" for i in range(len(names))]
    rows = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)], *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col("_t"), F.col("_s").cast("bigint").alias("_s"),
                       *[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"_x{i}") for i, c in enumerate(cols)],
                       *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(tie)])

    spark, size = df.sparkSession, len(plan.low)
    # A bucket sends its late rows to the later ones whose windows begin in it: about two rows a bucket.
    sends = spark.createDataFrame([(s, k, plan.low[k] - w_us) for k in range(size) for s in range(plan.edge[k], plan.covered[k])], "_s long, _b long, _from long")
    own = rows.withColumn("_b", F.col("_s"))
    edge = rows.join(F.broadcast(sends), "_s").where(F.col("_t") > F.col("_from")).drop("_from")
    meeting = own.drop("_s").withColumn("_own", F.lit(True)).unionByName(edge.select(*own.drop("_s").columns).withColumn("_own", F.lit(False)))

    side = None
    if any(plan.covered[k] < k for k in range(size)):
        side = _covered(rows, plan, keys, cols, [p for s, p in QUARTILES.items() if s in stats or (s != "median" and "iqr" in stats)])
    made = [f"_m{i}" for i in range(len(added))]
    out = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in kept], *[T.StructField(m, f.dataType) for m, f in zip(made, added)]])
    run = _Kernel(len(cols), stats, w_us, len(tie), kept, made)
    if side is None:
        done = meeting.groupBy(*keys, "_b").applyInPandas(lambda pdf: run(pdf, None), out)
    else:
        done = meeting.groupBy(*keys, "_b").cogroup(side.groupBy(*keys, "_b")).applyInPandas(lambda a, b: run(a, b), out)
    named = [F.col(k).alias(c) for k, c in zip([*kept, *made], [*names, *[f.name for f in added]])]
    return done.select(*named).unionByName(undated)


def _covered(rows: DataFrame, plan: Buckets, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """``(*keys, _b, column, kind, a..g)``: moments of covered tree nodes (kind 0: n, mean, second to fourth central sum, min, max), values that may be
    quartiles (kind 1: value, count) and what lies below them (kind 2: p, lowest value, how many are smaller)."""
    spark, size = rows.sparkSession, len(plan.low)
    levels = max(1, size.bit_length())
    cover = F.broadcast(spark.createDataFrame([(level, v, k) for k in range(size) for level, v in plan.nodes(k)], "_l int, _v long, _b long"))  # 2 log(buckets) rows a bucket
    names = [f"_x{i}" for i in range(len(cols))]
    long = materialize(rows.select(*keys, "_s", *names).unpivot([*keys, "_s"], names, "column", "x").where(F.col("x").isNotNull()).groupBy(*keys, "_s", "column", "x").agg(F.count(F.lit(1)).alias("n")))

    def up(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_v", F.expr("shiftright(_s, _l)"))

    # Moments per bucket, then per node around the node's mean.
    w, x = F.col("n"), F.col("x")
    mean = F.sum(w * x) / F.sum(w)
    leaf = long.groupBy(*keys, "_s", "column").agg(F.sum(w).alias("n"), mean.alias("mu"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    off = x - F.col("mu")
    central = (long.withColumnRenamed("n", "w").join(leaf.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("_s").alias("_ks"), F.col("column").alias("_kc"), "mu"),
                                                     [*[F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys], F.col("_s") == F.col("_ks"), F.col("column") == F.col("_kc")])
               .groupBy(*keys, "_s", "column").agg(F.sum("w").alias("n"), F.first("mu").alias("mu"), *[F.sum(F.col("w") * F.pow(off, F.lit(float(j)))).alias(f"m{j}") for j in (2, 3, 4)],
                                                   F.min("x").alias("lo"), F.max("x").alias("hi")))
    node = Window.partitionBy(*keys, "column", "_l", "_v")
    leveled = up(central).withColumn("_mu", F.sum(F.col("n") * F.col("mu")).over(node) / F.sum("n").over(node))
    d, m2, m3, m4, nn = F.col("mu") - F.col("_mu"), F.col("m2"), F.col("m3"), F.col("m4"), F.col("n")
    moments = leveled.groupBy(*keys, "column", "_l", "_v").agg(
        F.sum(nn).cast("double").alias("a"), F.first("_mu").alias("b"), F.sum(m2 + nn * d * d).alias("c"), F.sum(m3 + 3 * d * m2 + nn * d * d * d).alias("d"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + nn * d * d * d * d).alias("e"), F.min("lo").alias("f"), F.max("hi").alias("g"))
    parts = ["a", "b", "c", "d", "e", "f", "g"]
    side = moments.join(cover, ["_l", "_v"]).select(*keys, "_b", "column", F.lit(0).alias("kind"), *parts)
    if not probs:
        return side

    def spread(cells: DataFrame) -> DataFrame:
        tree = up(cells).groupBy(*keys, "column", "_l", "_v", "_cell").agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        return tree.join(cover, ["_l", "_v"]).drop("_l", "_v")

    # The edge rows of a bucket are its own and those of the buckets that its windows begin in.
    counts = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("n"))
    begins = spark.createDataFrame([(s, k) for k in range(size) for s in [k, *range(plan.edge[k], plan.covered[k])]], "_s long, _b long")
    most = counts.join(F.broadcast(begins), "_s").groupBy(*keys, "_b").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]

    def ranks(total):
        out = []
        for p in probs:
            low = F.greatest(F.floor(F.lit(p) * (total - 1)) - most, F.lit(0))
            high = F.least(F.ceil(F.lit(p) * (total + most)) + 1, total - 1)
            for i, r in enumerate((low, high)):
                out.append(F.struct(F.lit(p).alias("_p"), r.cast("double").alias("_h"), F.lit(i).alias("_side"), r.cast("bigint").alias("_rank")))
        return F.array(*out)

    target = [*keys, "column", "_b"]
    found = radix.select(long, target, ranks, base=[*keys, "_s", "column"], spread=spread, weight="n")
    at = {s: F.max(F.when(F.col("_side") == s, F.struct("_v", "_h", "_tie"))) for s in (0, 1)}
    slabs = found.groupBy(*target, F.col("_p").alias("p")).agg(at[0].alias("l"), at[1].alias("u"))
    slabs = materialize(slabs.select(*target, "p", F.col("l._v").alias("from"), F.col("u._v").alias("to"), (F.col("l._h") - F.col("l._tie")).alias("below")))
    # Values between the bounds of some bucket that covers theirs; a value outside all bounds of its group goes no further.
    reach = slabs.groupBy(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("column").alias("_kc"), F.col("p").alias("_kp")).agg(F.min("from").alias("_least"), F.max("to").alias("_most"))
    reach = reach.groupBy(*[f"_k{k}" for k in keys], "_kc").agg(F.collect_list(F.struct("_least", "_most")).alias("_reach"))  # a few intervals a group and column
    same = [*[F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys], F.col("column") == F.col("_kc")]
    near = long.join(F.broadcast(reach), same).where(F.exists("_reach", lambda r: (F.col("x") >= r["_least"]) & (F.col("x") <= r["_most"]))).select(*keys, "_s", "column", "x", "n")
    covers = F.broadcast(spark.createDataFrame(_users(plan), "_s long, _first long, _last long"))  # a row a bucket
    dealt = near.join(covers, "_s").select(*keys, "column", "x", "n", F.explode(F.sequence("_first", "_last")).alias("_b"))
    slab = slabs.groupBy(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("column").alias("_kc"), F.col("_b").alias("_kb")).agg(F.collect_list(F.struct("from", "to")).alias("_in"))
    slab = F.broadcast(slab) if slabs.count() <= BROADCAST_ROWS else slab
    inside = dealt.join(slab, [*same, F.col("_b") == F.col("_kb")]).where(F.exists("_in", lambda r: (F.col("x") >= r["from"]) & (F.col("x") <= r["to"])))
    none = [F.lit(None).cast("double").alias(c) for c in parts]
    values = inside.groupBy(*keys, "_b", "column", "x").agg(F.sum("n").alias("n")).select(*keys, "_b", "column", F.lit(1).alias("kind"), F.col("x").alias("a"), F.col("n").cast("double").alias("b"), *none[2:])
    below = slabs.select(*keys, "_b", "column", F.lit(2).alias("kind"), F.col("p").alias("a"), F.col("from").alias("b"), F.col("below").alias("c"), *none[3:])
    return side.unionByName(values).unionByName(below)


def _users(plan: Buckets) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of the buckets that cover it whole: neighbours, since windows move on with time."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    done = 0
    for k in range(len(plan.low)):
        for s in range(max(done, plan.covered[k]), k):
            first[s] = k
        done = max(done, k)
    for k in reversed(range(len(plan.low))):
        for s in range(plan.covered[k], k):
            if s in last:
                break
            last[s] = k
    return [(s, first[s], last[s]) for s in sorted(first) if s in last]


class _Kernel:
    """The windows of one bucket's own rows, from its edge rows and what is known of the covered buckets."""

    def __init__(self, cols: int, stats: list[str], w_us: int, ties: int, kept: list[str], made: list[str]):
        self.cols, self.stats, self.w_us, self.ties, self.kept, self.made = cols, stats, w_us, ties, kept, made

    def __call__(self, pdf: pd.DataFrame, side: pd.DataFrame | None) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", *[f"_o{i}" for i in range(self.ties)]], kind="stable", ignore_index=True)
        t, own = pdf["_t"].to_numpy(), np.flatnonzero(pdf["_own"].to_numpy(dtype=bool))
        out = pdf.loc[own, self.kept].reset_index(drop=True)
        begin, made = np.searchsorted(t, t[own] - self.w_us, "right"), iter(self.made)
        for i in range(self.cols):
            known = side[side["column"] == f"_x{i}"] if side is not None else None
            got = self.column(pdf[f"_x{i}"].to_numpy(dtype=float, na_value=np.nan), begin, own, known) if len(own) else {}
            for k in ROLLING_STATS:
                if k in self.stats:
                    v = got.get(k, np.zeros(0))
                    out[next(made)] = v.astype(np.int64) if k == "count" else pd.Series(v).astype(object).where(~np.isnan(v), None)
        return out

    def column(self, x: np.ndarray, begin: np.ndarray, own: np.ndarray, side: pd.DataFrame | None) -> dict[str, np.ndarray]:
        nodes = side[side["kind"] == 0][list("abcdefg")].to_numpy() if side is not None else np.zeros((0, 7))
        n, mu, m2, m3, m4, low, high = _merged(nodes)
        there = ~np.isnan(x)
        centre = mu if n else float(x[there].mean()) if there.any() else 0.0
        y = np.where(there, x - centre, 0.0).astype(np.longdouble)

        def total(v):
            sums = np.concatenate([[np.longdouble(0)], np.cumsum(v)])
            return sums[own + 1] - sums[begin]

        count = n + total(there.astype(np.longdouble)).astype(float)
        one, two, three, four = total(y), m2 + total(y**2), m3 + total(y**3), m4 + total(y**4)
        least, most = np.minimum(low, _extreme(np.where(there, x, np.inf), begin, own, np.minimum)), np.maximum(high, _extreme(np.where(there, x, -np.inf), begin, own, np.maximum))
        with np.errstate(all="ignore"):
            m = one / count
            c2 = np.maximum(two - count * m**2, 0)
            c3 = three - 3 * m * two + 2 * count * m**3
            c4 = four - 4 * m * three + 6 * m**2 * two - 3 * count * m**4
            flat, some = least == most, count > 0
            var = np.where(flat, 0, c2 / (count - 1))
            g1, g2 = np.sqrt(count) * c3 / c2**1.5, count * c4 / c2**2 - 3
            skew = np.where(flat, 0, g1 * np.sqrt(count * (count - 1)) / (count - 2))
            kurt = np.where(flat, -3, (count - 1) / ((count - 2) * (count - 3)) * ((count + 1) * g2 + 6))
            got = {"mean": np.where(some, m + centre, np.nan), "var": np.where(count > 1, var, np.nan), "std": np.where(count > 1, np.sqrt(var), np.nan),
                   "min": np.where(some, least, np.nan), "max": np.where(some, most, np.nan), "range": np.where(some, most - least, np.nan),
                   "skew": np.where(count > 2, skew, np.nan), "kurt": np.where(count > 3, kurt, np.nan), "sum": np.where(some, one + centre * count, np.nan), "count": count}
        got = {k: v.astype(float) for k, v in got.items()}
        wanted = {s: p for s, p in QUARTILES.items() if s in self.stats or (s != "median" and "iqr" in self.stats)}
        if wanted:
            got |= self.quartiles(x, begin, own, count, side, wanted)
            if "iqr" in self.stats:
                got["iqr"] = got["q3"] - got["q1"]
        return got

    @staticmethod
    def quartiles(x: np.ndarray, begin: np.ndarray, own: np.ndarray, count: np.ndarray, side: pd.DataFrame | None, wanted: dict[str, float]) -> dict[str, np.ndarray]:
        held: list[float] = []
        hidden = {p: 0 for p in wanted.values()}  # covered values below the quartile that are not held
        if side is not None:
            values = side[side["kind"] == 1][["a", "b"]].sort_values("a")
            held = np.repeat(values["a"].to_numpy(), values["b"].to_numpy().astype(np.int64)).tolist()
            for p, lowest, below in side[side["kind"] == 2][["a", "b", "c"]].itertuples(index=False):
                hidden[p] = int(below) - bisect_left(held, lowest)
        out = {s: np.full(len(own), np.nan) for s in wanted}
        first, last, real = int(begin[0]) if len(begin) else 0, int(begin[0]) if len(begin) else 0, (~np.isnan(x)).tolist()
        xs = x.tolist()
        for i, (a, z) in enumerate(zip(begin.tolist(), own.tolist())):
            while last <= z:
                if real[last]:
                    insort(held, xs[last])
                last += 1
            while first < a:
                if real[first]:
                    del held[bisect_left(held, xs[first])]
                first += 1
            n = int(count[i])
            if n:
                for s, p in wanted.items():
                    h = p * (n - 1)
                    k = int(h)
                    at = k - hidden[p]
                    u = held[at]
                    out[s][i] = u + (h - k) * (held[at + 1] - u) if h > k else u
        return out


def _merged(nodes: np.ndarray) -> tuple[float, ...]:
    """Count, mean, central sums and extremes of several nodes together."""
    if not len(nodes):
        return 0.0, 0.0, 0.0, 0.0, 0.0, np.inf, -np.inf
    n, mu, m2, m3, m4, low, high = nodes.T
    mean = float(n @ mu / n.sum())
    d = mu - mean
    return (float(n.sum()), mean, float((m2 + n * d**2).sum()), float((m3 + 3 * d * m2 + n * d**3).sum()),
            float((m4 + 4 * d * m3 + 6 * d**2 * m2 + n * d**4).sum()), float(low.min()), float(high.max()))


def _extreme(x: np.ndarray, begin: np.ndarray, own: np.ndarray, pick) -> np.ndarray:
    """``pick`` over x[begin[i] : own[i] + 1]: two overlapping stretches whose lengths are powers of two."""
    length = own + 1 - begin
    power = np.frexp(length)[1] - 1
    out, table = np.empty(len(own)), x
    for j in range(int(power.max()) + 1):
        mine = power == j
        out[mine] = pick(table[begin[mine]], table[own[mine] + 1 - (1 << j)])
        table = pick(table[: -(1 << j)], table[(1 << j) :]) if len(table) > 1 << j else table
    return out


def rolling_selection(df: DataFrame, window: str, stats: Sequence[str], time: str = "time", cols: Sequence[str] | None = None,
                      by: Sequence[str] = (), **how) -> DataFrame:
    """Rolling statistics chosen among the names that can be plotted (sum and count are not)."""
    return rolling_stats(df, window, time, cols, by, validate_stats(stats), **how)
