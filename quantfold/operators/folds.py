"""Walk-forward folds, per-fold preprocessing, K-fold and bootstrap.

Folds are rows, not a driver loop: each panel row is expanded (``explode``,
no range join) to the prediction years whose training window contains it,
plus its own year as test.  Statistics are counted once per year and added up over the
years of each fold; rows stay wide and meet one row of bounds a fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import materialize
from . import ordered, radix

#: Draw numbers of a bootstrap member that one row stands for.
BLOCK = 1 << 16


def walk_forward(df: DataFrame, start: int, end: int, train_years: int = 10, date: str = "datadate") -> DataFrame:
    """Add ``fold`` (prediction year) and ``role`` (train/test).

    Train years are fold-train_years .. fold-1, test is the fold year;
    folds in [start, end] with no train or no test rows are skipped.
    """
    y = F.year(date)
    train_folds = F.filter(F.sequence(y + 1, y + train_years), lambda p: (p >= start) & (p <= end))
    roles = F.concat(
        F.transform(train_folds, lambda p: F.struct(p.alias("fold"), F.lit("train").alias("role"))),
        F.when((y >= start) & (y <= end), F.array(F.struct(y.alias("fold"), F.lit("test").alias("role"))))
         .otherwise(F.array().cast("array<struct<fold:int,role:string>>")))
    ex = df.select("*", F.explode(roles).alias("_fr")).select(
        "*", F.col("_fr.fold").alias("fold"), F.col("_fr.role").alias("role")).drop("_fr")
    ok = (ex.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("_ntr"),
                                 F.count_if(F.col("role") == "test").alias("_nte"))
          .where((F.col("_ntr") > 0) & (F.col("_nte") > 0)).select("fold"))
    return ex.join(F.broadcast(ok), "fold", "left_semi")


def _finite(name: str):
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def fold_statistics(df: DataFrame, features: Sequence[str], start: int, end: int, train_years: int = 10, date: str = "datadate",
                    lower: float = 0.01, upper: float = 0.99, var_min: float = 1e-8, var_min_scaled: float = 1e-10, min_train: int = 10) -> DataFrame:
    """One row a fold: ``fold, n_train, n_test, bounds`` where ``bounds`` is an array of ``{lo, hi}`` aligned with ``features``
    (NULL for a feature that is dropped).  Folds that aren't usable have no row.

    Rows are counted per year; the cells of the quantile search are added up over each fold's years, so what
    is shuffled doesn't depend on the length of the window.  Winsorised values range from ``lo`` to ``hi``, so only their
    variance needs another pass, which keeps two sums per fold and feature and shuffles one row of them per task and fold."""
    size = len(features)
    year = F.year(date)
    last = F.lit(end)

    def folds_of(years: DataFrame) -> DataFrame:
        return years.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("_y") + 1, F.lit(start)), F.least(F.col("_y") + train_years, last)))).drop("_y")

    def in_reach(y):  # the first fold it can train isn't after the last one
        return (y < last) & (y + train_years >= start)

    def aligned(found: DataFrame) -> DataFrame:  # one row a fold
        held = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi"))))
        return found.groupBy("fold").agg(held.alias("m")).select("fold", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("m", i)).alias("bounds"))

    wide = df.select(year.alias("_y"), F.array(*[_finite(c) for c in features]).alias("_x"))
    long = wide.select("_y", F.posexplode("_x").alias("feature", "x"))  # a feature is its number
    trained = long.where(F.col("x").isNotNull() & in_reach(F.col("_y")))
    found = radix.select(trained, ["fold", "feature"], lambda n: radix.quantile_ranks([lower, upper], n), base=["_y", "feature"], spread=folds_of)
    q = radix.interpolated(found, ["fold", "feature"])
    q = q.groupBy("fold", "feature").agg(F.max(F.when(F.col("p") == lower, F.col("value"))).alias("lo"), F.max(F.when(F.col("p") == upper, F.col("value"))).alias("hi"))
    q = materialize(q)  # folds x features rows
    lists = aligned(q).withColumnRenamed("bounds", "_b")

    years = df.groupBy(year.alias("_y")).agg(F.count(F.lit(1)).alias("n"))
    counts = (folds_of(years.where(in_reach(F.col("_y")))).groupBy("fold").agg(F.sum("n").alias("n_train"))
              .join(years.select(F.col("_y").alias("fold"), F.col("n").alias("n_test")), "fold")
              .where((F.col("n_train") >= min_train) & F.col("fold").between(start, end)))

    rows = folds_of(wide.where(in_reach(F.col("_y")))).join(F.broadcast(lists), "fold")  # a row a fold: bounded by the years
    sums = []
    for i in range(size):
        x, at = F.get("_x", F.lit(i)), F.get("_b", F.lit(i))
        off = F.when(x.isNotNull(), F.least(F.greatest(x, at["lo"]), at["hi"]) - at["lo"])
        sums.append(F.struct(F.lit(i).alias("feature"), F.array(F.count(off).cast("double"), F.sum(off), F.sum(off * off)).alias("m")))
    moments = rows.groupBy("fold").agg(F.array(*sums).alias("s")).select("fold", F.inline("s"))
    n, s, ss = (F.col("m")[k] for k in range(3))
    spread = q.join(moments, ["fold", "feature"]).withColumn("_v", F.when(n > 1, (ss - s * s / n) / (n - 1)))
    spread = materialize(spread.where(F.col("_v") > var_min).select("fold", "feature", "lo", "hi", "_v"))

    # A feature that is kept and missing in a year that a fold trains or tests on makes the fold unusable.
    missing = materialize(long.where(F.col("x").isNull()).select("_y", "feature").distinct())
    touched = folds_of(missing.where(in_reach(F.col("_y")))).unionByName(missing.where(F.col("_y").between(start, end)).withColumnRenamed("_y", "fold"))
    unusable = touched.join(spread, ["fold", "feature"], "left_semi").select("fold").distinct()
    kept = spread.where(F.col("_v") / ((F.col("hi") - F.col("lo")) * (F.col("hi") - F.col("lo"))) > var_min_scaled)
    return materialize(counts.join(aligned(kept), "fold").join(unusable, "fold", "left_anti").select("fold", "n_train", "n_test", "bounds"))


def fold_scale(df: DataFrame, features: Sequence[str], start: int, end: int, train_years: int = 10, key: str = "gvkey", date: str = "datadate",
               keep: Sequence[str] = (), **limits) -> DataFrame:
    """Per fold: winsorise at train quantiles -> drop near-constant -> >= min_train train rows -> min-max scale on train -> drop
    folds with missing values -> drop features constant after scaling.

    Wide: ``(fold, role, key, date, *keep, x)`` with ``x`` aligned with ``features`` (NULL for dropped ones).  Rows meet their
    fold's bounds, one broadcast row a fold; nothing but that is shuffled."""
    stats = fold_statistics(df, features, start, end, train_years, date, **limits)
    plain = df.select(key, date, *keep, F.array(*[_finite(c) for c in features]).alias("_x"))
    rows = walk_forward(plain, start, end, train_years, date).join(F.broadcast(stats.select("fold", "bounds")), "fold")

    def scaled(x, b):
        return (F.least(F.greatest(x, b["lo"]), b["hi"]) - b["lo"]) / (b["hi"] - b["lo"])

    return rows.select("fold", "role", key, date, *keep, F.zip_with("_x", "bounds", lambda x, b: F.when(b.isNotNull(), scaled(x, b))).alias("x"))


def long_features(scaled: DataFrame, features: Sequence[str], ids: Sequence[str] = ("fold", "role", "gvkey", "datadate")) -> DataFrame:
    """``(*ids, feature, x)`` of the features that :func:`fold_scale` kept."""
    names = F.array(*[F.lit(c) for c in features])
    return (scaled.select(*ids, F.posexplode("x").alias("_i", "x")).where(F.col("x").isNotNull())
            .select(*ids, F.get(names, F.col("_i")).alias("feature"), "x"))


def numbered(df: DataFrame, by: Sequence[str] = ("fold",), ids: Sequence[str] = ("gvkey", "datadate"), seed: int = 42, out: str = "_pos") -> DataFrame:
    """Add the 0-based rank by a seeded hash of ``ids`` within ``by`` (reproducible, not NumPy-identical).

    Ranking uses the bucketed position of :mod:`ordered`, so a large fold is not numbered in one task."""
    h = df.withColumn("_h", hash_key(*[F.col(c) for c in ids], F.lit(seed)))
    return ordered.with_position(h, "_h", list(by), out=out).drop("_h", "_bk")


def assign_kfold(df: DataFrame, k: int = 5, seed: int = 42, by: Sequence[str] = ("fold",),
                 ids: Sequence[str] = ("gvkey", "datadate"), out: str = "cv") -> DataFrame:
    """Balanced K-fold labels: rows ranked by a seeded hash within ``by``, label = rank mod k."""
    return numbered(df, by, ids, seed, "_rank").withColumn(out, F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank")


def draws(sizes: DataFrame, members: int = 10, frac: float = 0.6, seed: int = 42, by: Sequence[str] = ("fold",), block: int = BLOCK) -> DataFrame:
    """Sampling with replacement from groups of ``_n`` rows: ``(*by, member, _pos, weight)``, ``floor(frac * n)`` draws each.

    Draw d of member m picks position ``hash(group, m, d, seed) mod n``.  Draws are dealt in blocks of at most ``block``
    numbers, so those of a member are spread over tasks and no array is longer than a block."""
    by = list(by)
    wanted = F.greatest(F.floor(F.col("_n") * frac), F.lit(1)).cast("bigint")
    blocks = (sizes.select(*by, "_n", wanted.alias("_draws"), F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
              .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_draws - 1) div {block}"))).alias("_block")))
    blocks = blocks.repartition(*by, "member", "_block")  # a row a block
    numbers = F.sequence(F.col("_block") * block + 1, F.least((F.col("_block") + 1) * block, F.col("_draws")))
    pos = F.pmod(hash_key(*[F.col(b) for b in by], F.col("member"), F.col("_d"), F.lit(seed)), F.col("_n"))
    drawn = blocks.select(*by, "_n", "member", F.explode(numbers).alias("_d")).select(*by, "member", pos.alias("_pos"))
    return drawn.groupBy(*by, "member", "_pos").agg(F.count(F.lit(1)).alias("weight"))


def bootstrap(df: DataFrame, members: int = 10, frac: float = 0.6, seed: int = 42, by: Sequence[str] = ("fold",),
              ids: Sequence[str] = ("gvkey", "datadate"), block: int = BLOCK) -> DataFrame:
    """``(*by, member, *ids, weight)``: the rows that :func:`draws` picks, with their multiplicity.

    An equi-join on position: no pairs, no driver RNG."""
    by = list(by)
    pos = numbered(df, by, ids, seed)
    counts = draws(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), members, frac, seed, by, block)
    return (counts.join(pos.select(*by, "_pos", *ids), on=[*by, "_pos"])
            .select(*by, "member", *ids, F.col("weight").cast("bigint").alias("weight")))
