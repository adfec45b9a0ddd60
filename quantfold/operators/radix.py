"""Exact order statistics by radix selection, without sorting or holding values.

A double becomes a 64-bit integer in the same order (:func:`ordered_bits`).  Each pass counts the rows per cell of
16 more bits (one combined aggregate for all groups and probabilities), a running count over the cells of a
group finds the cell of every wanted rank, and the next pass counts only rows of those cells.  A cell whose smallest and
largest value are equal is done, so four passes are the most; once few rows are left in the wanted cells, one more pass ends it.

What is shuffled are cells, never rows: at most 65,536 a group (or wanted cell) and pass, however many rows there are.
Groups that overlap (training windows of several years) are counted once per part, and the parts' cells
are added up by ``spread``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Wanted (group, probability) rows up to which they are broadcast (under 100 bytes each).
BROADCAST_ROWS = 500_000
BITS = 16
#: Rows in the wanted cells up to which the next pass is the last, with a cell a value.
LAST_ROWS = 1_000_000


def ordered_bits(x: Column) -> Column:
    """The bits of a double (not NaN) as a bigint in the same order; -0.0 is 0.0.

    From exact arithmetic: the exponent is the floor of log2, corrected by one where that rounds, and the mantissa is
    the quotient by that power of two."""
    a = F.abs(x)
    # Stand-ins keep the branch that isn't taken from overflowing.
    normal = F.when((a >= F.lit(2.0**-1022)) & (a < F.lit(float("inf"))), a).otherwise(F.lit(1.0))
    guess = F.floor(F.log2(normal)).cast("double")
    power = F.pow(F.lit(2.0), guess)
    e = guess + F.when(normal < power, -1.0).when(normal >= 2 * power, 1.0).otherwise(0.0)
    fraction = ((normal / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0**52)).cast("bigint")
    bits = (e + 1023).cast("bigint") * F.lit(1 << 52) + fraction
    small = F.when(a < F.lit(2.0**-1022), a * F.lit(2.0**537) * F.lit(2.0**537)).otherwise(F.lit(0.0)).cast("bigint")
    bits = F.when(a < F.lit(2.0**-1022), small).when(a == F.lit(float("inf")), F.lit(0x7FF << 52)).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def _same(left: Sequence[str], right: Sequence[str]) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]


def quantile_ranks(probs: Sequence[float], total: Column) -> Column:
    """``array<struct<_p, _h, _side, _rank>>``: the two neighbouring 0-based ranks of every probability."""
    out = []
    for p in probs:
        h = F.lit(p) * (total - 1)
        low = F.floor(h).cast("bigint")
        for side, rank in ((0, low), (1, F.least(low + 1, total - 1))):
            out.append(F.struct(F.lit(p).alias("_p"), h.alias("_h"), F.lit(side).alias("_side"), rank.alias("_rank")))
    return F.array(*out)


def select(long: DataFrame, keys: Sequence[str], ranks: Callable[[Column], Column], value: str = "x", base: Sequence[str] | None = None,
           spread: Callable[[DataFrame], DataFrame] | None = None, weight: str | None = None) -> DataFrame:
    """``(*keys, _p, _h, _side, _v, _tie)``: the value at each wanted rank of every group, and how many equal values rank before it.

    ``ranks(total)`` gives the wanted ranks of a group of ``total`` rows, as :func:`quantile_ranks`.  Values are bigints or
    doubles, non-NULL and not NaN; with ``weight`` a row stands for so many equal ones.  With ``spread`` rows are counted by ``base``, and ``spread`` turns a frame with those columns into one
    with ``keys`` (several rows where groups overlap); columns that are in both restrict later passes."""
    keys, base = list(keys), list(base or keys)
    shared = [k for k in keys if k in base]
    whole = isinstance(long.schema[value].dataType, T.LongType)
    rows = long.select(*base, F.col(value).cast("bigint" if whole else "double").alias("_x"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    rows = rows.withColumn("_b", F.col("_x") if whole else ordered_bits(F.col("_x")))
    found, wanted, asked_rows, shift, above = None, None, 0, 64 - BITS, 64
    while True:
        part, cell = rows, F.shiftright("_b", shift)
        if wanted is not None:
            open_cells = wanted.select(*[F.col(k).alias(f"_k_{k}") for k in shared], F.col("_cell").alias("_open")).distinct()
            open_cells = F.broadcast(open_cells) if asked_rows <= BROADCAST_ROWS else open_cells
            part = rows.join(open_cells, [*_same(shared, [f"_k_{k}" for k in shared]), F.shiftright("_b", above) == F.col("_open")], "left_semi")
        cells = part.groupBy(*base, cell.alias("_cell")).agg(F.sum("_w").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        if spread is not None:
            cells = spread(cells).groupBy(*keys, "_cell").agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        parent = F.shiftright("_cell", above - shift) if wanted is not None else F.lit(0).cast("bigint")
        of_parent = Window.partitionBy(*keys, "_parent")
        cells = cells.withColumn("_parent", parent).withColumn(
            "_before", F.sum("_n").over(of_parent.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        if wanted is None:
            cells = cells.withColumn("_total", F.sum("_n").over(of_parent))
            held = F.filter(ranks(F.col("_total")), lambda r: (r["_rank"] >= F.col("_before")) & (r["_rank"] < F.col("_before") + F.col("_n")))
            hits = cells.select(*keys, "_cell", "_n", "_low", "_high", "_before", F.explode(held).alias("_r"))
            hits = hits.select(*keys, "_r._p", "_r._h", "_r._side", (F.col("_r._rank") - F.col("_before")).alias("_rank"), "_cell", "_n", "_low", "_high")
        else:
            asked = wanted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_p", "_h", "_side", F.col("_rank").alias("_asked"), F.col("_cell").alias("_open"))
            asked = F.broadcast(asked) if asked_rows <= BROADCAST_ROWS else asked
            hits = cells.join(asked, [*_same(keys, [f"_k_{k}" for k in keys]), F.col("_parent") == F.col("_open"),
                                      F.col("_asked") >= F.col("_before"), F.col("_asked") < F.col("_before") + F.col("_n")])
            hits = hits.select(*keys, "_p", "_h", "_side", (F.col("_asked") - F.col("_before")).alias("_rank"), "_cell", "_n", "_low", "_high")
        hits = materialize(hits)
        done = hits.where(F.col("_low") == F.col("_high")).select(*keys, "_p", "_h", "_side", F.col("_low").alias("_v"), F.col("_rank").alias("_tie"))
        found = done if found is None else found.unionByName(done)
        wanted = hits.where(F.col("_low") != F.col("_high"))
        left = wanted.agg(F.count(F.lit(1)).alias("asked"), F.sum("_n").alias("rows")).first()
        if not left["asked"]:
            return found
        # Few rows are left in the open cells: their values themselves are the last cells.
        asked_rows, above, shift = left["asked"], shift, 0 if left["rows"] <= LAST_ROWS else shift - BITS


def interpolated(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, p, value)`` from :func:`select` with :func:`quantile_ranks`: linear between the two neighbours."""
    both = found.groupBy(*keys, "_p", "_h").agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_z"))
    return both.select(*keys, F.col("_p").alias("p"), (F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_z") - F.col("_a"))).alias("value"))
