"""Exact quantiles (linear interpolation, NumPy's default) by refined histograms.

Every needed rank starts in the interval from its group's least to its largest value. A pass cuts each open interval into
``BINS`` bins, counts the values of each bin (with its least and largest one), and keeps for every rank the bin that holds it, until a
bin holds a single value. A pass is one aggregation with map-side sums, ``BINS`` rows for an interval at most; values are never
sorted or moved, and a value that a third of all rows have is one row. Bins are equal steps of the value and of its binary scale, by turns, so
the number of passes is small for any spread (two or three for text lengths, some fifteen at the most) and does not depend on
the number of rows. The plan is the same for all types and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import materialize, release

BINS = 1024


def _scale(v: Column) -> Column:
    """A monotone number that grows by one for every doubling of ``v``, on both sides of 0."""
    e = F.floor(F.log2(F.abs(v)))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (e + 1076 + (F.abs(v) / F.pow(F.lit(2.0), e) - 1)))


def _bin(v: Column, lo: Column, hi: Column, by_scale: bool) -> Column:
    """Bin of ``v`` in [lo, hi], monotone, 0 for ``lo`` and the last one for ``hi``: equal steps of the value or of its scale. Infinite
    ends have bins of their own."""
    inside = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)
    if by_scale:
        x, a, z = _scale(v), _scale(lo), _scale(hi)
        inside = F.when(a < z, F.floor((x - a) / (z - a) * BINS)).otherwise(inside)
    inf = float("inf")
    ends = (F.when(F.isnan(v), BINS - 1).when(v == F.lit(inf), BINS - 2).when(v == F.lit(-inf), 0).otherwise(1))
    open_ended = F.isnan(hi) | (hi == F.lit(inf)) | (lo == F.lit(-inf))
    return F.when(open_ended, ends).otherwise(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), inside))).cast("int")


def quantiles(df: DataFrame, col: str, probs, group_cols=()) -> DataFrame:
    """One row per group (null is a group too): ``q_<i>`` columns (DOUBLE) for each probability; NULL for a group without values. NaN
    counts as the largest value."""
    g = list(group_cols)
    keys = [f"__g{i}" for i in range(max(1, len(g)))]
    src = [F.col(c) for c in g] or [F.lit(0)]
    narrow = materialize(df.select(*[c.alias(k) for c, k in zip(src, keys)], F.col(col).cast("double").alias("__v")), "quantile_values")
    groups = materialize(narrow.groupBy(*keys).agg(F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")), "quantile_groups")

    def same(other):
        return [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]

    # ranks 2i and 2i + 1 are those below and above the place of probability i
    places = [F.lit(float(p)) * (F.col("__n") - 1) for p in probs]
    targets = F.array(*[F.struct(F.lit(2 * i + j).alias("t"), f(x).cast("long").alias("r")) for i, x in enumerate(places) for j, f in enumerate((F.floor, F.ceil))])
    cur = materialize(groups.where(F.col("__n") > 0).select(*keys, "__lo", "__hi", targets.alias("__targets")), "quantile_intervals")
    found = []
    while True:
        found.append(cur.where(F.col("__lo") == F.col("__hi")).select(*keys, F.explode("__targets.t").alias("__t"), F.col("__lo").alias("__x")))
        todo = cur.where(F.col("__lo") != F.col("__hi"))
        if not todo.head(1):
            break
        cur = materialize(_pass(narrow, todo, keys, same, by_scale=len(found) % 2 == 0), "quantile_intervals")
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    values = values.groupBy(*[F.col(k).alias(f"o{k}") for k in keys]).agg(
        *[F.max(F.when(F.col("__t") == t, F.col("__x"))).alias(f"__x{t}") for t in range(2 * len(list(probs)))])
    out = []
    for i, x in enumerate(places):
        lo, hi, part = F.col(f"__x{2 * i}"), F.col(f"__x{2 * i + 1}"), x - F.floor(x)
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * part).alias(f"q_{i}"))
    named = groups.join(values, same("o"), "left").select(*[F.col(k).alias(c) for c, k in zip(g, keys)], *out)
    result = materialize(named, "quantiles")
    release(narrow, groups)
    return result


def _pass(narrow: DataFrame, todo: DataFrame, keys, same, by_scale: bool) -> DataFrame:
    """The intervals, one bin wide, that the ranks of ``todo`` are in."""
    ends = todo.select(*[F.col(k).alias(f"o{k}") for k in keys], "__lo", "__hi")
    v = F.col("__v")
    hit = narrow.join(ends, [*same("o"), v >= F.col("__lo"), v <= F.col("__hi")])          # intervals of a group do not overlap
    hist = hit.groupBy(*keys, "__lo", _bin(v, F.col("__lo"), F.col("__hi"), by_scale).alias("__bin")).agg(
        F.count("*").alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    w = Window.partitionBy(*keys, "__lo").orderBy("__bin")                               # at most BINS rows
    hist = hist.withColumn("__before", F.sum("__c").over(w) - F.col("__c"))
    wanted = todo.select(*[F.col(k).alias(f"w{k}") for k in keys], F.col("__lo").alias("__wlo"), F.explode("__targets").alias("__target"))
    r = F.col("__target.r") - F.col("__before")
    hit = hist.join(wanted, [*same("w"), F.col("__lo") == F.col("__wlo")]).where((r >= 0) & (r < F.col("__c")))
    return hit.groupBy(*keys, F.col("__least").alias("__lo"), F.col("__most").alias("__hi")).agg(
        F.collect_list(F.struct(F.col("__target.t").alias("t"), r.alias("r"))).alias("__targets"))          # two for a probability
