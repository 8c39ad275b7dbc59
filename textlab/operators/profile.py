"""Corpus profiling aggregates.

All results are small (one row per statistic, bin or character); the work
is partial/final hash aggregation over the whole corpus.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.common import attach
from textlab.operators.quantiles import quantiles
from textlab.session import materialize

DESCRIBE_PROBS = (0.25, 0.5, 0.75)
LENGTH_PROBS = (0.5, 0.8, 0.9, 0.95, 0.99)


def _pname(p: float) -> str:
    return f"p{int(round(p * 100))}"


def describe(df: DataFrame, cols, group_cols=(), ddof: int = 1, probs=DESCRIBE_PROBS, digits: int | None = 6) -> DataFrame:
    """A1/A2: count, mean, std, min, percentiles, max per column (long format).

    ``ddof=1`` is the sample standard deviation (pandas ``describe``),
    ``ddof=0`` the population one (NumPy ``std``). Percentiles are exact with
    linear interpolation. The columns become rows of one narrow table, written once, on which the moments are one aggregation
    and the percentiles of all columns one series of histogram passes.
    """
    gcols = list(group_cols)
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    long = materialize(df.select(*gcols, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s")).select(*gcols, "s.*"), "describe")
    by = [*gcols, "column"]
    moments = long.groupBy(*by).agg(F.count("x").cast("bigint").alias("count"), F.avg("x").alias("mean"), std("x").alias("std"),
                                    F.min("x").alias("min"), F.max("x").alias("max"))
    qn = [_pname(p) for p in probs]
    q = quantiles(long, "x", probs, by).select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col(f"q_{i}").alias(n) for i, n in enumerate(qn)])
    both = moments.join(q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    r = (lambda e: F.round(e, digits)) if digits is not None else (lambda e: e)
    return both.select(*gcols, "column", "count", *[r(F.col(s)).alias(s) for s in ["mean", "std", "min", *qn, "max"]])


def length_stats(df: DataFrame, cols, group_cols=(), digits: int | None = 6) -> DataFrame:
    """A2: count, mean, std (population), min, p50/80/90/95/99, max."""
    return describe(df, cols, group_cols, ddof=0, probs=LENGTH_PROBS, digits=digits)


def char_freq(df: DataFrame, col: str) -> DataFrame:
    """A3: ``(ch, n)`` character histogram over all texts."""
    chars = df.select(F.explode(F.split(F.coalesce(F.col(col), F.lit("")), "")).alias("ch"))
    return chars.where(F.col("ch") != "").groupBy("ch").agg(F.count("*").alias("n"))


def char_top(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent characters (ties by code point) plus the distinct count."""
    freq = char_freq(df, col)
    top = freq.orderBy(F.desc("n"), "ch").limit(k)
    distinct = freq.agg(F.count("*").alias("unique_chars"))
    return attach(top, distinct)


def cleaning_impact(df: DataFrame, raw: str, cleaned: str) -> DataFrame:
    """A5: total raw chars, cleaned chars, removed and percent removed (one row)."""
    r = F.sum(F.coalesce(F.length(raw), F.lit(0))).cast("bigint")
    c = F.sum(F.coalesce(F.length(cleaned), F.lit(0))).cast("bigint")
    t = df.agg(r.alias("total_raw_chars"), c.alias("total_cleaned_chars"))
    return t.select("total_raw_chars", "total_cleaned_chars",
                    (F.col("total_raw_chars") - F.col("total_cleaned_chars")).alias("chars_removed"),
                    F.round(F.try_divide(100.0 * (F.col("total_raw_chars") - F.col("total_cleaned_chars")),
                                         F.col("total_raw_chars").cast("double")), 6).alias("pct_removed"))


def pattern_impact(df: DataFrame, before: str, after: str, patterns: dict) -> DataFrame:
    """Per pattern, matches before minus matches after."""
    aggs = []
    for name, pat in patterns.items():
        aggs.append(F.sum(F.regexp_count(F.coalesce(F.col(before), F.lit("")), F.lit(pat))).alias(f"{name}__b"))
        aggs.append(F.sum(F.regexp_count(F.coalesce(F.col(after), F.lit("")), F.lit(pat))).alias(f"{name}__a"))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("pattern"), F.col(f"{n}__b").cast("bigint").alias("before"),
                 F.col(f"{n}__a").cast("bigint").alias("after"),
                 (F.col(f"{n}__b") - F.col(f"{n}__a")).cast("bigint").alias("removed"))
        for n in patterns])).alias("s")).select("s.*")


def fold_impact(df: DataFrame, removed: str, raw: str, group_cols=()) -> DataFrame:
    """folded/filtered characters and percent of the raw characters."""
    g = list(group_cols)
    t = df.groupBy(*g).agg(F.sum(removed).cast("bigint").alias("total_removed"),
                           F.sum(F.length(raw)).cast("bigint").alias("raw_chars"))
    return t.select(*g, "total_removed", "raw_chars",
                    F.round(F.try_divide(100.0 * F.col("total_removed"), F.col("raw_chars").cast("double")), 6)
                    .alias("percent"))


def _bin_expr(x, lo, hi, bins: int):
    # same arithmetic order as Spark's width_bucket: n * (x - lo) / (hi - lo)
    raw = F.when(hi == lo, F.lit(0)).otherwise(F.floor(F.lit(float(bins)) * (x - lo) / (hi - lo)))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 50, group_cols=()) -> DataFrame:
    """Equal-width histogram on ``[min, max]`` (last bin closed), like ``np.histogram``.

    Output ``(bin, lo, hi, n)``; empty bins are included.
    """
    g = list(group_cols)
    x = F.col(col).cast("double")
    rng = df.where(x.isNotNull()).groupBy(*g).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    return _hist_with_edges(df.where(x.isNotNull()), col, rng, bins, g)


def _hist_with_edges(df: DataFrame, col: str, rng: DataFrame, bins: int, g) -> DataFrame:
    spark = df.sparkSession
    x = F.col(col).cast("double")
    # rng has one row per group (a handful), broadcast to tag rows with their bin
    tagged = df.join(F.broadcast(rng), g) if g else attach(df, rng)
    counts = tagged.groupBy(*g, _bin_expr(x, F.col("__lo"), F.col("__hi"), bins).alias("bin")).agg(
        F.count("*").alias("n"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    grid = attach(rng, all_bins)
    w = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    out = grid.join(counts, [*g, "bin"], "left")
    return out.select(*g, "bin",
                      F.round(F.col("__lo") + F.col("bin") * w, 6).alias("lo"),
                      F.round(F.when(F.col("bin") == bins - 1, F.col("__hi"))
                              .otherwise(F.col("__lo") + (F.col("bin") + 1) * w), 6).alias("hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def histogram_shared(df: DataFrame, col: str, series_col: str, bins: int = 50) -> DataFrame:
    """Several series on common edges ``linspace(min, max, bins + 1)`` over their union."""
    x = F.col(col).cast("double")
    d = df.where(x.isNotNull())
    rng = d.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    series = d.select(series_col).distinct()
    # one row per series: bounded by the number of series
    rng_s = attach(series, rng)
    return _hist_with_edges(d, col, rng_s, bins, [series_col])
