"""Row filters and per-rule accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import char_len, len_ratio, word_len_ws
from textlab.operators.common import attach
from textlab.operators.quantiles import quantiles

# --- fixed values -----------------------------------------------------------
MIN_ARTICLE_LEN = 250          # keep length > 250
MIN_RATIO = 0.05               # keep ratio >= 0.05
MAX_RATIO = 0.5                # keep ratio <= 0.5
TOKEN_P90_FACTOR = 1.1         # token-length threshold = int(int(p90) * 1.1)
MAX_SENTENCE_BYTES = {"bpe": 16384, "word": 16384, "char": 16384, "unigram": 4096}
# ----------------------------------------------------------------------------


def with_pair_lengths(df: DataFrame, article: str, highlights: str, unit: str = "char") -> DataFrame:
    """Add ``char_len``, ``highlight_len``, ``highlight_ratio`` (unit ``char`` or ``word``)."""
    f = char_len if unit == "char" else word_len_ws
    return (df.withColumn("char_len", f(article))
              .withColumn("highlight_len", f(highlights))
              .withColumn("highlight_ratio", len_ratio("highlight_len", "char_len")))


def rule_masks(min_len=MIN_ARTICLE_LEN, min_ratio=MIN_RATIO, max_ratio=MAX_RATIO, length: Column | None = None,
               ratio: Column | None = None) -> dict[str, Column]:
    """Keep-masks per rule; a NULL ratio (empty article) fails both ratio rules."""
    n = F.col("char_len") if length is None else length
    r = F.col("highlight_ratio") if ratio is None else ratio
    return {
        "short": F.coalesce(n > min_len, F.lit(False)),
        "ratio_low": F.coalesce((r >= min_ratio) & ~F.isnan(r), F.lit(False)),
        "ratio_high": F.coalesce((r <= max_ratio) & ~F.isnan(r), F.lit(False)),
    }


def keep_mask(**kw) -> Column:
    m = rule_masks(**kw)
    return m["short"] & m["ratio_low"] & m["ratio_high"]


def filter_len_ratio(df: DataFrame, **kw) -> DataFrame:
    """keep rows passing all three rules (lengths must already be attached). The rules are one function of both numbers: as
    plain columns they would each count the words of the texts again once the filter is pushed below the columns."""
    both = F.array(F.struct(F.col("char_len").alias("n"), F.col("highlight_ratio").alias("r")))
    return df.where(F.exists(both, lambda x: keep_mask(**kw, length=x["n"], ratio=x["r"])))


def filter_violations(df: DataFrame, group_cols=(), **kw) -> DataFrame:
    """per-rule violation counts (overlapping), remaining and total removed."""
    m = rule_masks(**kw)
    keep = m["short"] & m["ratio_low"] & m["ratio_high"]
    g = list(group_cols)
    return df.groupBy(*g).agg(
        F.count("*").alias("original_samples"),
        F.count_if(~m["short"]).alias("removed_short"),
        F.count_if(~m["ratio_low"]).alias("removed_ratio_low"),
        F.count_if(~m["ratio_high"]).alias("removed_ratio_high"),
        F.count_if(keep).alias("remaining"),
        F.count_if(~keep).alias("total_removed"))


def first_violation(**kw) -> Column:
    """Disjoint first failing rule (NULL if the row is kept)."""
    m = rule_masks(**kw)
    return (F.when(~m["short"], "short").when(~m["ratio_low"], "ratio_low")
            .when(~m["ratio_high"], "ratio_high"))


def token_p90_threshold(df: DataFrame, len_col: str, factor: float = TOKEN_P90_FACTOR, group_cols=()) -> DataFrame:
    """``p90 = int(percentile(len, 90))``, ``threshold = int(p90 * factor)`` per group."""
    q = quantiles(df, len_col, [0.9], group_cols)
    p90 = F.floor(F.col("q_0")).cast("bigint")
    return q.select(*group_cols, p90.alias("p90"),
                    F.floor(p90 * F.lit(factor)).cast("bigint").alias("threshold"))


def filter_token_p90(df: DataFrame, len_col: str, factor: float = TOKEN_P90_FACTOR) -> DataFrame:
    """keep rows with ``len <= int(int(p90) * factor)``; the one-row threshold is broadcast."""
    thr = token_p90_threshold(df, len_col, factor)
    return attach(df, thr).where(F.col(len_col) <= F.col("threshold"))


def filter_long_sentences(df: DataFrame, col: str, max_bytes: int) -> DataFrame:
    """drop training lines longer than ``max_bytes`` UTF-8 bytes."""
    return df.where(F.octet_length(F.coalesce(F.col(col), F.lit(""))) <= max_bytes)
