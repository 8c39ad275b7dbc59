"""Character tokenizer (K2, K6): one piece per code point, word starts marked by ``▁``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators.common import attach
from textlab.operators.tokenizers.arrow import encode_points
from textlab.operators.tokenizers.vocab import (
    DEFAULT_VOCAB_SIZE, SPACE, SPECIAL_PIECES, piece_ids, with_specials)


def char_counts(words: DataFrame) -> DataFrame:
    """``(piece, n)``: characters of ``▁word`` for every training word; a row with a column ``n`` stands for so many words."""
    n = F.sum("n") if "n" in words.columns else F.count("*")
    ch = words.withColumn("piece", F.explode(F.split(F.concat(F.lit(SPACE), F.col("word")), "")))
    return ch.where(F.col("piece") != "").groupBy("piece").agg(n.alias("n"))


def train_char_vocab(words: DataFrame, vocab_size: int = DEFAULT_VOCAB_SIZE, coverage: float = 1.0) -> DataFrame:
    """K2: characters by frequency until ``coverage`` of all characters is reached.

    The table of distinct characters is small (bounded by the alphabet), so a
    plain window over it is fine.
    """
    counts = char_counts(words)
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    w = Window.orderBy(F.desc("n"), "piece")
    ranked = attach(counts, total).select(
        "piece", "n", "total",
        F.row_number().over(w).alias("rk"),
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    keep = (F.col("rk") <= vocab_size - len(SPECIAL_PIECES)) & (
        F.coalesce(F.col("before"), F.lit(0)) < F.lit(coverage) * F.col("total"))
    ranked = ranked.where(keep).select(
        (F.col("rk") + len(SPECIAL_PIECES) - 1).cast("int").alias("id"), "piece",
        F.round(F.log(F.col("n") / F.col("total")), 6).alias("score"))
    return with_specials(words.sparkSession, ranked)


def encode_char(df: DataFrame, col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """K6: ``▁`` + text with spaces as ``▁``, one id per character (unk when absent); map-only, whole batches."""
    return df.withColumn(out, encode_points(piece_ids(vocab))(F.coalesce(F.col(col), F.lit(""))))
