"""Word tokenizer (K1, K5): whole ``▁word`` pieces, unknown words -> unk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.tokenizers.arrow import encode_lookup
from textlab.operators.tokenizers.vocab import (
    DEFAULT_VOCAB_SIZE, SPACE, SPECIAL_PIECES, counted, piece_ids, rank_pieces, with_specials)


def train_word_vocab(words: DataFrame, vocab_size: int = DEFAULT_VOCAB_SIZE) -> DataFrame:
    """K1: the ``vocab_size - 4`` most frequent pre-tokens (count desc, piece asc) after the 4 specials."""
    counts = counted(words).select(F.concat(F.lit(SPACE), F.col("word")).alias("piece"), "n")
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    ranked = rank_pieces(counts, "piece", "n", vocab_size - len(SPECIAL_PIECES), total)
    return with_specials(words.sparkSession, ranked)


def encode_word(df: DataFrame, col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """K5: whitespace words -> ids (unk when absent); map-only, one hash lookup of a batch's words."""
    return df.withColumn(out, encode_lookup(piece_ids(vocab))(F.coalesce(F.col(col), F.lit(""))))
