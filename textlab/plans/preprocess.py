"""EP1: clean -> length/ratio filter -> profile, over the article/highlight pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.cleaning import clean_text_columns, newline_to_space
from textlab.operators.filters import filter_len_ratio, with_pair_lengths
from textlab.session import stage_table
from textlab.sources import tables

LENGTH_COLS = ("char_len", "highlight_len", "highlight_ratio")


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, split, article, highlights)`` with newlines in highlights turned to spaces."""
    p = tables.pairs(spark, sf_dir)
    return p.select("doc_id", tables.split_name(F.col("doc_id")).alias("split"), "article",
                    newline_to_space("highlights").alias("highlights"))


def cleaned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pairs + ``cleaned_text``/``removed_chars`` (article) and cleaned highlights.

    Stage table: cleaned once per session and read back from shared storage.
    """
    def build():
        p = raw_pairs(spark, sf_dir)
        p = clean_text_columns(p, "article", "cleaned_text", "removed_chars")
        return clean_text_columns(p, "highlights", "cleaned_highlights", "removed_chars_hl")
    return stage_table(spark, f"cleaned_pairs:{sf_dir}", build)


def post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned pairs with cleaned lengths, filtered by F1."""
    c = with_pair_lengths(cleaned_pairs(spark, sf_dir), "cleaned_text", "cleaned_highlights")
    return filter_len_ratio(c)


def length_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(phase, char_len, highlight_len, highlight_ratio)`` for raw ('pre') and cleaned+filtered ('post')."""
    pre = with_pair_lengths(raw_pairs(spark, sf_dir), "article", "highlights")
    post = post_filter(spark, sf_dir)
    cols = list(LENGTH_COLS)
    return (pre.select(F.lit("pre").alias("phase"), *cols)
            .unionByName(post.select(F.lit("post").alias("phase"), *cols)))
