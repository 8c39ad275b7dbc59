"""EP2: train a tokenizer on the augmented train split, encode, and report token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.sequences import UNK_ID, ids_count_value
from textlab.functions.text import concat_fields, pretokens, word_len_re
from textlab.plans import preprocess as P
from textlab.session import has_stage, stage_table
from textlab.sources import tables

# --- fixed values -----------------------------------------------------------
# Vocabulary sizes used by the registered queries.
FIXTURE_VOCAB = {"word": 32000, "char": 32000, "bpe": 32000, "unigram": 32000}
# ----------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, split, cleaned_text, highlights)``: the cleaned, length/ratio-filtered pairs of all splits."""
    return P.post_filter(spark, sf_dir).select(
        "doc_id", "split", "cleaned_text", F.col("cleaned_highlights").alias("highlights"))


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, cleaned_text, highlights)``: the train split, originals and augmented copies (J1), with their row ids."""
    from textlab.plans import q_augment as QA

    def build():
        split = tables.split_name(F.floor(F.col("row_id") / 2).cast("bigint"))
        return QA.augment_union(spark, sf_dir).where(split == "train").select(F.col("row_id").alias("doc_id"), "cleaned_text", "highlights")
    return stage_table(spark, f"train_rows:{sf_dir}", build)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word)`` rows of the trainers' input: the pre-tokens of every line (T17 + T16), whatever its length."""
    return train_rows(spark, sf_dir).select(F.explode(pretokens(concat_fields("cleaned_text", "highlights"))).alias("word"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, n)``: the different pre-tokens of the trainers' input with their numbers, stage table (the text is cut up once for all
    trainers)."""
    return stage_table(spark, f"word_counts:{sf_dir}", lambda: words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")))


def train(spark: SparkSession, sf_dir: str, kind: str, vocab_size: int | None = None) -> DataFrame:
    """Tokenizer registry -- train ``kind`` and keep its vocabulary as a stage table."""
    from textlab.operators.tokenizers import registry
    v = vocab_size or FIXTURE_VOCAB[kind]
    return stage_table(spark, f"vocab:{kind}:{v}:{sf_dir}",
                       lambda: registry.get(kind).train(word_counts(spark, sf_dir), v))


def _encoded(spark: SparkSession, sf_dir: str, kind: str, rows: DataFrame) -> DataFrame:
    from textlab.operators.tokenizers import registry
    tok, vocab = registry.get(kind), train(spark, sf_dir, kind)
    return tok.encode(tok.encode(rows, "cleaned_text", vocab, "article_ids"), "highlights", vocab, "highlight_ids")


def encoded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``(doc_id, split, article_ids, highlight_ids)`` (no bos/eos) of the corpus, stage table; the texts stay where they are."""
    return stage_table(spark, f"encoded:{kind}:{sf_dir}", lambda: _encoded(spark, sf_dir, kind, corpus(spark, sf_dir)).drop("cleaned_text", "highlights"))


def _train_encoded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = train_rows(spark, sf_dir).withColumn("cleaned_len", word_len_re("cleaned_text"))
    return _encoded(spark, sf_dir, kind, rows).drop("cleaned_text", "highlights")


def train_encoded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``(doc_id, cleaned_len, article_ids, highlight_ids)`` of the augmented train split, stage table; ``cleaned_len`` is the number
    of ``\\w+`` words of the article."""
    return stage_table(spark, _train_key(sf_dir, kind), lambda: _train_encoded(spark, sf_dir, kind))


def _train_key(sf_dir: str, kind: str) -> str:
    return f"train_encoded:{kind}:{sf_dir}"


def encode_stats(enc: DataFrame) -> DataFrame:
    """K10 (+J3: highlight stats on the same row): token lengths and unk counts per row."""
    keep = [c for c in ("doc_id", "cleaned_len") if c in enc.columns]
    return enc.select(
        *keep,
        F.size("article_ids").cast("bigint").alias("token_article_len"),
        ids_count_value("article_ids", UNK_ID).alias("article_unk"),
        F.size("highlight_ids").cast("bigint").alias("token_highlight_len"),
        ids_count_value("highlight_ids", UNK_ID).alias("summary_unk"))


def train_stats(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``encode_stats`` of the augmented train split, stage table of numbers. The encodings are read where they are written already,
    else counted as they are made, and not written."""
    def build():
        written = has_stage(spark, _train_key(sf_dir, kind))
        return encode_stats(train_encoded(spark, sf_dir, kind) if written else _train_encoded(spark, sf_dir, kind))
    return stage_table(spark, f"train_stats:{kind}:{sf_dir}", build)


def length_filtered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """F4 applied to the encode stats of the train split: keep ``token_article_len <= int(int(p90) * 1.1)``."""
    from textlab.operators.filters import filter_token_p90
    return filter_token_p90(train_stats(spark, sf_dir, kind), "token_article_len")


def with_compression(df: DataFrame) -> DataFrame:
    """A11 input: tokens per ``\\w+`` word of the article (NULL when it has no words)."""
    return df.withColumn("compression", F.try_divide(F.col("token_article_len").cast("double"), F.col("cleaned_len").cast("double")))
