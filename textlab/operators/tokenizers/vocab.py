"""Vocabulary tables and the Arrow lookups shared by all tokenizers.

A vocabulary is a DataFrame ``(id INT, piece STRING, score DOUBLE)`` of at
most ``vocab_size`` rows, which is its size bound as a broadcast variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.text import concat_fields, pretokens
from textlab.operators.common import attach
from textlab.operators.tokenizers.arrow import BOS, EOS, PAD, SPACE, UNK, decode_pieces  # noqa: F401

# --- fixed values -----------------------------------------------------------
SPECIAL_PIECES = ["<pad>", "<unk>", "<s>", "</s>"]
UNK_SURFACE = "⁇"    # text shown for an unknown id when decoding
DEFAULT_VOCAB_SIZE = 32000
# ----------------------------------------------------------------------------

VOCAB_SCHEMA = "id INT, piece STRING, score DOUBLE"


def unk_id() -> int:
    """Id of the unknown piece."""
    return UNK


def specials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, 0.0) for i, p in enumerate(SPECIAL_PIECES)], VOCAB_SCHEMA)


def training_words(df: DataFrame, text_col: str, summary_col: str | None = None) -> DataFrame:
    """``(word)`` rows of the training corpus: T17 concat, then T16 pre-tokens."""
    text = concat_fields(text_col, summary_col) if summary_col else F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.explode(pretokens(text)).alias("word"))


def counted(words: DataFrame) -> DataFrame:
    """``(word, n)``: the different words with their numbers. A table that has a column ``n`` is counted already, in part at least."""
    n = F.sum("n") if "n" in words.columns else F.count("*")
    return words.groupBy("word").agg(n.alias("n"))


def rank_pieces(counts: DataFrame, piece_col: str, count_col: str, limit: int, total: DataFrame) -> DataFrame:
    """Top ``limit`` pieces by (count desc, piece asc) -> ids 4.. with score ln(count/total).

    ``orderBy().limit()`` plans as a top-k (TakeOrderedAndProject), so only
    ``limit`` rows per task move; the id window then runs on those rows only.
    """
    top = counts.orderBy(F.desc(count_col), F.col(piece_col)).limit(limit)
    w = Window.orderBy(F.desc(count_col), F.col(piece_col))
    ranked = top.select(F.col(piece_col).alias("piece"), F.col(count_col).alias("n"),
                           (F.row_number().over(w) + len(SPECIAL_PIECES) - 1).cast("int").alias("id"))
    ranked = attach(ranked, total)
    return ranked.select("id", "piece", F.round(F.log(F.col("n") / F.col("total")), 6).alias("score"))


def with_specials(spark: SparkSession, ranked: DataFrame) -> DataFrame:
    return specials(spark).unionByName(ranked.select("id", "piece", "score"))


def read_vocab_text(spark: SparkSession, path: str) -> DataFrame:
    """``piece<TAB>score`` lines, id = 0-based line position (order-safe via zipWithIndex)."""
    lines = spark.sparkContext.textFile(path, minPartitions=1).zipWithIndex()
    rows = lines.map(lambda t: (int(t[1]), t[0].split("\t")[0],
                                float(t[0].split("\t")[1]) if "\t" in t[0] else 0.0))
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def write_vocab_text(vocab: DataFrame, path: str) -> None:
    """Vocabulary as ``piece<TAB>score`` text ordered by id (single small file)."""
    (vocab.orderBy("id").select(F.concat_ws("\t", "piece", F.col("score").cast("string")).alias("value"))
     .coalesce(1).write.mode("overwrite").text(path))


def piece_ids(vocab: DataFrame):
    """Broadcast piece -> id, once for a vocabulary, so that a worker has one table of it. It has at most ``vocab_size`` rows, whatever the corpus."""
    shared = getattr(vocab, "shared_ids", None)
    if shared is None:
        rows = vocab.select("id", "piece").collect()
        shared = vocab.shared_ids = vocab.sparkSession.sparkContext.broadcast({r["piece"]: int(r["id"]) for r in rows})
    return shared


IDS_TYPE = T.ArrayType(T.IntegerType())


def decode(df: DataFrame, ids_col: str, vocab: DataFrame, out: str = "text", unk_surface: str = UNK_SURFACE):
    """K9: ids -> text. pad/bos/eos are dropped, unk shows as ``unk_surface``;
    the boundary marker becomes a space and the leading space is removed."""
    return df.withColumn(out, decode_pieces(piece_ids(vocab), unk_surface)(F.col(ids_col)))
