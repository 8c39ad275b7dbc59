"""Input tables and the derived fixtures every query starts from.

All fixtures are lazy DataFrames over the parquet tables, so their work
grows with the input; none is materialized on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.text import pretokens

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# --- fixed values -----------------------------------------------------------
# Lexicon fixture: POS by word length modulo 6.
POS_BY_LEN_MOD6 = {0: "VERB", 1: "ADJ", 2: "ADV", 3: "DET"}  # others: NOUN
DEFAULT_POS = "NOUN"
PUNCT_POS = "PUNCT"
# ----------------------------------------------------------------------------


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than there are cores (a small
    input with few row groups) before CPU-heavy text work; scans that already
    have enough partitions -- any large input -- are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def noisy_article_expr(text="text", doc_id="doc_id") -> F.Column:
    """News-style noise injected by ``doc_id % 8`` (byline, wire marker, dateline, ...)."""
    t = F.col(text)
    k = (F.col(doc_id) % 8).cast("int")
    return (
        F.when(k == 0, F.concat(F.lit("By . Jane Doe . "), t))
        .when(k == 1, F.concat(F.lit("(CNN) -- "), t))
        .when(k == 2, F.concat(F.lit("By . Jane Doe . PUBLISHED: . 05:00 EST, 1 May 2012 . | . "
                                     "UPDATED: . 06:00 EST, 1 May 2012 . "), t))
        .when(k == 3, F.replace(t, F.lit(", "), F.lit(" -- ")))
        .when(k == 4, F.concat(F.lit("“"), F.replace(t, F.lit(". "), F.lit(" ... ")), F.lit("”")))
        .when(k == 5, F.replace(t, F.lit(" the "), F.lit(" ( the ) ")))
        .when(k == 6, F.replace(t, F.lit("and"), F.lit("don’t")))
        .otherwise(t)
    )


def noisy_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, article)``."""
    return load(spark, sf_dir, "documents").select("doc_id", noisy_article_expr().alias("article"))


def first_line(x) -> F.Column:
    return F.substring_index(F.coalesce(x, F.lit("")), "\n", 1)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, article, highlights)``: noisy article + first line of the raw text (one scan)."""
    return balanced(load(spark, sf_dir, "documents")).select(
        "doc_id", noisy_article_expr().alias("article"), first_line(F.col("text")).alias("highlights"))


def split_name(doc_id) -> F.Column:
    """train = ``doc_id % 10 < 8``, validation = 8, test = 9."""
    m = doc_id % 10
    return F.when(m < 8, "train").when(m == 8, "validation").otherwise("test")


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, reference, prediction)``: a user turn and the assistant reply at the
    next turn, aligned by key (equi-join on ``(conv_id, turn + 1)``; no per-conversation window)."""
    c = load(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("reference"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("prediction"))
    return u.join(a, ["conv_id", "turn"])


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, step, loss, ingest_seq)`` log rows derived from ``events``."""
    e = load(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 5).alias("run"),
                    (F.col("event_id") % 500).alias("step"),
                    F.col("value").alias("loss"),
                    F.col("event_id").alias("ingest_seq"))


def weighted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, item, score)``: per-user total value by event type."""
    e = load(spark, sf_dir, "events")
    return (e.groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("item"))
            .agg(F.sum("value").alias("score")))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(token, pos, letter, lemma, rank, member, members)``: the dictionary of all words of the corpus.

    Entries are all lower-case alphabetic pre-tokens of ``documents``; ``rank`` is their place by (count desc, token asc). POS is assigned by
    word length. The entries of one POS and first letter are synonyms of each other; ``member`` is an entry's place among them in
    alphabetical order (from 0), ``members`` their number. So the n-th synonym of a word is a computed place, and no list of
    synonyms is stored. The table grows with the vocabulary and stays distributed; both numberings are range-partitioned.
    """
    from textlab.operators.prefix import global_row_number
    d = balanced(load(spark, sf_dir, "documents").select("text"))
    counts = (d.select(F.explode(pretokens("text")).alias("token"))
              .where(F.col("token").rlike("^[a-z]+$"))
              .groupBy("token").count())
    ln = F.length("token") % 6
    pos = F.lit(DEFAULT_POS)
    for m, tag in sorted(POS_BY_LEN_MOD6.items(), reverse=True):
        pos = F.when(ln == m, tag).otherwise(pos)
    ranked = global_row_number(counts, [F.desc("count"), F.col("token")], out="rank").select(
        "token", pos.alias("pos"), F.substring("token", 1, 1).alias("letter"), F.col("rank").cast("bigint").alias("rank"))
    placed = global_row_number(ranked, ["pos", "letter", "token"], ["pos", "letter"], out="member")
    sizes = placed.groupBy("pos", "letter").agg(F.count("*").alias("members"))        # one row for a POS and letter
    return placed.join(sizes, ["pos", "letter"]).select(
        "token", "pos", "letter", F.col("token").alias("lemma"), "rank", (F.col("member") - 1).cast("bigint").alias("member"), "members")


def token_vectors(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None) -> DataFrame:
    """``(token, vec ARRAY<DOUBLE>)``: lexicon entry of rank r -> ``embeddings.vec_id`` = r modulo the rows of the table."""
    rows = max(1, load(spark, sf_dir, "embeddings").count())
    lex = (lexicon(spark, sf_dir) if lex is None else lex).select("token", (F.col("rank") % rows).alias("vec_id"))
    emb = load(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    return emb.join(lex, "vec_id").select("token", "vec")
