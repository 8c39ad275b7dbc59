"""Registered queries: text cleaning and per-row text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import cleaning as C
from textlab.functions import text as X
from textlab.functions.cleaning import IMPACT_PATTERNS
from textlab.plans import preprocess as P
from textlab.plans import sqlgen as S
from textlab.plans.registry import register
from textlab.sources import tables

NOISY = S.NOISY


def _noisy_q(fn, sql_fn, name):
    @register(name, f"SELECT doc_id, {sql_fn('article')} AS out FROM ({NOISY})")
    def q(spark, sf_dir):
        return tables.noisy_articles(spark, sf_dir).select("doc_id", fn("article").alias("out"))
    return q


_noisy_q(C.strip_byline, S.strip_byline, "strip_byline")
_noisy_q(C.strip_wire_marker, S.strip_wire, "strip_wire_marker")
_noisy_q(C.strip_dateline, S.strip_dateline, "strip_dateline")
_noisy_q(C.ascii_fold, S.ascii_fold, "ascii_fold")
_noisy_q(C.drop_disallowed, S.drop_disallowed, "drop_disallowed")
_noisy_q(C.squeeze_ws_unicode, S.squeeze_unicode, "squeeze_ws")
_noisy_q(C.fix_punct, S.fix_punct, "fix_punct")
_noisy_q(C.straight_quotes, S.straight_quotes, "straight_quotes")


@register("clean_text", f"SELECT doc_id, {S.clean('article')} AS cleaned_text FROM ({NOISY})")
def clean_text(spark, sf_dir):
    """The full cleaning chain on the noisy articles (the cleaned-corpus stage table's column)."""
    return P.cleaned_pairs(spark, sf_dir).select("doc_id", "cleaned_text")


@register("removed_chars",
          f"SELECT doc_id, {S.removed('article')} AS removed_chars FROM ({NOISY})")
def removed_chars(spark, sf_dir):
    """Characters removed by fold + filter per document (may be negative)."""
    return P.cleaned_pairs(spark, sf_dir).select("doc_id", F.col("removed_chars").cast("bigint").alias("removed_chars"))


@register("newline_to_space", "SELECT doc_id, replace(text, chr(10), ' ') AS out FROM documents")
def newline_to_space(spark, sf_dir):
    d = tables.load(spark, sf_dir, "documents")
    return d.select("doc_id", C.newline_to_space("text").alias("out"))


@register("char_len", "SELECT doc_id, CAST(length(text) AS BIGINT) AS char_len FROM documents")
def char_len(spark, sf_dir):
    d = tables.load(spark, sf_dir, "documents")
    return d.select("doc_id", X.char_len("text").alias("char_len"))


@register("word_len_ws",
          f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{S.WS}]+')) AS BIGINT) AS word_len FROM documents")
def word_len_ws(spark, sf_dir):
    d = tables.load(spark, sf_dir, "documents")
    return d.select("doc_id", X.word_len_ws("text").alias("word_len"))


@register("word_len_re",
          "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS BIGINT) AS word_len FROM documents")
def word_len_re(spark, sf_dir):
    d = tables.load(spark, sf_dir, "documents")
    return d.select("doc_id", X.word_len_re("text").alias("word_len"))


@register("len_ratio",
          f"SELECT doc_id, round(length(highlights)::DOUBLE / nullif(length(article), 0), 6) AS ratio "
          f"FROM ({S.RAW_PAIRS})")
def len_ratio(spark, sf_dir):
    p = P.raw_pairs(spark, sf_dir)
    return p.select("doc_id", F.round(X.len_ratio(F.length("highlights"), F.length("article")), 6).alias("ratio"))


@register("pretokenize",
          f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{S.PRETOKEN}'), ' ') AS pretokens FROM documents")
def pretokenize(spark, sf_dir):
    """``\\d+|\\w+|[^\\w\\s]`` pre-tokens joined by spaces."""
    d = tables.load(spark, sf_dir, "documents")
    return d.select("doc_id", X.pretokenize("text").alias("pretokens"))


@register("concat_fields",
          f"SELECT doc_id, coalesce(article, '') || ' ' || coalesce(highlights, '') AS text FROM ({S.RAW_PAIRS})")
def concat_fields(spark, sf_dir):
    p = P.raw_pairs(spark, sf_dir)
    return p.select("doc_id", X.concat_fields("article", "highlights").alias("text"))


_PAT_SQL = ", ".join(
    f"CAST(len(regexp_extract_all(article, '{p}')) AS BIGINT) AS {n}" for n, p in IMPACT_PATTERNS.items())


@register("count_pattern", f"SELECT doc_id, {_PAT_SQL} FROM ({NOISY})")
def count_pattern(spark, sf_dir):
    """Non-overlapping matches of each profile pattern per document."""
    n = tables.noisy_articles(spark, sf_dir)
    return n.select("doc_id", *[X.count_pattern("article", p).alias(k) for k, p in IMPACT_PATTERNS.items()])


@register("src_splits",
          f"SELECT doc_id, split, article, highlights FROM ({S.RAW_PAIRS})")
def src_splits(spark, sf_dir):
    """The three splits as one tagged frame (train/validation/test by doc_id)."""
    return P.raw_pairs(spark, sf_dir)
