"""Registered queries: tokenizer vocabularies, encodings, id sequences and token statistics
(K1, K2, K5, K6, K9, K10, K11, T19-T22, S5, F4, F9, A2, A10-A13, A19, A20, J3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from textlab.functions import sequences as SQ
from textlab.operators import filters as FL
from textlab.operators.common import attach
from textlab.operators import profile as PR
from textlab.operators.tokenizers import registry as TR
from textlab.operators.tokenizers.vocab import decode
from textlab.plans import preprocess as P
from textlab.plans import sqlgen as S
from textlab.plans import sqltok as Q
from textlab.plans import tokenize as TK
from textlab.plans.registry import PRELUDE, register
from textlab.session import stage_table

WV = TK.FIXTURE_VOCAB["word"]
CV = TK.FIXTURE_VOCAB["char"]
SQL_KINDS = (("word", WV), ("char", CV))


def _ids_text(c):
    return F.array_join(c, " ")


@register("train_word_vocab", Q.word_vocab(WV))
def train_word_vocab(spark, sf_dir):
    """K1: word vocabulary (4 specials, then pre-tokens by count desc, piece asc)."""
    return TK.train(spark, sf_dir, "word")


@register("train_char_vocab", Q.char_vocab(CV))
def train_char_vocab(spark, sf_dir):
    """K2: character vocabulary at coverage 1.0."""
    return TK.train(spark, sf_dir, "char")


def _encode_query(kind, v):
    def q(spark, sf_dir):
        """Articles and highlights encoded."""
        e = TK.encoded(spark, sf_dir, kind)
        return e.select("doc_id", F.size("article_ids").cast("bigint").alias("n_tokens"), _ids_text("article_ids").alias("ids"),
                        F.size("highlight_ids").cast("bigint").alias("highlight_tokens"), _ids_text("highlight_ids").alias("highlight_ids"))
    return q


def _both_encoded(kind, v):
    return (f"SELECT doc_id, a.n_tokens, a.ids, h.n_tokens AS highlight_tokens, h.ids AS highlight_ids "
            f"FROM ({Q.encoded_text(kind, v, 'cleaned_text')}) a JOIN ({Q.encoded_text(kind, v, 'highlights')}) h USING (doc_id)")


register("encode_word", _both_encoded("word", WV))(_encode_query("word", WV))
register("encode_char", _both_encoded("char", CV))(_encode_query("char", CV))

_DEC_ROWS = Q.token_rows("word", WV, "cleaned_text")


@register("decode_ids", f"""SELECT c.doc_id, coalesce(CASE WHEN s LIKE ' %' THEN substr(s, 2) ELSE s END, '') AS text FROM
({Q.CORPUS}) c LEFT JOIN (
  SELECT e.doc_id, replace(string_agg(CASE WHEN e.id = 1 THEN '⁇' ELSE v.piece END, '' ORDER BY e.pos), '▁', ' ') AS s
  FROM ({_DEC_ROWS}) e JOIN ({Q.vocab('word', WV)}) v ON v.id = e.id WHERE e.id NOT IN (0, 2, 3) GROUP BY e.doc_id
) d USING (doc_id)""")
def decode_ids(spark, sf_dir):
    """K9: decode the word encoding of each article back to text (unknown words show as ⁇)."""
    e = TK.encoded(spark, sf_dir, "word")
    vocab = TK.train(spark, sf_dir, "word")
    return decode(e, "article_ids", vocab, "text").select("doc_id", "text")


@register("encode_stats", f"SELECT doc_id, token_article_len, article_unk, token_highlight_len, summary_unk "
                          f"FROM ({Q.encode_stats('word', WV, Q.CORPUS)})")
def encode_stats(spark, sf_dir):
    """K10 + J3: token length and unk count per article and highlight (word tokenizer)."""
    return TK.encode_stats(TK.encoded(spark, sf_dir, "word"))


@register("index_align", f"SELECT doc_id, token_article_len, token_highlight_len, summary_unk "
                         f"FROM ({Q.filtered('char', CV)})")
def index_align(spark, sf_dir):
    """Highlight statistics attached to the rows kept by the token-length filter (same row, no index join)."""
    f = TK.length_filtered(spark, sf_dir, "char")
    return f.select("doc_id", "token_article_len", "token_highlight_len", "summary_unk")


# ---- id sequence functions on the word encoding ----------------------------
_WORD_ENC = Q.encoded_text("word", WV, "cleaned_text")


def _seq_query(name, spark_expr, sql_expr):
    @register(name, f"SELECT doc_id, {sql_expr} AS out FROM ({_WORD_ENC})")
    def q(spark, sf_dir):
        e = TK.encoded(spark, sf_dir, "word")
        return e.select("doc_id", spark_expr(F.col("article_ids")).alias("out"))
    return q


_seq_query("ids_wrap", lambda c: _ids_text(SQ.ids_wrap(c)),
           "CASE WHEN ids = '' THEN '2 3' ELSE '2 ' || ids || ' 3' END")
_seq_query("ids_strip_special", lambda c: _ids_text(SQ.ids_strip_special(SQ.ids_wrap(c))), "ids")
_seq_query("ids_truncate", lambda c: _ids_text(SQ.ids_truncate(c, 128)),
           "array_to_string(string_split(ids, ' ')[1:128], ' ')")
_seq_query("ids_count_value", lambda c: SQ.ids_count_value(c, SQ.UNK_ID),
           "CAST(len(list_filter(string_split(ids, ' '), lambda x: x = '1')) AS BIGINT)")
_seq_query("ids_text_roundtrip", lambda c: _ids_text(SQ.text_to_ids(SQ.ids_to_text(c))), "ids")


_WRAPPED = "string_split(CASE WHEN ids = '' THEN '2 3' ELSE '2 ' || ids || ' 3' END, ' ')"


@register("teacher_shift", f"""SELECT doc_id, array_to_string({_WRAPPED}[1:len({_WRAPPED}) - 1], ' ') AS dec_in,
  array_to_string({_WRAPPED}[2:], ' ') AS target FROM ({_WORD_ENC})""")
def teacher_shift(spark, sf_dir):
    """Decoder input (all but last) and target (all but first) of the wrapped sequence."""
    e = TK.encoded(spark, sf_dir, "word")
    a, b = SQ.teacher_shift(SQ.ids_wrap(F.col("article_ids")))
    return e.select("doc_id", _ids_text(a).alias("dec_in"), _ids_text(b).alias("target"))


# ---- filters and statistics over the word and char encodings ---------------

def _stats_union(spark, sf_dir, filtered: bool):
    parts = []
    for kind, _ in SQL_KINDS:
        d = TK.length_filtered(spark, sf_dir, kind) if filtered else TK.train_stats(spark, sf_dir, kind)
        parts.append(d.withColumn("tokenizer", F.lit(kind)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _sql_union(fn):
    return " UNION ALL ".join(f"SELECT '{k}' AS tokenizer, * FROM ({fn(k, v)})" for k, v in SQL_KINDS)


@register("filter_token_p90", f"SELECT tokenizer, doc_id, token_article_len FROM ({_sql_union(Q.filtered)})")
def filter_token_p90(spark, sf_dir):
    """keep rows with token length <= int(int(p90) * 1.1), per tokenizer."""
    return _stats_union(spark, sf_dir, True).select("tokenizer", "doc_id", "token_article_len")


@register("length_filter_report", f"""SELECT s.tokenizer, t.p90, t.threshold,
  CAST(count_if(s.token_article_len <= t.threshold) AS BIGINT) AS kept_samples,
  CAST(count(*) AS BIGINT) AS total_samples
FROM ({_sql_union(Q.train_stats)}) s JOIN ({_sql_union(Q.threshold)}) t USING (tokenizer)
GROUP BY s.tokenizer, t.p90, t.threshold""")
def length_filter_report(spark, sf_dir):
    """p90, threshold, kept and total samples per tokenizer."""
    out = []
    for kind, _ in SQL_KINDS:
        st = TK.train_stats(spark, sf_dir, kind)
        thr = FL.token_p90_threshold(st, "token_article_len")
        r = attach(st, thr).groupBy("p90", "threshold").agg(
            F.count_if(F.col("token_article_len") <= F.col("threshold")).alias("kept_samples"),
            F.count("*").alias("total_samples"))
        out.append(r.select(F.lit(kind).alias("tokenizer"), "p90", "threshold", "kept_samples", "total_samples"))
    return reduce(lambda a, b: a.unionByName(b), out)


def _len_long_sql():
    return (f"SELECT tokenizer, 'article' AS field, token_article_len AS n FROM ({_sql_union(Q.filtered)}) "
            f"UNION ALL SELECT tokenizer, 'highlight' AS field, token_highlight_len AS n FROM ({_sql_union(Q.filtered)})")


@register("length_stats", f"""SELECT tokenizer, field, CAST(count(*) AS BIGINT) AS count, round(avg(n::DOUBLE), 6) AS mean,
  round(stddev_pop(n::DOUBLE), 6) AS std, round(min(n)::DOUBLE, 6) AS min,
  round(quantile_cont(n::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n::DOUBLE, 0.8), 6) AS p80,
  round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95,
  round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99, round(max(n)::DOUBLE, 6) AS max
FROM ({_len_long_sql()}) GROUP BY tokenizer, field""")
def length_stats(spark, sf_dir):
    """A2: token-length statistics (population std, p50/80/90/95/99) per tokenizer and field."""
    u = _stats_union(spark, sf_dir, True)
    long = u.select("tokenizer", F.explode(F.array(
        F.struct(F.lit("article").alias("field"), F.col("token_article_len").alias("n")),
        F.struct(F.lit("highlight").alias("field"), F.col("token_highlight_len").alias("n")))).alias("s")
    ).select("tokenizer", "s.*")
    d = PR.length_stats(long, ["n"], group_cols=["tokenizer", "field"])
    return d.drop("column")


@register("oov_rate", f"""SELECT tokenizer,
  round(sum(article_unk)::DOUBLE / sum(token_article_len), 6) AS articles_rate,
  round(sum(summary_unk)::DOUBLE / sum(token_highlight_len), 6) AS summary_rate,
  CAST(sum(article_unk) AS BIGINT) AS total_article_unk, CAST(sum(summary_unk) AS BIGINT) AS total_summary_unk
FROM ({_sql_union(Q.filtered)}) GROUP BY tokenizer""")
def oov_rate(spark, sf_dir):
    """A10: unk share of article and summary tokens after the length filter."""
    u = _stats_union(spark, sf_dir, True)
    return u.groupBy("tokenizer").agg(
        F.round(F.try_divide(F.sum("article_unk").cast("double"), F.sum("token_article_len").cast("double")), 6)
        .alias("articles_rate"),
        F.round(F.try_divide(F.sum("summary_unk").cast("double"), F.sum("token_highlight_len").cast("double")), 6)
        .alias("summary_rate"),
        F.sum("article_unk").cast("bigint").alias("total_article_unk"),
        F.sum("summary_unk").cast("bigint").alias("total_summary_unk"))


_COMP = (f"SELECT tokenizer, token_article_len::DOUBLE / nullif(len(regexp_extract_all(cleaned_text, "
         f"'[\\p{{L}}\\p{{N}}_]+')), 0) AS compression FROM ({_sql_union(Q.filtered)})")


@register("compression_stats", f"""SELECT tokenizer, round(avg(compression), 6) AS mean,
  round(stddev_samp(compression), 6) AS std, round(quantile_cont(compression, 0.5), 6) AS median,
  round(quantile_cont(compression, 0.9), 6) AS p90 FROM ({_COMP}) GROUP BY tokenizer""")
def compression_stats(spark, sf_dir):
    """Tokens per word: mean, std (sample), median, p90 per tokenizer."""
    from textlab.operators.quantiles import quantiles
    u = TK.with_compression(_stats_union(spark, sf_dir, True)).select("tokenizer", "compression")
    from textlab.session import materialize
    u = materialize(u, "compression")
    m = u.groupBy("tokenizer").agg(F.avg("compression").alias("mean"), F.stddev_samp("compression").alias("std"))
    q = quantiles(u, "compression", [0.5, 0.9], ["tokenizer"])
    return m.join(q, "tokenizer").select(
        "tokenizer", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        F.round("q_0", 6).alias("median"), F.round("q_1", 6).alias("p90"))


@register("token_total", f"""SELECT tokenizer, CAST(sum(token_article_len + token_highlight_len + 4) AS BIGINT) AS tokens_count,
  CAST(count(*) AS BIGINT) AS n_rows FROM ({_sql_union(Q.filtered)}) GROUP BY tokenizer""")
def token_total(spark, sf_dir):
    """Total tokens of both columns including bos/eos (the size of the wrapped sequences)."""
    out = []
    for kind, _ in SQL_KINDS:
        st = TK.length_filtered(spark, sf_dir, kind)
        out.append(st.select(F.lit(kind).alias("tokenizer"), (F.col("token_article_len") + F.col("token_highlight_len") + 4).alias("n")))
    u = reduce(lambda a, b: a.unionByName(b), out)
    return u.groupBy("tokenizer").agg(F.sum("n").cast("bigint").alias("tokens_count"),
                                      F.count("*").alias("n_rows"))


def _split_rows(kind, v):
    """K11's input: train as filtered by token length (F4), validation as filtered by words (F2) with raw highlights, test raw. Rows
    are keyed by split and id."""
    def words(c):
        return f"len(regexp_extract_all({c}, '[^{S.WS}]+'))"

    return f"""SELECT 'train:' || doc_id AS doc_id, 'train' AS split, cleaned_text AS src_text, highlights AS src_highlights FROM ({Q.filtered(kind, v)})
UNION ALL SELECT split || ':' || doc_id, split, cleaned_text, highlights FROM ({S.CLEANED_PAIRS}) WHERE split = 'validation'
  AND {words('cleaned_text')} > 250 AND {words('highlights')}::DOUBLE / {words('cleaned_text')} BETWEEN 0.05 AND 0.5
UNION ALL SELECT split || ':' || doc_id, split, article, highlights FROM ({S.CLEANED_PAIRS}) WHERE split = 'test'"""


def _split_tokens(kind, v):
    name = f"split_rows_{kind}"
    PRELUDE.setdefault(name, _split_rows(kind, v))
    return f"SELECT * FROM {name}"


ORACLE_OOV_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{k}' AS tokenizer, CAST(sum(token_article_len + token_highlight_len + 4) AS BIGINT) AS tokens,
  CAST(sum(article_unk + summary_unk) AS BIGINT) AS unk,
  round(sum(article_unk + summary_unk)::DOUBLE / sum(token_article_len + token_highlight_len + 4), 6) AS ratio
FROM ({Q.filtered(k, v)})""" for k, v in SQL_KINDS)


def _oov(spark, sf_dir, kinds):
    u = reduce(lambda a, b: a.unionByName(b), [_encode_splits(spark, sf_dir, k) for k in kinds])
    unk = [SQ.ids_count_value(c, SQ.UNK_ID) for c in ("article_ids", "highlight_ids")]
    g = u.where(F.col("split") == "train").groupBy("tokenizer").agg(
        F.sum(F.size("article_ids") + F.size("highlight_ids")).alias("tokens"), F.sum(unk[0] + unk[1]).alias("unk"))
    return g.select("tokenizer", F.col("tokens").cast("bigint").alias("tokens"), F.col("unk").cast("bigint").alias("unk"),
                    F.round(F.try_divide(F.col("unk").cast("double"), F.col("tokens").cast("double")), 6).alias("ratio"))


@register("oov_summary", ORACLE_OOV_SUMMARY)
def oov_summary(spark, sf_dir):
    """Tokens, unk count and ratio per tokenizer over both encoded columns of the train split (with bos/eos)."""
    return _oov(spark, sf_dir, [k for k, _ in SQL_KINDS])


def _encode_splits(spark, sf_dir, kind):
    """The three splits with their own treatment (see ``_split_rows``), both columns wrapped with bos/eos."""
    def build():
        tok = TR.get(kind)
        vocab = TK.train(spark, sf_dir, kind)
        c = P.cleaned_pairs(spark, sf_dir)
        TK.train_encoded(spark, sf_dir, kind)               # written first, so that its numbers are read from it
        thr = FL.token_p90_threshold(TK.train_stats(spark, sf_dir, kind), "token_article_len")
        train = attach(TK.train_encoded(spark, sf_dir, kind), thr).where(F.size("article_ids") <= F.col("threshold")).select(       # F4, encoded already
            F.lit("train").alias("split"), "doc_id", F.col("article_ids").alias("a"), F.col("highlight_ids").alias("h"))
        val = FL.filter_len_ratio(FL.with_pair_lengths(c.where("split = 'validation'"), "cleaned_text", "highlights", unit="word")).select(
            "split", "doc_id", F.col("cleaned_text").alias("src_text"), F.col("highlights").alias("src_highlights"))
        test = c.where("split = 'test'").select("split", "doc_id", F.col("article").alias("src_text"), F.col("highlights").alias("src_highlights"))
        rest = val.unionByName(test)
        rest = tok.encode(tok.encode(rest, "src_text", vocab, "a"), "src_highlights", vocab, "h")
        rows = train.unionByName(rest.select("split", "doc_id", "a", "h"))
        return rows.select(F.concat_ws(":", "split", F.col("doc_id").cast("string")).alias("doc_id"), "split", F.lit(kind).alias("tokenizer"),
                           SQ.ids_wrap("a").alias("article_ids"), SQ.ids_wrap("h").alias("highlight_ids"))
    return stage_table(spark, f"splits:{kind}:{sf_dir}", build)


def _splits_sql(kind, v):
    src = _split_tokens(kind, v)
    return f"""SELECT a.doc_id, s.split,
  CASE WHEN a.ids = '' THEN '2 3' ELSE '2 ' || a.ids || ' 3' END AS tokenized_articles,
  CASE WHEN h.ids = '' THEN '2 3' ELSE '2 ' || h.ids || ' 3' END AS tokenized_highlights
FROM ({Q.encoded_text(kind, v, 'src_text', src)}) a
JOIN ({Q.encoded_text(kind, v, 'src_highlights', src)}) h USING (doc_id)
JOIN ({src}) s USING (doc_id)"""


def _splits_query(kind):
    def q(spark, sf_dir):
        """Articles and highlights of the three splits encoded with bos/eos."""
        e = _encode_splits(spark, sf_dir, kind)
        return e.select("doc_id", "split", _ids_text("article_ids").alias("tokenized_articles"),
                        _ids_text("highlight_ids").alias("tokenized_highlights"))
    return q


register("tokenize_splits", _splits_sql("word", WV))(_splits_query("word"))
register("tokenize_splits_char", _splits_sql("char", CV))(_splits_query("char"))


@register("derive_seq_limits", f"""SELECT
  CAST(floor(quantile_cont(token_highlight_len::DOUBLE, 0.99)) AS BIGINT) AS max_len,
  CAST(min(token_highlight_len) AS BIGINT) AS min_len,
  CAST(floor(max(token_article_len) / 1.1) AS BIGINT) AS input_len,
  CAST(trunc(avg(token_article_len::DOUBLE)) AS BIGINT) AS mean_article, CAST(trunc(avg(token_highlight_len::DOUBLE)) AS BIGINT) AS mean_highlight,
  CAST(count(*) AS BIGINT) AS n_samples FROM ({Q.filtered('word', WV)})""")
def derive_seq_limits(spark, sf_dir):
    """decoder/encoder length limits derived from the token-length statistics row."""
    f = TK.length_filtered(spark, sf_dir, "word")
    from textlab.operators.quantiles import quantiles
    q = quantiles(f, "token_highlight_len", [0.99])
    m = f.agg(F.min("token_highlight_len").alias("min_len"), F.max("token_article_len").alias("max_art"),
              F.avg("token_article_len").alias("mean_article"), F.avg("token_highlight_len").alias("mean_highlight"),
              F.count("*").alias("n_samples"))
    r = attach(m, q)
    return r.select(F.floor("q_0").cast("bigint").alias("max_len"), F.col("min_len").cast("bigint").alias("min_len"),
                    F.floor(F.col("max_art") / F.lit(1.1)).cast("bigint").alias("input_len"),
                    F.col("mean_article").cast("bigint").alias("mean_article"),
                    F.col("mean_highlight").cast("bigint").alias("mean_highlight"), "n_samples")


@register("filter_long_sentences", f"""SELECT doc_id FROM ({S.CLEANED_PAIRS})
WHERE octet_length(encode(coalesce(cleaned_text, '') || ' ' || coalesce(cleaned_highlights, ''))) <= 4096""")
def filter_long_sentences(spark, sf_dir):
    """training lines (article + summary) within the Unigram trainer's 4096-byte limit."""
    from textlab.functions.text import concat_fields
    c = P.cleaned_pairs(spark, sf_dir).select("doc_id", concat_fields("cleaned_text", "cleaned_highlights").alias("line"))
    return FL.filter_long_sentences(c, "line", FL.MAX_SENTENCE_BYTES["unigram"]).select("doc_id")


# ---- iterative tokenizers (rows-only checks; pytest holds their references) ---

@register("train_bpe")
def train_bpe(spark, sf_dir):
    """K3: BPE vocabulary (specials, merged pieces by rank with score -rank, characters)."""
    return TK.train(spark, sf_dir, "bpe")


@register("train_unigram")
def train_unigram(spark, sf_dir):
    """K4: Unigram-LM vocabulary (EM + pruning), pieces by log-probability."""
    return TK.train(spark, sf_dir, "unigram")


register("encode_bpe")(_encode_query("bpe", TK.FIXTURE_VOCAB["bpe"]))
register("encode_unigram")(_encode_query("unigram", TK.FIXTURE_VOCAB["unigram"]))


def _alphabet(coverage):
    """The trainers' alphabet, one row with a list, as a named table."""
    name = f"alphabet_{round(coverage * 10000)}"
    PRELUDE.setdefault(name, f"SELECT list(piece) AS known FROM ({Q.char_vocab(10**9, coverage)}) WHERE id > 3")
    return name


def _spelled(col):
    """``col`` with single spaces, characters outside the list ``known`` as the unk sign."""
    norm = f"trim(regexp_replace(coalesce({col}, ''), '[{S.WS}]+', ' ', 'g'))"
    return f"""array_to_string(list_transform(string_split({norm}, ''),
    lambda c: CASE WHEN c = ' ' OR list_contains(known, c) THEN c ELSE '⁇' END), '')"""


def _decoded(kind, coverage):
    @register(f"decode_{kind}", f"SELECT doc_id, {_spelled('cleaned_text')} AS text, {_spelled('highlights')} AS highlights FROM ({Q.CORPUS}), {_alphabet(coverage)}")
    def q(spark, sf_dir):
        """K7/K8 and K9: articles and highlights encoded and decoded again: the text with single spaces, unknown characters as ⁇."""
        e, vocab = TK.encoded(spark, sf_dir, kind), TK.train(spark, sf_dir, kind)
        return decode(decode(e.select("doc_id", "article_ids", "highlight_ids"), "article_ids", vocab, "text"), "highlight_ids", vocab, "highlights").select(
            "doc_id", "text", "highlights")
    return q


_decoded("bpe", 1.0)
_decoded("unigram", 0.9995)


@register("oov_summary_all")
def oov_summary_all(spark, sf_dir):
    """A13 for all four tokenizers."""
    return _oov(spark, sf_dir, TR.NAMES)
