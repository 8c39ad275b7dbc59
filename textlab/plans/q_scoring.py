"""Registered queries: prediction/reference scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from textlab.operators import scoring as SC
from textlab.operators.vectors import greedy_match
from textlab.plans import q_augment as QA
from textlab.plans import q_tokens as QT
from textlab.plans.registry import register
from textlab.sources import tables

KEYS = ["conv_id", "turn"]

PAIRS = """SELECT u.conv_id, u.turn, coalesce(u.text, '') AS reference, coalesce(a.text, '') AS prediction
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def _toks_sql(x):
    return (f"list_filter(string_split(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), "
            f"lambda t: t <> '')")


def _grams_sql(t, n):
    if n == 1:
        return t
    return (f"CASE WHEN len({t}) >= {n} THEN list_transform(range(0, len({t}) - {n - 1}), "
            f"lambda i: array_to_string({t}[i + 1:i + {n}], ' ')) ELSE []::VARCHAR[] END")


def _rouge_sql(n):
    return f"""WITH p AS (SELECT conv_id, turn, {_grams_sql('pt', n)} AS pg, {_grams_sql('rt', n)} AS rg FROM (
    SELECT conv_id, turn, {_toks_sql('prediction')} AS pt, {_toks_sql('reference')} AS rt FROM ({PAIRS}))),
pc AS (SELECT conv_id, turn, g, count(*) AS cp FROM (SELECT conv_id, turn, unnest(pg) AS g FROM p) GROUP BY ALL),
rc AS (SELECT conv_id, turn, g, count(*) AS cr FROM (SELECT conv_id, turn, unnest(rg) AS g FROM p) GROUP BY ALL),
ov AS (SELECT conv_id, turn, sum(least(cp, cr)) AS ov FROM pc JOIN rc USING (conv_id, turn, g) GROUP BY ALL),
s AS (SELECT conv_id, turn, coalesce(ov, 0) / greatest(len(pg), 1)::DOUBLE AS pr,
  coalesce(ov, 0) / greatest(len(rg), 1)::DOUBLE AS rc FROM p LEFT JOIN ov USING (conv_id, turn))
SELECT conv_id, turn, round(pr, 6) AS rouge{n}_p, round(rc, 6) AS rouge{n}_r,
  round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS rouge{n}_f FROM s"""


def tokenized_pairs(spark, sf_dir, stemmed: bool = False):
    p = tables.score_pairs(spark, sf_dir)
    p = p.select(*KEYS, "prediction", "reference",
                 SC.rouge_tokens("prediction").alias("pt"), SC.rouge_tokens("reference").alias("rt"))
    if stemmed:
        p = p.withColumn("pt", SC.stem_tokens("pt")).withColumn("rt", SC.stem_tokens("rt"))
    return p


def _round(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _rouge_query(n):
    def q(spark, sf_dir):
        r = SC.rouge_n(tokenized_pairs(spark, sf_dir), KEYS, "pt", "rt", n)
        return _round(r, [f"rouge{n}_p", f"rouge{n}_r", f"rouge{n}_f"])
    return q


register("rouge_n", _rouge_sql(1))(_rouge_query(1))
register("rouge_2", _rouge_sql(2))(_rouge_query(2))


@register("rouge_n_stemmed")
def rouge_n_stemmed(spark, sf_dir):
    """E1 and E2 with the Porter stemmer on tokens longer than 3 characters (ROUGE-1, ROUGE-2 and ROUGE-L)."""
    t = tokenized_pairs(spark, sf_dir, stemmed=True)
    r = SC.rouge_n(t, KEYS, "pt", "rt", 1).join(SC.rouge_n(t, KEYS, "pt", "rt", 2), KEYS).join(SC.rouge_l(t, KEYS, "pt", "rt"), KEYS)
    return _round(r, [c for c in r.columns if c.startswith("rouge")])


# the table of the longest common subsequence, a row for each prediction token, as a fold over lists
_LCS_SQL = f"""WITH t AS (SELECT conv_id, turn, {_toks_sql('prediction')} AS pt, {_toks_sql('reference')} AS rt FROM ({PAIRS})),
u AS (SELECT *, list_distinct(list_concat(pt, rt)) AS every FROM t),
x AS (SELECT conv_id, turn, list_transform(pt, lambda w: [list_position(every, w)::INTEGER]) AS xs,
  list_transform(rt, lambda w: list_position(every, w)::INTEGER) AS ys FROM u),
l AS (SELECT conv_id, turn, len(xs) AS n, len(ys) AS m, list_reduce(
    list_concat([list_transform(range(len(ys) + 1), lambda i: 0::INTEGER)], xs),
    lambda above, x: list_reduce(list_concat([[0::INTEGER]], list_transform(range(1, len(ys) + 1), lambda j: [j::INTEGER])),
      lambda row, j: list_append(row, CASE WHEN ys[j[1]] = x[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], row[len(row)]) END)
    ))[-1] AS lcs FROM x),
s AS (SELECT conv_id, turn, lcs / greatest(n, 1)::DOUBLE AS p, lcs / greatest(m, 1)::DOUBLE AS r FROM l)
SELECT conv_id, turn, round(p, 6) AS "rougeL_p", round(r, 6) AS "rougeL_r",
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS "rougeL_f" FROM s"""


@register("rouge_l", _LCS_SQL)
def rouge_l(spark, sf_dir):
    """ROUGE-L (LCS) precision, recall, F1 per pair, without the stemmer."""
    r = SC.rouge_l(tokenized_pairs(spark, sf_dir), KEYS, "pt", "rt")
    return _round(r, ["rougeL_p", "rougeL_r", "rougeL_f"])


@register("porter_stem")
def porter_stem(spark, sf_dir):
    """Every distinct scoring token stemmed once."""
    t = tokenized_pairs(spark, sf_dir)
    toks = t.select(F.explode(F.concat("pt", "rt")).alias("token"))
    return SC.stem_table(toks, "token")


@register("meteor")
def meteor(spark, sf_dir):
    """METEOR (exact, stem and lexicon-synonym stages; alpha 0.9, beta 3, gamma 0.5) on whitespace tokens."""
    p = tables.score_pairs(spark, sf_dir)
    u = SC.meteor_udf(SC.same_synonym_group)
    return p.select(*KEYS, F.round(u(SC.whitespace_tokens("prediction"), SC.whitespace_tokens("reference")), 6)
                    .alias("meteor"))


# --- fixed values -----------------------------------------------------------
MATCH_BASELINE = 0.25       # score of unrelated texts, which rescaling moves to 0
# ----------------------------------------------------------------------------
_TV = f"SELECT l.token, e.embedding::DOUBLE[] AS vec FROM ({QA.LEX}) l JOIN embeddings e ON e.vec_id = l.rank % (SELECT count(*) FROM embeddings)"
_BERT = f"""WITH tv AS ({_TV}),
pp AS (SELECT conv_id, turn, {_toks_sql('prediction')} AS pt, {_toks_sql('reference')} AS rt FROM ({PAIRS})),
pv AS (SELECT conv_id, turn, i, tv.vec FROM (SELECT conv_id, turn, unnest(pt) AS tok, generate_subscripts(pt, 1) AS i FROM pp) x
  JOIN tv ON tv.token = x.tok),
rv AS (SELECT conv_id, turn, j, tv.vec FROM (SELECT conv_id, turn, unnest(rt) AS tok, generate_subscripts(rt, 1) AS j FROM pp) x
  JOIN tv ON tv.token = x.tok),
s AS (SELECT pv.conv_id, pv.turn, pv.i, rv.j, list_cosine_similarity(pv.vec, rv.vec) AS c FROM pv JOIN rv USING (conv_id, turn)),
pm AS (SELECT conv_id, turn, avg(m) AS p FROM (SELECT conv_id, turn, i, max(c) AS m FROM s GROUP BY ALL) GROUP BY ALL),
rm AS (SELECT conv_id, turn, avg(m) AS r FROM (SELECT conv_id, turn, j, max(c) AS m FROM s GROUP BY ALL) GROUP BY ALL),
f AS (SELECT conv_id, turn, p, r, CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pm JOIN rm USING (conv_id, turn))
SELECT conv_id, turn, {', '.join(f'round(({c} - {MATCH_BASELINE}) / (1 - {MATCH_BASELINE}), 6) AS {n}' for c, n in (('p', 'precision'), ('r', 'recall'), ('f1', 'f1')))}
FROM ({PAIRS}) LEFT JOIN f USING (conv_id, turn)"""


@register("greedy_embedding_match", _BERT)
def greedy_embedding_match(spark, sf_dir):
    """E5: greedy cosine matching of token vectors (BERTScore-style P, R, F1, rescaled) per pair."""
    s = greedy_match(tokenized_pairs(spark, sf_dir), KEYS, "pt", "rt", QA.vectors(spark, sf_dir), MATCH_BASELINE)
    return s.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("zip_pairs", """SELECT u.conv_id, u.turn, coalesce(u.text, '') AS reference, coalesce(a.text, '') AS prediction
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
def zip_pairs(spark, sf_dir):
    """Predictions and references aligned by key (equi-join), never by position."""
    return tables.score_pairs(spark, sf_dir)


def score_all(spark, sf_dir):
    """Every metric of every pair; ROUGE on stemmed tokens."""
    t = tokenized_pairs(spark, sf_dir, stemmed=True)
    r1 = SC.rouge_n(t, KEYS, "pt", "rt", 1).select(*KEYS, "rouge1_f")
    r2 = SC.rouge_n(t, KEYS, "pt", "rt", 2).select(*KEYS, "rouge2_f")
    rl = SC.rouge_l(t, KEYS, "pt", "rt").select(*KEYS, "rougeL_f")
    m = meteor(spark, sf_dir)
    b = greedy_embedding_match(spark, sf_dir).select(*KEYS, F.col("precision").alias("bert_p"),
                                                      F.col("recall").alias("bert_r"), F.col("f1").alias("bert_f1"))
    return reduce(lambda x, y: x.join(y, KEYS, "left"), [r1, r2, rl, m, b])


@register("score_pairs")
def score_pairs(spark, sf_dir):
    """All metrics for every pair in one row."""
    s = score_all(spark, sf_dir)
    return _round(s, [c for c in s.columns if c not in KEYS])


@register("metric_means")
def metric_means(spark, sf_dir):
    """Mean of the per-pair scores (one row for the scored system)."""
    s = score_all(spark, sf_dir)
    cols = [c for c in s.columns if c not in KEYS]
    return s.agg(F.lit("assistant").alias("system"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


@register("tokenizer_compare", f"""SELECT max(CASE WHEN tokenizer = 'word' THEN ratio END) AS word_oov_ratio,
  max(CASE WHEN tokenizer = 'char' THEN ratio END) AS char_oov_ratio,
  max(CASE WHEN tokenizer = 'word' THEN tokens END) AS word_tokens,
  max(CASE WHEN tokenizer = 'char' THEN tokens END) AS char_tokens
FROM ({QT.ORACLE_OOV_SUMMARY})""")
def tokenizer_compare(spark, sf_dir):
    """Per-tokenizer results lined up side by side (union + pivot by tokenizer)."""
    o = QT.oov_summary(spark, sf_dir)
    g = o.groupBy().pivot("tokenizer", ["word", "char"]).agg(F.first("ratio").alias("oov_ratio"),
                                                             F.first("tokens").alias("tokens"))
    return g.select(F.col("word_oov_ratio"), F.col("char_oov_ratio"), F.col("word_tokens"), F.col("char_tokens"))
