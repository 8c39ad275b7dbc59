"""Registered queries: augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.operators import augment as AG
from textlab.operators import profile as PR
from textlab.plans import sqlgen as S
from textlab.plans import sqltok as Q
from textlab.plans import tokenize as TK
from textlab.plans import registry
from textlab.plans.registry import register
from textlab.session import stage_table
from textlab.sources import tables

KEYS = ["doc_id", "field"]
TAGS = AG.TAGS
FIXTURE_RARE = ("DET", "PUNCT")  # labels folded into "Other" by the rare_to_other fixture query


def fields(spark, sf_dir):
    """``(doc_id, field, text)``: articles and highlights of the training corpus as one frame."""
    c = TK.corpus(spark, sf_dir)
    return c.select("doc_id", F.explode(F.array(
        F.struct(F.lit("article").alias("field"), F.col("cleaned_text").alias("text")),
        F.struct(F.lit("highlights").alias("field"), F.col("highlights").alias("text")))).alias("s")
    ).select("doc_id", "s.field", "s.text")


def lexicon(spark, sf_dir):
    return stage_table(spark, f"lexicon:{sf_dir}", lambda: tables.lexicon(spark, sf_dir))


def tagged(spark, sf_dir):
    """Every pre-token with its tag and lexicon entry."""
    return AG.tag_tokens(fields(spark, sf_dir), KEYS, "text", lexicon(spark, sf_dir))


def chosen(spark, sf_dir):
    """The counts and the tokens to replace of every document field, written once."""
    def build():
        lex = lexicon(spark, sf_dir)
        return AG.choose_replacements(AG.tag_documents(fields(spark, sf_dir), KEYS, "text", lex), KEYS, lex)
    return stage_table(spark, f"chosen:{sf_dir}", build)


def picks(spark, sf_dir):
    """The replaced tokens with their synonyms, written once."""
    return stage_table(spark, f"picks:{sf_dir}", lambda: AG.picked(chosen(spark, sf_dir), KEYS, lexicon(spark, sf_dir)))


def augmented(spark, sf_dir):
    return stage_table(spark, f"augmented:{sf_dir}", lambda: AG.augment_docs(
        fields(spark, sf_dir), KEYS, "text", lexicon(spark, sf_dir), chosen=chosen(spark, sf_dir), picks=picks(spark, sf_dir)))


# ---- DuckDB side ------------------------------------------------------------
LEX = f"""WITH c AS (SELECT tok AS token, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(text, '{S.PRETOKEN}')) AS tok FROM documents)
  WHERE regexp_full_match(tok, '[a-z]+') GROUP BY tok),
t AS (SELECT token, CASE length(token) % 6 WHEN 0 THEN 'VERB' WHEN 1 THEN 'ADJ' WHEN 2 THEN 'ADV'
  WHEN 3 THEN 'DET' ELSE 'NOUN' END AS pos, substr(token, 1, 1) AS letter, row_number() OVER (ORDER BY n DESC, token) AS rank FROM c)
SELECT token, pos, letter, token AS lemma, rank, row_number() OVER (PARTITION BY pos, letter ORDER BY token) - 1 AS member,
  count(*) OVER (PARTITION BY pos, letter) AS members FROM t"""

FIELDS = (f"SELECT doc_id, 'article' AS field, cleaned_text AS text FROM ({Q.CORPUS}) "
          f"UNION ALL SELECT doc_id, 'highlights' AS field, highlights AS text FROM ({Q.CORPUS})")

_PUNCT = "'[^\\p{L}\\p{N}_]+'"
_K = "'42:' || doc_id || ':' || field || ':' || pos_in_doc"

TOKROWS = f"""WITH lex AS ({LEX}),
tk AS (SELECT doc_id, field, unnest(xs) AS token, generate_subscripts(xs, 1) - 1 AS pos_in_doc
  FROM (SELECT doc_id, field, regexp_extract_all(coalesce(text, ''), '{S.PRETOKEN}') AS xs FROM ({FIELDS}))),
tg AS (SELECT tk.*, CASE WHEN regexp_full_match(tk.token, {_PUNCT}) THEN 'PUNCT' ELSE coalesce(l.pos, 'NOUN') END AS tag,
  l.pos AS lpos, l.letter, l.member, l.members FROM tk LEFT JOIN lex l ON l.token = lower(tk.token)),
w AS (SELECT *, tag IN ('VERB', 'ADJ', 'ADV') AS is_cand, (tag IN ('VERB', 'ADJ', 'ADV') AND coalesce(members, 0) > 1) AS has_syn,
  sum(CASE WHEN tag NOT IN ('PUNCT', 'DET') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, field) AS content,
  sum(CASE WHEN tag IN ('VERB', 'ADJ', 'ADV') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, field) AS n_cand FROM tg),
r AS (SELECT *, least(floor(content * 0.15), n_cand) AS k,
  row_number() OVER (PARTITION BY doc_id, field ORDER BY has_syn DESC, md5({_K})) AS rk FROM w),
d AS (SELECT *, (has_syn AND rk <= k) AS repl,
  CASE WHEN has_syn AND rk <= k THEN ('0x' || substr(md5({_K} || ':syn'), 1, 8))::BIGINT % (members - 1) END AS at FROM r),
o AS (SELECT d.*, CASE WHEN repl THEN s.token ELSE d.token END AS out_token
  FROM d LEFT JOIN lex s ON s.pos = d.lpos AND s.letter = d.letter AND s.member = CASE WHEN d.at < d.member THEN d.at ELSE d.at + 1 END)
SELECT o.*, CASE WHEN regexp_full_match(out_token, {_PUNCT}) THEN 'PUNCT' ELSE coalesce(l2.pos, 'NOUN') END AS out_tag
FROM o LEFT JOIN lex l2 ON l2.token = lower(o.out_token)"""

_CNT = ", ".join([f"count_if(repl AND tag = '{p}') AS replaced_{p}" for p in ("ADJ", "ADV", "VERB")]
                 + [f"count_if(tag = '{p}') AS before_{p}" for p in TAGS]
                 + [f"count_if(out_tag = '{p}') AS after_{p}" for p in TAGS])
DOCS = f"""SELECT d.doc_id, d.field, coalesce(string_agg(out_token, ' ' ORDER BY pos_in_doc), '') AS aug_text,
  count(token) AS tokens_total, count_if(is_cand) AS tokens_candidate, count_if(repl) AS tokens_replaced,
  coalesce(max(content), 0) AS content_tokens, {_CNT},
  count_if(repl)::DOUBLE / greatest(1, coalesce(max(content), 0)) AS replace_ratio_actual
FROM ({FIELDS}) d LEFT JOIN ({TOKROWS}) t USING (doc_id, field) GROUP BY d.doc_id, d.field"""

_STAT_COLS = ["tokens_total", "tokens_candidate", "tokens_replaced", "content_tokens",
              "replaced_ADJ", "replaced_ADV", "replaced_VERB"]


def _dist_sql(phase):
    return " UNION ALL ".join(
        f"SELECT doc_id, field, '{phase}' AS phase, '{p}' AS tag, {phase}_{p}::DOUBLE / tokens_total AS share "
        f"FROM ({DOCS}) WHERE {phase}_{p} > 0 AND tokens_total > 0" for p in TAGS)


DIST = f"{_dist_sql('before')} UNION ALL {_dist_sql('after')}"
CORPUS_SHARE = (f"SELECT phase, tag, s / sum(s) OVER (PARTITION BY phase) AS share FROM "
                f"(SELECT phase, tag, sum(share) AS s FROM ({DIST}) GROUP BY phase, tag)")


# ---- queries -----------------------------------------------------------------

@register("lexicon_tag", f"SELECT doc_id, field, CAST(pos_in_doc AS INT) AS pos_in_doc, token, tag FROM ({TOKROWS})")
def lexicon_tag(spark, sf_dir):
    """POS tag of every pre-token by the lexicon of all words (PUNCT by pattern, default NOUN)."""
    return tagged(spark, sf_dir).where(F.col("token").isNotNull()).select(*KEYS, "pos_in_doc", "token", "tag")


@register("synonym_lookup", f"""WITH x AS ({LEX}), t AS ({TOKROWS})
SELECT t.doc_id, t.field, CAST(t.pos_in_doc AS INT) AS pos_in_doc, t.token, CAST(greatest(coalesce(t.members, 0) - 1, 0) AS BIGINT) AS n_synonyms,
  f.token AS first_synonym, z.token AS last_synonym
FROM t LEFT JOIN x f ON f.pos = t.lpos AND f.letter = t.letter AND t.members > 1 AND f.member = CASE WHEN t.member = 0 THEN 1 ELSE 0 END
LEFT JOIN x z ON z.pos = t.lpos AND z.letter = t.letter AND t.members > 1 AND z.member = t.members - CASE WHEN t.member = t.members - 1 THEN 2 ELSE 1 END
WHERE t.is_cand""")
def synonym_lookup(spark, sf_dir):
    """For each candidate the number of its synonyms (lemma, POS; the word itself is none, whatever its case), the first and the last."""
    t = tagged(spark, sf_dir).where(F.col("tag").isin(*AG.CANDIDATE_POS))
    ends = lexicon(spark, sf_dir).groupBy("pos", "letter").agg(                # a row for a POS and letter
        F.max(F.when(F.col("member") == 0, F.col("token"))).alias("a0"), F.max(F.when(F.col("member") == 1, F.col("token"))).alias("a1"),
        F.max(F.when(F.col("member") == F.col("members") - 1, F.col("token"))).alias("z0"),
        F.max(F.when(F.col("member") == F.col("members") - 2, F.col("token"))).alias("z1"))
    t = t.join(F.broadcast(ends), ["pos", "letter"], "left")
    some = F.col("members") > 1
    return t.select(*KEYS, "pos_in_doc", "token", F.greatest(F.coalesce("members", F.lit(0)) - 1, F.lit(0)).cast("bigint").alias("n_synonyms"),
                    F.when(some, F.when(F.col("member") == 0, F.col("a1")).otherwise(F.col("a0"))).alias("first_synonym"),
                    F.when(some, F.when(F.col("member") == F.col("members") - 1, F.col("z1")).otherwise(F.col("z0"))).alias("last_synonym"))


@register("filter_pos_candidates", f"SELECT doc_id, field, CAST(pos_in_doc AS INT) AS pos_in_doc, token, tag "
                                   f"FROM ({TOKROWS}) WHERE is_cand")
def filter_pos_candidates(spark, sf_dir):
    """VERB/ADJ/ADV tokens."""
    return tagged(spark, sf_dir).where(F.col("tag").isin(*AG.CANDIDATE_POS)).select(*KEYS, "pos_in_doc", "token", "tag")


@register("filter_content_tokens", f"SELECT doc_id, field, CAST(content_tokens AS BIGINT) AS content_tokens FROM ({DOCS})")
def filter_content_tokens(spark, sf_dir):
    """tokens that are not PUNCT/DET per document field."""
    return augmented(spark, sf_dir).select(*KEYS, F.col("content_tokens").cast("bigint").alias("content_tokens"))


@register("sample_k_per_doc", f"SELECT doc_id, field, CAST(pos_in_doc AS INT) AS pos_in_doc FROM ({TOKROWS}) WHERE repl")
def sample_k_per_doc(spark, sf_dir):
    """The k replaced positions per document field (seeded hash order among candidates with synonyms)."""
    return chosen(spark, sf_dir).select(*KEYS, F.explode("picks.pos_in_doc").alias("pos_in_doc"))


@register("pick_synonym", f"SELECT doc_id, field, CAST(pos_in_doc AS INT) AS pos_in_doc, token, out_token "
                          f"FROM ({TOKROWS}) WHERE repl")
def pick_synonym(spark, sf_dir):
    """The synonym chosen for each replaced token."""
    return picks(spark, sf_dir).select(*KEYS, "pos_in_doc", "token", "out_token")


@register("augment_text", f"SELECT doc_id, field, aug_text FROM ({DOCS})")
def augment_text(spark, sf_dir):
    """G1: augmented text of every article and highlight."""
    return augmented(spark, sf_dir).select(*KEYS, "aug_text")


@register("augment_batch", f"""SELECT doc_id, max(CASE WHEN field = 'article' THEN aug_text END) AS cleaned_text,
  max(CASE WHEN field = 'highlights' THEN aug_text END) AS highlights FROM ({DOCS}) GROUP BY doc_id""")
def augment_batch(spark, sf_dir):
    """Articles and highlights augmented in one job, back to one row per pair."""
    a = augmented(spark, sf_dir)
    return a.groupBy("doc_id").agg(F.max(F.when(F.col("field") == "article", F.col("aug_text"))).alias("cleaned_text"),
                                   F.max(F.when(F.col("field") == "highlights", F.col("aug_text"))).alias("highlights"))


@register("augment_stats", f"""SELECT doc_id, field, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _STAT_COLS)},
  round(replace_ratio_actual, 6) AS replace_ratio_actual FROM ({DOCS})""")
def augment_stats(spark, sf_dir):
    """Per document field: tokens, candidates, replaced, actual ratio, replaced per POS."""
    a = augmented(spark, sf_dir)
    return a.select(*KEYS, *[F.col(c).cast("bigint").alias(c) for c in _STAT_COLS],
                    F.round("replace_ratio_actual", 6).alias("replace_ratio_actual"))


@register("pos_distribution", f"SELECT doc_id, field, phase, tag, round(share, 6) AS share FROM ({DIST})")
def pos_distribution(spark, sf_dir):
    """Normalized POS counts per document field, before and after augmentation."""
    a = augmented(spark, sf_dir)
    b = AG.pos_distribution(a, KEYS, "before").withColumn("phase", F.lit("before"))
    f = AG.pos_distribution(a, KEYS, "after").withColumn("phase", F.lit("after"))
    return b.unionByName(f).select(*KEYS, "phase", "tag", F.round("share", 6).alias("share"))


def _corpus_share(spark, sf_dir, phase):
    return AG.pos_corpus_share(AG.pos_distribution(augmented(spark, sf_dir), KEYS, phase))


@register("pos_corpus_share", f"SELECT phase, tag, round(share, 6) AS share FROM ({CORPUS_SHARE})")
def pos_corpus_share(spark, sf_dir):
    """Corpus POS shares (sum of per-document shares, renormalized), before and after."""
    b = _corpus_share(spark, sf_dir, "before").withColumn("phase", F.lit("before"))
    f = _corpus_share(spark, sf_dir, "after").withColumn("phase", F.lit("after"))
    return b.unionByName(f).select("phase", "tag", F.round("share", 6).alias("share"))


@register("rare_to_other", f"""SELECT CASE WHEN tag IN {tuple(FIXTURE_RARE)} THEN 'Other' ELSE tag END AS tag,
  round(sum(share), 6) AS share FROM ({CORPUS_SHARE}) WHERE phase = 'before' GROUP BY 1""")
def rare_to_other(spark, sf_dir):
    """Corpus shares with the minor labels folded into 'Other'."""
    r = AG.rare_to_other(_corpus_share(spark, sf_dir, "before"), "tag", "share", FIXTURE_RARE)
    return r.select("tag", F.round("share", 6).alias("share"))


@register("replaced_by_pos", f"""SELECT pos, CAST(n AS BIGINT) AS replaced, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM (
  SELECT 'ADJ' AS pos, sum(replaced_ADJ) AS n FROM ({DOCS}) UNION ALL SELECT 'ADV', sum(replaced_ADV) FROM ({DOCS})
  UNION ALL SELECT 'VERB', sum(replaced_VERB) FROM ({DOCS}))""")
def replaced_by_pos(spark, sf_dir):
    """Replaced tokens per POS and their share."""
    a = augmented(spark, sf_dir)
    t = a.agg(*[F.sum(f"replaced_{p}").alias(p) for p in ("ADJ", "ADV", "VERB")])
    long = t.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.col(p).alias("n"))
                                        for p in ("ADJ", "ADV", "VERB")])).alias("s"),
                    (F.col("ADJ") + F.col("ADV") + F.col("VERB")).alias("tot"))
    return long.select(F.col("s.pos").alias("pos"), F.col("s.n").cast("bigint").alias("replaced"),
                       F.round(F.try_divide(F.col("s.n").cast("double"), F.col("tot").cast("double")), 6).alias("share"))


_DESC_COLS = [*_STAT_COLS, "replace_ratio_actual"]


@register("augment_summary", S.describe_sql(DOCS, _DESC_COLS, ddof=1))
def augment_summary(spark, sf_dir):
    """describe() over the numeric augmentation statistics (labelled rows)."""
    return PR.describe(augmented(spark, sf_dir), _DESC_COLS, ddof=1)


_UNION = f"""SELECT doc_id * 2 AS row_id, false AS is_augmented, cleaned_text, highlights FROM ({Q.CORPUS})
UNION ALL SELECT doc_id * 2 + 1, true, cleaned_text, highlights FROM (
  SELECT doc_id, max(CASE WHEN field = 'article' THEN aug_text END) AS cleaned_text,
  max(CASE WHEN field = 'highlights' THEN aug_text END) AS highlights FROM ({DOCS}) GROUP BY doc_id)"""
registry.PRELUDE["train_rows"] = f"SELECT row_id AS doc_id, cleaned_text, highlights FROM ({_UNION}) WHERE (row_id // 2) % 10 < 8"


@register("augment_union", _UNION)
def augment_union(spark, sf_dir):
    """Originals plus augmented copies (row count x2), fresh row ids."""
    orig = TK.corpus(spark, sf_dir).select((F.col("doc_id") * 2).alias("row_id"), F.lit(False).alias("is_augmented"),
                                           "cleaned_text", "highlights")
    aug = augment_batch(spark, sf_dir).select((F.col("doc_id") * 2 + 1).alias("row_id"),
                                              F.lit(True).alias("is_augmented"), "cleaned_text", "highlights")
    return orig.unionByName(aug)


@register("pos_shift", f"""SELECT coalesce(b.tag, a.tag) AS tag, round(coalesce(b.share, 0), 6) AS before,
  round(coalesce(a.share, 0), 6) AS after, round(coalesce(a.share, 0) - coalesce(b.share, 0), 6) AS delta
FROM (SELECT * FROM ({CORPUS_SHARE}) WHERE phase = 'before') b
FULL OUTER JOIN (SELECT * FROM ({CORPUS_SHARE}) WHERE phase = 'after') a ON a.tag = b.tag""")
def pos_shift(spark, sf_dir):
    """before/after corpus POS shares outer-aligned, missing as 0."""
    s = AG.pos_shift(_corpus_share(spark, sf_dir, "before"), _corpus_share(spark, sf_dir, "after"))
    return s.select("tag", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


# ---- G4: cosine of summed word vectors before vs after ------------------------
TOKVEC = f"""SELECT l.token, e.embedding::DOUBLE[] AS vec FROM ({LEX}) l JOIN embeddings e ON e.vec_id = l.rank % (SELECT count(*) FROM embeddings)"""
_SIM_ROWS = f"""WITH tr AS ({TOKROWS}), tv AS ({TOKVEC}),
ph AS (SELECT doc_id, field, 'b' AS phase, token AS tok FROM tr UNION ALL SELECT doc_id, field, 'a', out_token FROM tr),
v AS (SELECT ph.doc_id, ph.field, ph.phase, unnest(tv.vec) AS x, generate_subscripts(tv.vec, 1) AS dim
  FROM ph JOIN tv ON tv.token = lower(ph.tok)),
s AS (SELECT doc_id, field, phase, dim, sum(x) AS x FROM v GROUP BY ALL),
j AS (SELECT b.doc_id, b.field, b.dim, b.x AS xb, a.x AS xa FROM s b JOIN s a USING (doc_id, field, dim)
  WHERE b.phase = 'b' AND a.phase = 'a')
SELECT doc_id, field, sum(xb * xa) AS dot, sum(xb * xb) AS nb, sum(xa * xa) AS na FROM j GROUP BY doc_id, field"""


@register("semantic_similarity", f"""SELECT d.doc_id, d.field,
  round(CASE WHEN r.nb > 0 AND r.na > 0 THEN r.dot / (sqrt(r.nb) * sqrt(r.na)) END, 6) AS semantic_similarity
FROM ({FIELDS}) d LEFT JOIN ({_SIM_ROWS}) r USING (doc_id, field)""")
def semantic_similarity(spark, sf_dir):
    """Cosine between the mean word vectors of the original and the augmented text
    (mean and sum have the same direction); NULL when no token has a vector."""
    from textlab.functions.text import pretokens
    from textlab.operators.vectors import HOT_VECTORS, token_cosine
    both = AG.with_picks(fields(spark, sf_dir), KEYS, "text", picks(spark, sf_dir)).select(*KEYS, pretokens("text").alias("tokens"), "out_tokens")
    frequent = lexicon(spark, sf_dir).where(F.col("rank") <= HOT_VECTORS)
    sims = token_cosine(both, KEYS, "tokens", "out_tokens", vectors(spark, sf_dir), frequent, "^[a-z]+$")
    return fields(spark, sf_dir).select(*KEYS).join(sims, KEYS, "left").select(
        *KEYS, F.round("cosine", 6).alias("semantic_similarity"))


def vectors(spark, sf_dir):
    """A vector for every word of the lexicon, written once."""
    return stage_table(spark, f"token_vectors:{sf_dir}", lambda: tables.token_vectors(spark, sf_dir, lexicon(spark, sf_dir)))
