"""Prediction/reference scoring.

ROUGE-N is fully relational: both sides' n-grams are exploded together,
counted per (pair, gram) with partial aggregation, and a second aggregation
per pair yields the clipped overlap (no join). ROUGE-L (LCS) and METEOR (alignment) are per-pair dynamic
programs, run as Arrow-batched pandas UDFs on the two token arrays of a row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.stem import stem
from textlab.sources.tables import DEFAULT_POS, POS_BY_LEN_MOD6

# --- fixed values -----------------------------------------------------------
ROUGE_TOKEN_RE = "[^a-z0-9]+"
STEM_MIN_LEN = 4          # only tokens longer than 3 characters are stemmed
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5
# ----------------------------------------------------------------------------

STR_ARR = T.ArrayType(T.StringType())


def rouge_tokens(x) -> Column:
    """Lower-case, non-alphanumerics as separators, split (no empty items)."""
    c = F.col(x) if isinstance(x, str) else x
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), ROUGE_TOKEN_RE, " "))
    return F.filter(F.split(s, " "), lambda t: t != "")


@F.pandas_udf(STR_ARR)
def stem_tokens(s: pd.Series) -> pd.Series:
    """E3 per row: Porter stems for tokens longer than 3 characters (memoized per executor)."""
    return s.map(lambda ts: [stem(t) if len(t) >= STEM_MIN_LEN else t for t in ts] if ts is not None else [])


@F.pandas_udf(T.StringType())
def _stem_one(s: pd.Series) -> pd.Series:
    return s.map(lambda t: stem(t) if t is not None and len(t) >= STEM_MIN_LEN else t)


def stem_table(tokens: DataFrame, col: str = "token") -> DataFrame:
    """``(token, stem)`` for every distinct token, each stemmed once."""
    d = tokens.select(col).distinct()
    return d.select(F.col(col).alias("token"), _stem_one(F.col(col)).alias("stem"))


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    k = F.size(tokens) - n
    return F.when(k >= 0, F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(0))),
                                      lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def _fmeasure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_n(df: DataFrame, keys, pred_tokens: str, ref_tokens: str, n: int, prefix: str | None = None) -> DataFrame:
    """ROUGE-N precision, recall and F1 per pair (clipped n-gram overlap).

    One pass, no join: both sides' n-grams are exploded together with a side
    flag, counted per (pair, gram) with partial aggregation, and a second
    aggregation per pair gives the clipped overlap and both totals. Pairs
    without any n-gram survive through ``explode_outer`` and score 0.
    """
    k = list(keys)
    pre = prefix or f"rouge{n}"
    tagged = F.concat(F.transform(ngrams(F.col(pred_tokens), n), lambda g: F.struct(F.lit(True).alias("p"), g.alias("g"))),
                      F.transform(ngrams(F.col(ref_tokens), n), lambda g: F.struct(F.lit(False).alias("p"), g.alias("g"))))
    ex = df.select(*k, F.explode_outer(tagged).alias("__t"))
    per_gram = ex.groupBy(*k, F.col("__t.g").alias("__g")).agg(
        F.count_if(F.col("__t.p")).alias("__cp"), F.count_if(~F.col("__t.p")).alias("__cr"))
    per_pair = per_gram.groupBy(*k).agg(F.sum(F.least("__cp", "__cr")).alias("__ov"),
                                        F.sum("__cp").alias("__np"), F.sum("__cr").alias("__nr"))
    p = F.col("__ov") / F.greatest(F.col("__np"), F.lit(1)).cast("double")
    r = F.col("__ov") / F.greatest(F.col("__nr"), F.lit(1)).cast("double")
    j = per_pair.select(*k, p.alias(f"{pre}_p"), r.alias(f"{pre}_r"))
    return j.withColumn(f"{pre}_f", _fmeasure(F.col(f"{pre}_p"), F.col(f"{pre}_r")))


def lcs_length(a, b) -> int:
    """LCS length, bit-parallel over ``b`` (one big-integer update per item of ``a``)."""
    if not a or not b:
        return 0
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


_PRF = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()),
                     T.StructField("f", T.DoubleType())])


@F.pandas_udf(_PRF)
def _rouge_l(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    ps, rs, fs = [], [], []
    for a, b in zip(pred, ref):
        a = list(a) if a is not None else []
        b = list(b) if b is not None else []
        if not a or not b:
            ps.append(0.0), rs.append(0.0), fs.append(0.0)
            continue
        m = lcs_length(a, b)
        p, r = m / len(a), m / len(b)
        ps.append(p), rs.append(r), fs.append(2 * p * r / (p + r) if p + r > 0 else 0.0)
    return pd.DataFrame({"p": ps, "r": rs, "f": fs})


def rouge_l(df: DataFrame, keys, pred_tokens: str, ref_tokens: str) -> DataFrame:
    """ROUGE-L precision, recall, F1 from the LCS of the two token arrays."""
    s = _rouge_l(F.col(pred_tokens), F.col(ref_tokens))
    return df.select(*keys, s.alias("__s")).select(
        *keys, F.col("__s.p").alias("rougeL_p"), F.col("__s.r").alias("rougeL_r"), F.col("__s.f").alias("rougeL_f"))


def same_synonym_group(a: str, b: str) -> bool:
    """Whether the lexicon counts two words as synonyms: POS and first letter agree (POS goes by word length)."""
    def pos(w):
        return POS_BY_LEN_MOD6.get(len(w) % 6, DEFAULT_POS)
    return a != b and a[:1] == b[:1] and pos(a) == pos(b) and all(w.isascii() and w.isalpha() for w in (a, b))


def meteor_one(hyp, ref, synonyms=None, alpha=METEOR_ALPHA, beta=METEOR_BETA,
               gamma=METEOR_GAMMA) -> float:
    """Unigram METEOR: exact, then stem, then synonym matching; fragmentation penalty."""
    hyp = [h.lower() for h in hyp]
    ref = [r.lower() for r in ref]
    if not hyp or not ref:
        return 0.0
    h_left = list(range(len(hyp)))
    r_left = list(range(len(ref)))
    matches = []

    def stage(same):
        nonlocal h_left, r_left
        used_h, used_r = set(), set()
        for i in h_left:
            for j in r_left:
                if j in used_r:
                    continue
                if same(hyp[i], ref[j]):
                    matches.append((i, j))
                    used_h.add(i)
                    used_r.add(j)
                    break
        h_left = [i for i in h_left if i not in used_h]
        r_left = [j for j in r_left if j not in used_r]

    stage(lambda a, b: a == b)
    stage(lambda a, b: stem(a) == stem(b))
    if synonyms:
        stage(synonyms)
    m = len(matches)
    if m == 0:
        return 0.0
    matches.sort()
    chunks = 1
    for (i0, j0), (i1, j1) in zip(matches, matches[1:]):
        if not (i1 == i0 + 1 and j1 == j0 + 1):
            chunks += 1
    p, r = m / len(hyp), m / len(ref)
    fmean = p * r / (alpha * p + (1 - alpha) * r)
    penalty = gamma * (chunks / m) ** beta
    return fmean * (1 - penalty)


def meteor_udf(synonyms=None):
    """``synonyms``: a test of two lower-case words."""
    @F.pandas_udf(T.DoubleType())
    def score(pred: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([meteor_one(list(a) if a is not None else [], list(b) if b is not None else [], synonyms)
                          for a, b in zip(pred, ref)])
    return score


def whitespace_tokens(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), " "),
                    lambda t: t != "")
