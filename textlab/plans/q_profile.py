"""Registered queries: EP1 filters and corpus profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions.cleaning import IMPACT_PATTERNS
from textlab.operators import filters as FL
from textlab.operators import profile as PR
from textlab.plans import preprocess as P
from textlab.plans import sqlgen as S
from textlab.plans.registry import register

_PRE = (f"SELECT 'pre' AS phase, length(article) AS char_len, length(highlights) AS highlight_len, "
        f"length(highlights)::DOUBLE / nullif(length(article), 0) AS highlight_ratio FROM ({S.RAW_PAIRS})")
_POST = f"SELECT 'post' AS phase, char_len, highlight_len, highlight_ratio FROM ({S.POST_FILTER})"
_PHASES = f"{_PRE} UNION ALL {_POST}"


@register("describe_lengths", S.describe_sql(_PHASES, P.LENGTH_COLS, group="phase", ddof=1))
def describe_lengths(spark, sf_dir):
    """A1: describe() of lengths and ratio, raw vs cleaned+filtered."""
    return PR.describe(P.length_phases(spark, sf_dir), P.LENGTH_COLS, group_cols=["phase"], ddof=1)


@register("filter_len_ratio",
          f"SELECT doc_id, cleaned_text, cleaned_highlights AS highlights, CAST(char_len AS BIGINT) AS char_len, "
          f"CAST(highlight_len AS BIGINT) AS highlight_len, round(highlight_ratio, 6) AS highlight_ratio "
          f"FROM ({S.POST_FILTER})")
def filter_len_ratio(spark, sf_dir):
    """F1: keep cleaned pairs with length > 250 and 0.05 <= ratio <= 0.5."""
    f = P.post_filter(spark, sf_dir)
    return f.select("doc_id", "cleaned_text", F.col("cleaned_highlights").alias("highlights"),
                    "char_len", "highlight_len", F.round("highlight_ratio", 6).alias("highlight_ratio"))


_VAL_WORDS = f"""SELECT doc_id, cleaned_text, highlights,
  CAST(len(regexp_extract_all(cleaned_text, '[^{S.WS}]+')) AS BIGINT) AS char_len,
  CAST(len(regexp_extract_all(highlights, '[^{S.WS}]+')) AS BIGINT) AS highlight_len
FROM ({S.CLEANED_PAIRS})"""


@register("filter_val_words",
          f"""SELECT doc_id, cleaned_text, highlights, char_len, highlight_len,
  round(highlight_len::DOUBLE / nullif(char_len, 0), 6) AS highlight_ratio FROM ({_VAL_WORDS})
WHERE char_len > 250 AND coalesce(highlight_len::DOUBLE / nullif(char_len, 0) >= 0.05, false)
  AND coalesce(highlight_len::DOUBLE / nullif(char_len, 0) <= 0.5, false)""")
def filter_val_words(spark, sf_dir):
    """validation-style filter: lengths in words, highlights not cleaned (same thresholds)."""
    c = FL.with_pair_lengths(P.cleaned_pairs(spark, sf_dir), "cleaned_text", "highlights", unit="word")
    return FL.filter_len_ratio(c).select("doc_id", "cleaned_text", "highlights", "char_len", "highlight_len",
                                         F.round("highlight_ratio", 6).alias("highlight_ratio"))


_RATIO = "length(cleaned_highlights)::DOUBLE / nullif(length(cleaned_text), 0)"


@register("filter_violations", f"""SELECT CAST(count(*) AS BIGINT) AS original_samples,
  CAST(count_if(NOT coalesce(length(cleaned_text) > 250, false)) AS BIGINT) AS removed_short,
  CAST(count_if(NOT coalesce({_RATIO} >= 0.05, false)) AS BIGINT) AS removed_ratio_low,
  CAST(count_if(NOT coalesce({_RATIO} <= 0.5, false)) AS BIGINT) AS removed_ratio_high,
  CAST(count_if(coalesce(length(cleaned_text) > 250 AND {_RATIO} >= 0.05 AND {_RATIO} <= 0.5, false)) AS BIGINT) AS remaining,
  CAST(count_if(NOT coalesce(length(cleaned_text) > 250 AND {_RATIO} >= 0.05 AND {_RATIO} <= 0.5, false)) AS BIGINT) AS total_removed
FROM ({S.CLEANED_PAIRS})""")
def filter_violations(spark, sf_dir):
    """overlapping per-rule violation counts, remaining and removed."""
    c = FL.with_pair_lengths(P.cleaned_pairs(spark, sf_dir), "cleaned_text", "cleaned_highlights")
    return FL.filter_violations(c)


@register("char_freq", f"""SELECT ch, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(string_split(cleaned_text, '')) AS ch FROM ({S.POST_FILTER})) WHERE ch <> '' GROUP BY ch""")
def char_freq(spark, sf_dir):
    """A3: character histogram of the cleaned, filtered articles."""
    return PR.char_freq(P.post_filter(spark, sf_dir), "cleaned_text")


@register("char_top20", f"""WITH f AS (SELECT ch, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(string_split(cleaned_text, '')) AS ch FROM ({S.POST_FILTER})) WHERE ch <> '' GROUP BY ch)
SELECT ch, n, (SELECT CAST(count(*) AS BIGINT) FROM f) AS unique_chars FROM f ORDER BY n DESC, ch LIMIT 20""")
def char_top20(spark, sf_dir):
    """Distinct characters and the 20 most frequent."""
    return PR.char_top(P.post_filter(spark, sf_dir), "cleaned_text", 20)


@register("topk_chars", f"""WITH f AS (SELECT ch, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)
SELECT ch, n, (SELECT CAST(count(*) AS BIGINT) FROM f) AS unique_chars FROM f ORDER BY n DESC, ch LIMIT 20""")
def topk_chars(spark, sf_dir):
    """Top-20 characters of the raw documents (sort desc + limit as TakeOrderedAndProject)."""
    from textlab.sources import tables
    return PR.char_top(tables.load(spark, sf_dir, "documents"), "text", 20)


@register("cleaning_impact", f"""SELECT CAST(sum(length(article)) AS BIGINT) AS total_raw_chars,
  CAST(sum(length(cleaned_text)) AS BIGINT) AS total_cleaned_chars,
  CAST(sum(length(article)) - sum(length(cleaned_text)) AS BIGINT) AS chars_removed,
  round(100.0 * (sum(length(article)) - sum(length(cleaned_text))) / sum(length(article))::DOUBLE, 6) AS pct_removed
FROM ({S.POST_FILTER})""")
def cleaning_impact(spark, sf_dir):
    """A5: raw vs cleaned character totals of the kept articles."""
    return PR.cleaning_impact(P.post_filter(spark, sf_dir), "article", "cleaned_text")


_PAT_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, CAST(sum(len(regexp_extract_all(coalesce(article, ''), '{p}'))) AS BIGINT) AS before, "
    f"CAST(sum(len(regexp_extract_all(coalesce(cleaned_text, ''), '{p}'))) AS BIGINT) AS after FROM ({S.POST_FILTER})"
    for n, p in IMPACT_PATTERNS.items())


@register("pattern_impact", f"SELECT pattern, before, after, CAST(before - after AS BIGINT) AS removed FROM ({_PAT_ROWS})")
def pattern_impact(spark, sf_dir):
    """Per-pattern occurrences removed by cleaning."""
    return PR.pattern_impact(P.post_filter(spark, sf_dir), "article", "cleaned_text", IMPACT_PATTERNS)


@register("fold_impact", f"""SELECT split, field, CAST(sum(removed) AS BIGINT) AS total_removed,
  CAST(sum(raw) AS BIGINT) AS raw_chars, round(100.0 * sum(removed) / sum(raw)::DOUBLE, 6) AS percent FROM (
  SELECT split, 'article' AS field, removed_chars AS removed, length(article) AS raw FROM ({S.CLEANED_PAIRS})
  UNION ALL
  SELECT split, 'highlights' AS field, removed_chars_hl AS removed, length(highlights) AS raw FROM ({S.CLEANED_PAIRS})
) GROUP BY split, field""")
def fold_impact(spark, sf_dir):
    """Characters lost to folding/filtering per split and field (all rows, before the filter)."""
    c = P.cleaned_pairs(spark, sf_dir)
    # one pass: both fields of a row become two rows (no second scan / second cleaning)
    long = c.select("split", F.explode(F.array(
        F.struct(F.lit("article").alias("field"), F.col("removed_chars").alias("removed"),
                 F.col("article").alias("raw")),
        F.struct(F.lit("highlights").alias("field"), F.col("removed_chars_hl").alias("removed"),
                 F.col("highlights").alias("raw")))).alias("s")).select("split", "s.*")
    return PR.fold_impact(long, "removed", "raw", ["split", "field"])


def _hist_sql(src: str, col: str, bins: int, group: str | None = None, shared: bool = False) -> str:
    g = f"{group}, " if group else ""
    nn = f"WHERE {col} IS NOT NULL"
    mm = f"min({col}::DOUBLE) AS lo, max({col}::DOUBLE) AS hi"
    if group and shared:
        rng = (f"(SELECT p.{group}, r0.lo, r0.hi FROM (SELECT DISTINCT {group} FROM ({src}) {nn}) p, "
               f"(SELECT {mm} FROM ({src}) {nn}) r0)")
    elif group:
        rng = f"(SELECT {group}, {mm} FROM ({src}) {nn} GROUP BY {group})"
    else:
        rng = f"(SELECT {mm} FROM ({src}) {nn})"
    join = f"JOIN r USING ({group})" if group else ", r"
    gj = f"USING ({group}, bin)" if group else "USING (bin)"
    return f"""WITH r AS {rng},
grid AS (SELECT r.*, CAST(b.range AS INT) AS bin FROM r, range({bins}) b),
t AS (SELECT {g}CAST(least(greatest(CASE WHEN r.hi = r.lo THEN 0 ELSE floor({float(bins)} * ({col}::DOUBLE - r.lo) / (r.hi - r.lo)) END, 0), {bins - 1}) AS INT) AS bin
      FROM ({src}) s {join} {nn.replace("WHERE ", "WHERE s.")}),
c AS (SELECT {g}bin, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY {g}bin)
SELECT {g}bin, round(lo + bin * ((hi - lo) / {float(bins)}), 6) AS lo,
  round(CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {float(bins)}) END, 6) AS hi,
  CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN c {gj}"""


@register("histogram50", _hist_sql(f"SELECT length(article) AS char_len FROM ({S.RAW_PAIRS})", "char_len", 50))
def histogram50(spark, sf_dir):
    """50-bin equal-width histogram of raw article lengths."""
    p = P.raw_pairs(spark, sf_dir).select(F.length("article").alias("char_len"))
    return PR.histogram(p, "char_len", 50)


@register("histogram_shared", _hist_sql(f"SELECT phase, char_len FROM ({_PHASES})", "char_len", 50,
                                       group="phase", shared=True))
def histogram_shared(spark, sf_dir):
    """Raw and cleaned+filtered article lengths on shared ``linspace(min, max, 51)`` edges."""
    return PR.histogram_shared(P.length_phases(spark, sf_dir), "char_len", "phase", 50)


@register("split_union", f"""SELECT split, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(length(cleaned_text)) AS BIGINT) AS cleaned_chars, CAST(sum(removed_chars) AS BIGINT) AS removed_chars
FROM ({S.CLEANED_PAIRS}) GROUP BY split""")
def split_union(spark, sf_dir):
    """One cleaning pass over the tagged union of train/validation/test."""
    c = P.cleaned_pairs(spark, sf_dir)
    return c.groupBy("split").agg(F.count("*").alias("n_rows"),
                                  F.sum(F.length("cleaned_text")).cast("bigint").alias("cleaned_chars"),
                                  F.sum("removed_chars").cast("bigint").alias("removed_chars"))


_FIRST = f"""CASE WHEN NOT coalesce(length(cleaned_text) > 250, false) THEN 'short'
  WHEN NOT coalesce({_RATIO} >= 0.05, false) THEN 'ratio_low'
  WHEN NOT coalesce({_RATIO} <= 0.5, false) THEN 'ratio_high' END"""


@register("filter_first_reason", f"""SELECT coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {_FIRST} AS reason FROM ({S.CLEANED_PAIRS})) GROUP BY 1""")
def filter_first_reason(spark, sf_dir):
    """F3 (quirk Q6): disjoint breakdown by the first failing rule (rows kept as 'kept')."""
    c = FL.with_pair_lengths(P.cleaned_pairs(spark, sf_dir), "cleaned_text", "cleaned_highlights")
    return c.groupBy(F.coalesce(FL.first_violation(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
