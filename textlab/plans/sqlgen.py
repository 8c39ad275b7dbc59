"""DuckDB SQL fragments for the oracle queries (same fixtures, independent engine)."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# ----------------------------------------------------------------------------
W = "[" + WS + "]"

NOISY_ARTICLE = """CASE CAST(doc_id % 8 AS INT)
 WHEN 0 THEN concat('By . Jane Doe . ', text)
 WHEN 1 THEN concat('(CNN) -- ', text)
 WHEN 2 THEN concat('By . Jane Doe . PUBLISHED: . 05:00 EST, 1 May 2012 . | . UPDATED: . 06:00 EST, 1 May 2012 . ', text)
 WHEN 3 THEN replace(text, ', ', ' -- ')
 WHEN 4 THEN concat('“', replace(text, '. ', ' ... '), '”')
 WHEN 5 THEN replace(text, ' the ', ' ( the ) ')
 WHEN 6 THEN replace(text, 'and', 'don’t')
 ELSE text END"""

SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END"

NOISY = f"SELECT doc_id, {NOISY_ARTICLE} AS article FROM documents"

RAW_PAIRS = (f"SELECT doc_id, {SPLIT} AS split, {NOISY_ARTICLE} AS article, "
             f"replace(string_split(coalesce(text, ''), chr(10))[1], chr(10), ' ') AS highlights FROM documents")


def strip_byline(x: str) -> str:
    return f"regexp_replace({x}, '^By{W}+\\.{W}+.*?\\.{W}+', '')"


def strip_dateline(x: str) -> str:
    pat = (f"^(?:By{W}*\\.{W}*.*?\\.{W}*)?PUBLISHED:{W}*\\.{W}*.*?\\.{W}*"
           f"(?:\\|{W}*\\.{W}*)?UPDATED:{W}*\\.{W}*.*?\\.{W}*")
    return f"regexp_replace(regexp_replace({x}, '{pat}', ''), '^{W}+', '')"


def strip_wire(x: str) -> str:
    return f"replace(regexp_replace({x}, '\\(CNN\\){W}+--{W}+', '', 'g'), '--', '-')"


def ascii_fold(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


def drop_disallowed(x: str) -> str:
    return f"regexp_replace({x}, '[^\\t-\\r\\x1c-\\x7e]', '', 'g')"


def squeeze_ascii(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\t-\\r\\x1c-\\x20]+', ' ', 'g'))"


def squeeze_unicode(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def fix_punct(x: str) -> str:
    y = f"regexp_replace({x}, ' +([.,;!?])', '\\1', 'g')"
    y = f"regexp_replace({y}, '\\( +', '(', 'g')"
    y = f"regexp_replace({y}, ' +\\)', ')', 'g')"
    return f"regexp_replace({y}, '\\.{{2,}}', '.', 'g')"


def straight_quotes(x: str) -> str:
    return f"replace(replace(replace({x}, '“', '\"'), '”', '\"'), '’', '''')"


def pre_fold(x: str) -> str:
    return strip_wire(strip_dateline(strip_byline(f"coalesce({x}, '')")))


def clean(x: str) -> str:
    """Full T9 chain on a SQL expression."""
    return straight_quotes(fix_punct(squeeze_ascii(drop_disallowed(ascii_fold(pre_fold(x))))))


def removed(x: str) -> str:
    """T10 on a SQL expression."""
    p = pre_fold(x)
    return f"CAST(length({p}) - length({drop_disallowed(ascii_fold(p))}) AS BIGINT)"


CLEANED_PAIRS = f"""SELECT doc_id, split, article, highlights,
  {clean('article')} AS cleaned_text, {removed('article')} AS removed_chars,
  {clean('highlights')} AS cleaned_highlights, {removed('highlights')} AS removed_chars_hl
FROM ({RAW_PAIRS})"""

POST_FILTER = f"""SELECT *, length(cleaned_text) AS char_len, length(cleaned_highlights) AS highlight_len,
  length(cleaned_highlights)::DOUBLE / nullif(length(cleaned_text), 0) AS highlight_ratio
FROM ({CLEANED_PAIRS})
WHERE length(cleaned_text) > 250
  AND coalesce(length(cleaned_highlights)::DOUBLE / nullif(length(cleaned_text), 0) >= 0.05, false)
  AND coalesce(length(cleaned_highlights)::DOUBLE / nullif(length(cleaned_text), 0) <= 0.5, false)"""

PRETOKEN = f"\\p{{Nd}}+|[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WS}]"


def describe_sql(src: str, cols, group: str | None = None, ddof: int = 1, probs=(0.25, 0.5, 0.75)) -> str:
    """Long-format describe over ``src`` (a subquery) grouped by ``group``."""
    std = "stddev_samp" if ddof == 1 else "stddev_pop"
    parts = []
    for c in cols:
        g_sel = f"{group}, " if group else ""
        g_by = f"GROUP BY {group}" if group else ""
        qs = ", ".join(f"round(quantile_cont({c}::DOUBLE, {p}), 6) AS p{int(round(p * 100))}" for p in probs)
        parts.append(
            f"SELECT {g_sel}'{c}' AS column, CAST(count({c}) AS BIGINT) AS count, "
            f"round(avg({c}::DOUBLE), 6) AS mean, round({std}({c}::DOUBLE), 6) AS std, "
            f"round(min({c}::DOUBLE), 6) AS min, {qs}, round(max({c}::DOUBLE), 6) AS max "
            f"FROM ({src}) {g_by}")
    return "\nUNION ALL\n".join(parts)
