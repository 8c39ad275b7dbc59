"""Length, word-count, ratio and pre-tokenization expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions.cleaning import WS

# --- fixed values -----------------------------------------------------------
# Word character class used on raw (possibly non-ASCII) text: letters, numbers, underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"
# Pre-tokenizer: a digit run, a word run, or one other non-space character.
PRETOKEN_RE = r"\p{Nd}+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + WS + "]"
# ----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def char_len(x) -> Column:
    """Length in code points (NULL -> 0)."""
    return F.coalesce(F.length(_c(x)), F.lit(0)).cast("bigint")


def word_len_ws(x) -> Column:
    """Number of whitespace-separated words. The visible ASCII characters come first in the class, so that most need one comparison."""
    return F.regexp_count(F.coalesce(_c(x), F.lit("")), F.lit(r"[\x21-\x7e[^" + WS + "]]+")).cast("bigint")


def word_len_re(x) -> Column:
    """Number of ``\\w+`` runs."""
    return F.regexp_count(F.coalesce(_c(x), F.lit("")), F.lit(WORD_CLASS + "+")).cast("bigint")


def len_ratio(num, den) -> Column:
    """``num / den`` as DOUBLE, NULL when ``den`` is 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pretokens(x) -> Column:
    """Array of pre-tokens (digit runs, word runs, single other characters)."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(PRETOKEN_RE), 0)


def pretokenize(x) -> Column:
    """Pre-tokens joined by single spaces."""
    return F.array_join(pretokens(x), " ")


def concat_fields(a, b) -> Column:
    """``str(a) + ' ' + str(b)`` with NULL as empty text."""
    return F.concat_ws(" ", F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit("")))


def count_pattern(x, pattern: str) -> Column:
    """Non-overlapping matches of ``pattern``."""
    return F.regexp_count(F.coalesce(_c(x), F.lit("")), F.lit(pattern)).cast("bigint")


def ws_words(x) -> Column:
    """Whitespace-separated words as an array (no empty items)."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit("[^" + WS + "]+"), 0)
