"""Text cleaning as Spark Column expressions.

Every step is a built-in ``regexp_replace`` / ``translate`` except the
Unicode compatibility fold, which Spark has no native function for and runs
as an Arrow-batched pandas UDF fed only the rows that contain non-ASCII
characters.

The patterns are Java regexes chosen to behave like Python's ``re`` on
``str`` (Unicode ``\\s``, ``.`` stopping only at ``\\n``).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Python's Unicode whitespace set, written as a Java character class body.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Whitespace that can survive the ASCII fold.
ASCII_WS = r"\t-\r\x1c-\x20"
# Characters kept after folding: ASCII letters, digits, whitespace, punctuation.
ALLOWED_ASCII = r"\t-\r\x1c-\x7e"
# Curly quotes mapped to straight ones (the opening single quote is not mapped).
QUOTE_FROM = "“”’"
QUOTE_TO = '""\''
# Patterns whose before/after counts are reported by the cleaning profile.
IMPACT_PATTERNS = {
    "double_hyphen": r"--",
    "cnn_marker": r"\(CNN\)",
    "published": r"PUBLISHED:",
    "curly_quotes": "[“”‘’]",
}
_W = "[" + WS + "]"
# Spaces around punctuation and runs of full stops.
PUNCT_RULES = [
    (_W + "+([.,;!?])", "$1"),
    (r"\(" + _W + "+", "("),
    (_W + r"+\)", ")"),
    (r"\.{2,}", "."),
]
BYLINE_RE = r"(?d)^By" + _W + r"+\." + _W + r"+.*?\." + _W + "+"
DATELINE_RE = (
    r"(?d)^(?:By" + _W + r"*\." + _W + r"*.*?\." + _W + r"*)?"
    r"PUBLISHED:" + _W + r"*\." + _W + r"*.*?\." + _W + r"*"
    r"(?:\|" + _W + r"*\." + _W + r"*)?"
    r"UPDATED:" + _W + r"*\." + _W + r"*.*?\." + _W + "*"
)
WIRE_RE = r"\(CNN\)" + _W + "+--" + _W + "+"
NON_ASCII_RE = r"[^\x00-\x7F]"
# ----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_byline(x) -> Column:
    """Drop a leading ``By . <name> . `` header."""
    return F.regexp_replace(_c(x), BYLINE_RE, "")


def strip_dateline(x) -> Column:
    """Drop an anchored ``PUBLISHED: . … UPDATED: . … .`` header, then left-trim."""
    y = F.regexp_replace(_c(x), DATELINE_RE, "")
    return F.regexp_replace(y, "^" + _W + "+", "")


def strip_wire_marker(x) -> Column:
    """Delete ``(CNN) -- `` everywhere, then ``--`` -> ``-``."""
    return F.replace(F.regexp_replace(_c(x), WIRE_RE, ""), F.lit("--"), F.lit("-"))


def _nfkd_ascii(s: str | None) -> str | None:
    if s is None:
        return None
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(T.StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(_nfkd_ascii, na_action="ignore")


def ascii_fold(x) -> Column:
    """T4: NFKD-decompose and drop non-ASCII code points.

    The UDF receives NULL for pure-ASCII rows (the common case), so only text
    that needs folding crosses into Python.
    """
    c = _c(x)
    return F.coalesce(_fold_udf(F.when(c.rlike(NON_ASCII_RE), c)), c)


def drop_disallowed(x, folded: bool = False) -> Column:
    """T5: delete characters outside ASCII letters/digits/punctuation and (any) whitespace. ``folded``: the text
    is ASCII already, for which a narrower pattern does the same."""
    return F.regexp_replace(_c(x), "[^" + ALLOWED_ASCII + ("" if folded else WS) + "]", "")


def squeeze_ws(x) -> Column:
    """Collapse whitespace runs to one space and trim (input is ASCII)."""
    return F.trim(F.regexp_replace(_c(x), "[" + ASCII_WS + "]+", " "))


def squeeze_ws_unicode(x) -> Column:
    """T6 on raw text: Unicode whitespace runs to one space, trimmed."""
    y = F.regexp_replace(_c(x), _W + "+", " ")
    return F.regexp_replace(y, "^ | $", "")


def fix_punct(x, squeezed: bool = False) -> Column:
    """No space before ``.,;!?`` or ``)``, none after ``(``, ``..+`` -> ``.``. ``squeezed``: all whitespace of the text is single
    spaces."""
    y = _c(x)
    for pattern, replacement in PUNCT_RULES:
        y = F.regexp_replace(y, pattern.replace(_W + "+", " ") if squeezed else pattern, replacement)
    return y


def straight_quotes(x) -> Column:
    """Curly double quotes and the right single quote to ASCII."""
    return F.translate(_c(x), QUOTE_FROM, QUOTE_TO)


def newline_to_space(x) -> Column:
    """Newline -> space."""
    return F.translate(_c(x), "\n", " ")


def clean_text_columns(df, src: str, out: str = "cleaned_text", removed: str | None = "removed_chars"):
    """Apply T9 to ``src`` producing ``out`` (and T10 as ``removed``).

    Implemented as a short chain of ``withColumn`` steps so the
    pre-fold text is computed once and reused for the removed-char count.
    """
    pre = "__pre_fold"
    ascii_ = "__ascii"
    c = F.coalesce(F.col(src), F.lit(""))
    df = df.withColumn(pre, strip_wire_marker(strip_dateline(strip_byline(c))))
    df = df.withColumn(ascii_, drop_disallowed(ascii_fold(pre), folded=True))
    df = df.withColumn(out, straight_quotes(fix_punct(squeeze_ws(ascii_), squeezed=True)))
    if removed:
        df = df.withColumn(removed, F.length(pre) - F.length(ascii_))
    return df.drop(pre, ascii_)


def clean_text(x) -> Column:
    """T9 as a single Column expression (no removed-char count)."""
    c = F.coalesce(_c(x), F.lit(""))
    y = strip_wire_marker(strip_dateline(strip_byline(c)))
    y = drop_disallowed(ascii_fold(y), folded=True)
    return straight_quotes(fix_punct(squeeze_ws(y), squeezed=True))
