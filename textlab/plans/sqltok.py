"""DuckDB SQL for the tokenizer oracles (Word and Char vocabularies, encodings, token stats)."""

from __future__ import annotations

from textlab.plans import sqlgen as S
from textlab.plans.registry import PRELUDE

PRELUDE.setdefault("train_rows", "")          # filled in by the augmentation queries
CORPUS = f"SELECT doc_id, split, cleaned_text, cleaned_highlights AS highlights FROM ({S.POST_FILTER})"
_LINE = (f"array_to_string(regexp_extract_all(coalesce(cleaned_text, '') || ' ' || coalesce(highlights, ''), "
         f"'{S.PRETOKEN}'), ' ')")
# the augmented train split (defined with the augmentation queries) and the trainers' words
TRAIN = "SELECT doc_id, cleaned_text, highlights FROM train_rows"
WORDS = (f"SELECT word FROM (SELECT unnest(string_split(line, ' ')) AS word FROM (SELECT {_LINE} AS line "
         f"FROM ({TRAIN}))) WHERE word <> ''")
SPECIALS = ("SELECT CAST(0 AS INT) AS id, '<pad>' AS piece, 0.0::DOUBLE AS score UNION ALL "
            "SELECT 1, '<unk>', 0.0 UNION ALL SELECT 2, '<s>', 0.0 UNION ALL SELECT 3, '</s>', 0.0")


def word_vocab(v: int) -> str:
    return f"""{SPECIALS} UNION ALL
SELECT CAST(rk + 3 AS INT) AS id, piece, round(ln(n / total), 6) AS score FROM (
  SELECT piece, n, row_number() OVER (ORDER BY n DESC, piece) AS rk
  FROM (SELECT '▁' || word AS piece, count(*) AS n FROM ({WORDS}) GROUP BY 1)) r,
  (SELECT count(*)::DOUBLE AS total FROM ({WORDS})) t
WHERE rk <= {v - 4}"""


def char_vocab(v: int, coverage: float = 1.0) -> str:
    chars = f"SELECT unnest(string_split('▁' || word, '')) AS ch FROM ({WORDS})"
    return f"""{SPECIALS} UNION ALL
SELECT CAST(rk + 3 AS INT) AS id, piece, round(ln(n / total), 6) AS score FROM (
  SELECT piece, n, row_number() OVER (ORDER BY n DESC, piece) AS rk,
    sum(n) OVER (ORDER BY n DESC, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT ch AS piece, count(*) AS n FROM ({chars}) WHERE ch <> '' GROUP BY 1)) r,
  (SELECT count(*)::DOUBLE AS total FROM ({chars}) WHERE ch <> '') t
WHERE rk <= {v - 4} AND coalesce(before, 0) < {coverage} * total"""


def vocab(kind: str, v: int) -> str:
    """The vocabulary as a named table of the finished SQL."""
    name = f"vocab_{kind}_{v}"
    PRELUDE.setdefault(name, word_vocab(v) if kind == "word" else char_vocab(v))
    return f"SELECT * FROM {name}"


def token_rows(kind: str, v: int, col: str, src: str = CORPUS) -> str:
    """``(doc_id, pos, id)`` rows for ``col`` of ``src`` encoded with the ``kind`` vocabulary."""
    if kind == "word":
        items = f"regexp_extract_all(coalesce({col}, ''), '[^{S.WS}]+')"
        key = "'▁' || t.w"
    else:
        norm = f"trim(regexp_replace(coalesce({col}, ''), '[{S.WS}]+', ' ', 'g'))"
        items = (f"CASE WHEN {norm} = '' THEN []::VARCHAR[] "
                 f"ELSE string_split('▁' || replace({norm}, ' ', '▁'), '') END")
        key = "t.w"
    return f"""SELECT t.doc_id, t.pos, CAST(coalesce(v.id, 1) AS INT) AS id FROM (
  SELECT doc_id, unnest(xs) AS w, generate_subscripts(xs, 1) AS pos FROM (SELECT doc_id, {items} AS xs FROM ({src}))
) t LEFT JOIN ({vocab(kind, v)}) v ON v.piece = {key}"""


def encoded_text(kind: str, v: int, col: str, src: str = CORPUS) -> str:
    """``(doc_id, n_tokens, ids)`` with ids as a space-joined string."""
    return f"""SELECT c.doc_id, CAST(count(e.id) AS BIGINT) AS n_tokens,
  coalesce(string_agg(CAST(e.id AS VARCHAR), ' ' ORDER BY e.pos), '') AS ids
FROM ({src}) c LEFT JOIN ({token_rows(kind, v, col, src)}) e USING (doc_id) GROUP BY c.doc_id"""


def encode_stats(kind: str, v: int, src: str = TRAIN) -> str:
    """Per row: token_article_len, article_unk, token_highlight_len, summary_unk (+ text columns)."""
    a = token_rows(kind, v, "cleaned_text", src)
    h = token_rows(kind, v, "highlights", src)
    return f"""SELECT c.doc_id, c.cleaned_text, c.highlights,
  CAST(coalesce(a.n, 0) AS BIGINT) AS token_article_len, CAST(coalesce(a.u, 0) AS BIGINT) AS article_unk,
  CAST(coalesce(h.n, 0) AS BIGINT) AS token_highlight_len, CAST(coalesce(h.u, 0) AS BIGINT) AS summary_unk
FROM ({src}) c
LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(id = 1) AS u FROM ({a}) GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(id = 1) AS u FROM ({h}) GROUP BY doc_id) h USING (doc_id)"""


def train_stats(kind: str, v: int) -> str:
    """``encode_stats`` of the augmented train split as a named table."""
    vocab(kind, v)
    PRELUDE.setdefault(f"train_stats_{kind}_{v}", encode_stats(kind, v))
    return f"SELECT * FROM train_stats_{kind}_{v}"


def threshold(kind: str, v: int) -> str:
    st = train_stats(kind, v)
    return (f"SELECT CAST(floor(quantile_cont(token_article_len::DOUBLE, 0.9)) AS BIGINT) AS p90, "
            f"CAST(floor(floor(quantile_cont(token_article_len::DOUBLE, 0.9)) * 1.1) AS BIGINT) AS threshold "
            f"FROM ({st})")


def filtered(kind: str, v: int) -> str:
    return f"SELECT s.*, t.p90, t.threshold FROM ({train_stats(kind, v)}) s, ({threshold(kind, v)}) t " \
           f"WHERE s.token_article_len <= t.threshold"
