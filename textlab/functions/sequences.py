"""Token-id sequence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
PAD_ID = 0
UNK_ID = 1
BOS_ID = 2
EOS_ID = 3
# ----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ids_wrap(ids) -> Column:
    """``[bos] + ids + [eos]``."""
    return F.concat(F.array(F.lit(BOS_ID)), _c(ids), F.array(F.lit(EOS_ID)))


def ids_strip_special(ids, drop=(PAD_ID, BOS_ID, EOS_ID)) -> Column:
    """Drop the listed ids (default pad/bos/eos; unk is kept)."""
    drop = [int(d) for d in drop]
    return F.filter(_c(ids), lambda v: ~v.isin(drop))


def ids_truncate(ids, n: int) -> Column:
    """Keep the first ``n`` ids."""
    return F.slice(_c(ids), 1, int(n))


def ids_count_value(ids, value: int = UNK_ID) -> Column:
    """Occurrences of ``value``."""
    return F.size(F.filter(_c(ids), lambda v: v == F.lit(int(value)))).cast("bigint")


def ids_to_text(ids) -> Column:
    """Sequence -> ``[a, b, c]`` text (the legacy CSV cell format)."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(ids), lambda v: v.cast("string")), ", "), F.lit("]"))


def text_to_ids(s) -> Column:
    """``[a, b, c]`` text -> ARRAY<INT>."""
    return F.from_json(_c(s), "array<int>")


def teacher_shift(ids):
    """(decoder input, target) = (all but last, all but first)."""
    c = _c(ids)
    n = F.size(c)
    return (F.slice(c, 1, F.greatest(n - 1, F.lit(0))),
            F.slice(c, 2, F.greatest(n - 1, F.lit(0))))
