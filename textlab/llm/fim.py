"""Fill-in-middle: a text is cut at two unit boundaries and its parts are put in another order.

The boundaries of a text's units are byte offsets, held as a set in containers of 65,536 offsets
each: an array of the low 16 bits where they are few, a bitmap where they are many, runs
where they are consecutive (a stretch of ASCII is one run). The cumulative cardinalities of the
containers find the one that holds the k-th boundary; a select inside it gives the byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.kernels import text_buffer
from textlab.session import ship_package

CHUNK = 1 << 16                 # offsets of a container
OUT_BYTES = 1 << 22             # text of an Arrow batch that goes back
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Array:
    def __init__(self, present):
        self.values = np.flatnonzero(present).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class _Bitmap:
    def __init__(self, present):
        self.words = np.packbits(present, bitorder="little")
        per_word = np.add.reduceat(present, np.arange(0, present.size, 64), dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(per_word)])

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.words[8 * w:8 * w + 8], bitorder="little")
        return 64 * w + int(np.flatnonzero(bits)[k - self.before[w]])


class _Runs:
    def __init__(self, first, last):
        self.first = first.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(last - first + 1)])

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[r]) + k - int(self.before[r])


def _container(present: np.ndarray, card: int):
    """The smallest of the three forms (bytes: 2 a value, 8,192 a bitmap, 4 a run)."""
    edge = np.diff(present.view(np.int8), prepend=0, append=0)
    first = np.flatnonzero(edge == 1)
    if 4 * first.size <= min(2 * card, CHUNK // 8):
        return _Runs(first, np.flatnonzero(edge == -1) - 1)
    return _Array(present) if 2 * card <= CHUNK // 8 else _Bitmap(present)


class BoundarySet:
    """A sorted set of offsets below ``present.size``; ``select(k)`` is its k-th member, from 0."""

    def __init__(self, present: np.ndarray):
        self.keys, self.containers, cards = [], [], []
        for at in range(0, present.size, CHUNK):
            part = present[at:at + CHUNK]
            card = int(np.count_nonzero(part))
            if card:
                self.keys.append(at)
                self.containers.append(_container(part, card))
                cards.append(card)
        self.before = np.concatenate([[0], np.cumsum(cards)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.keys[c] + self.containers[c].select(k - int(self.before[c]))


def starts(data: np.ndarray, unit: str = "char") -> np.ndarray:
    """Which of the offsets 0 to ``data.size`` of a UTF-8 text bound units: its ends, and every code point
    (``char``), the start of every word but the first (``word``), the byte behind every line feed (``line``)."""
    out = np.ones(data.size + 1, bool)
    if unit == "char":
        out[:-1] = (data & 0xC0) != 0x80
    elif unit == "word":
        solid = ~_SPACE[data]
        head = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        out[1:-1] = False
        out[head[head > (int(np.argmax(solid)) if solid.any() else 0)]] = True
    elif unit == "line":
        out[1:-1] = data[:-1] == 0x0A
    else:
        raise ValueError(f"unit must be one of {UNITS}")
    out[0] = True
    return out


_OUT = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                  ("output", pa.string())])


def _cut(unit, sentinels, plain_from, spm_below):
    marks = [s.encode() for s in sentinels]
    p, s, m = marks

    def one(data: np.ndarray, h):
        raw = data.tobytes()
        present = starts(data, unit)
        n = int(np.count_nonzero(present)) - 1
        if not raw or h[2] % 100 >= plain_from or any(x in raw for x in marks):
            return n, "plain", None, None, raw
        bounds = BoundarySet(present)
        x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = bounds.select(x), bounds.select(y)
        if unit == "char":
            pc, mc = x, y - x
        else:
            pc, mc = (int(np.count_nonzero((data[u:v] & 0xC0) != 0x80)) for u, v in ((0, a), (a, b)))
        if h[3] % 100 < spm_below:
            return n, "spm", pc, mc, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
        return n, "psm", pc, mc, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))

    def batch(ids, rows):
        n, form, pc, mc, out = zip(*rows)
        return pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(pc, pa.int64()),
                                pa.array(mc, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                               names=["doc_id", *_OUT.names])

    def run(batches):
        for b in batches:
            data, bounds = text_buffer(b.column(1))
            bounds, hashes = bounds.tolist(), b.column(2).to_pylist()
            rows, first, held = [], 0, 0
            for i, h in enumerate(hashes):
                rows.append(one(data[bounds[i]:bounds[i + 1]], [int(h[j:j + 8], 16) for j in (0, 8, 16, 24)]))
                held += len(rows[-1][4])
                if held >= OUT_BYTES:
                    yield batch(b.column(0).slice(first, len(rows)), rows)
                    rows, first, held = [], i + 1, 0
            if rows:
                yield batch(b.column(0).slice(first, len(rows)), rows)
    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "char", fim_percent: int = 90, spm_percent: int = 20,
                   sentinels=(PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text with its middle moved to the end.

    ``h1`` to ``h4`` are the first four groups of eight digits of the hex sha256 of ``seed:id``. The text's n units are
    cut behind the smaller and the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)``. The form is ``plain`` if the text is
    empty, contains one of the ``sentinels`` (prefix, suffix, middle) or ``h3 % 100 >= fim_percent``; else ``spm`` if
    ``h4 % 100 < spm_percent``; else ``psm``.

    Returns one row per row: ``doc_id``, ``n``, ``form``, ``prefix_chars`` and ``middle_chars`` (code points; null if plain)
    and ``output``; ``restored`` reads the text back from the output. A null text counts as empty, a null id as an empty
    one; rows that share an id are cut by the same hashes; other columns are dropped. Texts of any length are read whole, one
    at a time. An empty table gives an empty result.
    """
    _checked(sentinels, unit)
    ship_package(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.sha2(key, 256).alias("hashes"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_cut(unit, tuple(sentinels), fim_percent, spm_percent),
                           f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def _checked(sentinels, unit) -> None:
    """A sentinel must be found where it was put: none may overlap the start of another or hold it."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    if len(sentinels) != 3 or not all(sentinels):
        raise ValueError("three sentinels, none of them empty")
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError("sentinels must not overlap")


def restored(output, form, sentinels=(PREFIX, SUFFIX, MIDDLE)) -> F.Column:
    """The text of an ``output`` of ``fill_in_middle``, read from it and its form alone."""
    p, s, m = sentinels

    def parts(first, second):
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + F.lit(len(second) + 1))
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.length(b) + F.lit(len(m) + 1))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output))
