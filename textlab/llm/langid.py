"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3 letters, a word's edges
marked) of a language's training texts, in order of frequency. A document's own list is
compared with each profile by the out-of-place distance: the sum of the rank differences, with the
list length for an n-gram that the profile lacks. The nearest profile wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.kernels import distinct_counts, slices, tidy
from textlab.session import materialize, ship_package

EDGE = 0x20                     # a word's edge inside an n-gram
UNKNOWN = "und"
MAX_PROFILE_ROWS = 5_000_000    # profiles that are sent to every task: languages x ranks


def held_out(id_col) -> F.Column:
    """Documents that are never learnt from: crc32(id as text) mod 3 = 1. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _grams(data: np.ndarray, bounds: np.ndarray):
    """The n-grams of a slice of lower-cased texts: (document, code) arrays, bits of a character in a
    code, and the code points that the dense character numbers stand for."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[bounds]
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    used = np.unique(cp)
    letters = np.array([c for c in used.tolist() if chr(c).isalpha()], np.int64)
    alphabet = np.concatenate([[0, EDGE], letters])                  # 0: none, 1: edge, 2..: letters
    dense = np.ones(int(used[-1]) + 1 if used.size else 1, np.int64)
    dense[letters] = np.arange(2, letters.size + 2)
    n_docs = bounds.size - 1
    x = np.insert(dense[cp], at[1:], 1)
    doc = np.repeat(np.arange(n_docs), np.diff(at) + 1)
    keep = np.ones(x.size, bool)
    keep[1:] = (x[1:] != 1) | (x[:-1] != 1)
    x, doc = np.concatenate([[1], x[keep]]), np.concatenate([[0], doc[keep]])
    bits = max(2, int(alphabet.size).bit_length())
    one = x != 1
    two = one[1:] | one[:-1]
    three = one[1:-1] & (one[2:] | one[:-2])
    codes = np.concatenate([x[one], ((x[:-1] << bits) | x[1:])[two],
                            ((x[:-2] << 2 * bits) | (x[1:-1] << bits) | x[2:])[three]])
    # an n-gram belongs to the document of its letters; a leading edge may stand before the document
    last = np.where(one[1:], doc[1:], doc[:-1])
    docs = np.concatenate([doc[one], last[two], np.where(one[2:], doc[2:], doc[1:-1])[three]])
    return docs, codes, bits, alphabet


def _wide(codes: np.ndarray, bits: int, alphabet: np.ndarray) -> np.ndarray:
    """Dense codes as three 21-bit code points (leading ones 0)."""
    m = (1 << bits) - 1
    return (alphabet[codes >> 2 * bits] << 42) | (alphabet[(codes >> bits) & m] << 21) | alphabet[codes & m]


def _keyed_counts(group: np.ndarray, codes: np.ndarray, bits: int):
    """(group, code, count) of the distinct pairs, sorted."""
    shift = 3 * bits
    if int(group.max(initial=0)).bit_length() + shift <= 63:
        keys, n = distinct_counts((group << shift) | codes)
        return keys >> shift, keys & ((1 << shift) - 1), n
    o = np.lexsort((codes, group))
    g, c = group[o], codes[o]
    at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])) if g.size else np.empty(0, np.int64)
    return g[at], c[at], np.diff(np.append(at, g.size))


def _count(batches):
    """Training rows (lang, text) -> n-gram counts by language, one row per batch of rows and n-gram."""
    for b in batches:
        coded = b.column(0).dictionary_encode()
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = None
        for i, j, data, bounds in slices(b.column(1)):
            if data.size == 0:
                continue
            docs, codes, bits, alphabet = _grams(data, bounds)
            g, c, n = _keyed_counts(lang[i:j][docs], codes, bits)
            t = pa.table({"lang": g, "gram": _wide(c, bits, alphabet), "n": n})
            total = t if total is None else pa.concat_tables([total, t])
            if total.num_rows > 1_000_000:
                total = _sum(total)
        if total is not None and total.num_rows:
            total = _sum(total)
            names = coded.dictionary.take(total.column("lang").combine_chunks())
            yield from pa.table({"lang": names, "gram": total.column("gram"), "n": total.column("n")}).to_batches()


def _sum(t: pa.Table) -> pa.Table:
    return t.group_by(["lang", "gram"]).aggregate([("n", "sum")]).rename_columns(["lang", "gram", "n"])


def profiles(rows: DataFrame, size: int = 400, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, rank from 0) of the ``size`` most frequent n-grams of every language, over all
    rows with a non-null language; ties to the smaller code points. ``gram`` holds three code points in 21 bits each."""
    ship_package(rows.sparkSession)
    counts = (rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.lower(F.col(text_col)).alias("text"))
              .mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def _predict(model, size: int):
    """Rows (..., lower-cased text or null) -> the same without the text, with prediction and score."""
    def run(batches):
        langs, ranked = model.value
        for b in batches:
            pred, score = [], []
            for _, _, data, bounds in slices(b.column(b.num_columns - 1)):
                p, s = _nearest(data, bounds, langs, ranked, size)
                pred += p
                score.append(s)
            yield pa.record_batch([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else np.empty(0))],
                                  names=[*b.schema.names[:-1], "lang_pred", "score"])
    return run


def _nearest(data, bounds, langs, ranked, size):
    n = bounds.size - 1
    if data.size == 0 or not langs:
        return [UNKNOWN] * n, np.zeros(n)
    docs, codes, bits, alphabet = _grams(data, bounds)
    g, c, times = _keyed_counts(docs, codes, bits)
    del docs, codes
    cap = 1 << 21
    need = int(g.max(initial=0)).bit_length() + 21 + 3 * bits
    if need <= 63 and (times < cap).all():
        key = np.sort((((g << 21) | (cap - 1 - times)) << 3 * bits) | c)
        g, c = key >> (21 + 3 * bits), key & ((1 << 3 * bits) - 1)
    else:
        o = np.lexsort((c, -times, g))
        g, c = g[o], c[o]
    first = np.searchsorted(g, np.arange(n))
    rank = np.arange(g.size) - first[g]
    top = rank < size
    g, c, rank = g[top], _wide(c[top], bits, alphabet), rank[top]
    m = np.bincount(g, minlength=n)
    best, who = np.full(n, np.inf), np.zeros(n, np.int64)
    for i, (grams, ranks) in enumerate(ranked):
        at = np.minimum(np.searchsorted(grams, c), grams.size - 1)
        far = np.where(grams[at] == c, np.abs(rank - ranks[at]), size)
        d = np.bincount(g, weights=far, minlength=n)
        better = d < best
        best[better], who[better] = d[better], i
    score = np.where(m > 0, 1.0 - best / np.maximum(1, m * size), 0.0)
    return [langs[w] if k else UNKNOWN for w, k in zip(who.tolist(), (m > 0).tolist())], np.clip(score, 0.0, 1.0)


def identify(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn profiles from the rows with a language that are not held out, and predict every row.

    Returns one row per input row: ``doc_id``, ``held_out``, ``lang_pred`` (a learnt language; ``und``
    for a null text or one without a letter, and where nothing was learnt), ``score`` (1 - distance /
    largest possible distance; 0 for ``und``). Equal distances go to the language that sorts first.
    Whole texts count, of any length; repeated rows count each time. Nothing but the text
    enters a prediction. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = predicted(base, size, "doc_id", "text", "lang")
    return out.select("doc_id", "held_out", F.col("lang_pred"), F.col("score"))


def predicted(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` but the text, with the columns ``lang_pred`` and ``score`` of ``identify`` in addition (a row has
    its own prediction, whatever its id; columns of ``docs`` with these two names are replaced)."""
    spark = docs.sparkSession
    ship_package(spark)
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(~held_out(F.col("doc_id")))
    table = materialize(profiles(train, size), "profiles")
    if table.count() > MAX_PROFILE_ROWS:
        raise ValueError("too many languages for profiles that every task holds")
    by_lang: dict = {}
    for r in table.collect():
        by_lang.setdefault(r["lang"], []).append((r["gram"], r["rank"]))
    langs = sorted(by_lang)
    ranked = [tuple(np.array(sorted(by_lang[x]), np.int64).T) for x in langs]
    model = spark.sparkContext.broadcast((langs, ranked))
    names = [c for c in docs.columns if c not in ("lang_pred", "score", text_col)]
    rows = docs.select(*[docs[c] for c in names], F.lower(docs[text_col]).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(_predict(model, size)), schema)
