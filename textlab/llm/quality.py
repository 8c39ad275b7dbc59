"""Quality classifier: support vectors on naive-Bayes scaled n-gram indicators.

Features are the distinct word unigrams, word bigrams and byte trigrams of a text (case kept),
hashed into a fixed number of columns. The class log-count ratio of a column scales its
indicator, rows are brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. The fit uses a bounded sample of the labelled rows (``max_rows``, expected
size, picked by a hash of the id) in one task; scoring is one pass over all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.kernels import U64, chain, distinct, slices, words
from textlab.llm.langid import held_out
from textlab.session import ship_package

WORD_BITS, BYTE_BITS = 18, 17
REPEAT, RUNS = (1 << WORD_BITS) + (1 << BYTE_BITS), 5        # word n-grams (2 to 6) of one word over and over, whatever the word
COLUMNS = REPEAT + RUNS
_MIX = U64(0x9E3779B97F4A7C15)


def indicators(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) of the distinct features of a slice, sorted."""
    h, first, _, _ = words(data, bounds, lower=False)
    doc = np.repeat(np.arange(bounds.size - 1), np.diff(first))
    same = doc[1:] == doc[:-1]
    pairs = chain(h[:-1], h[1:])[same] if h.size > 1 else h[:0]
    w = np.concatenate([h, pairs]) >> U64(64 - WORD_BITS)
    parts = [(np.concatenate([doc, doc[1:][same]]) << 20) | w.astype(np.int64)]
    run, at = same & (h[1:] == h[:-1]), doc[1:]
    for k in range(RUNS):
        parts.append((at[run] << 20) | (REPEAT + k))
        run, at = run[1:] & run[:-1], at[1:]
    if data.size > 2:
        b = data.astype(np.uint64)
        tri = ((b[:-2] << U64(16)) | (b[1:-1] << U64(8)) | b[2:])
        byte_doc = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
        inside = byte_doc[2:] == byte_doc[:-2]
        t = ((tri * _MIX) >> U64(64 - BYTE_BITS)).astype(np.int64) + (1 << WORD_BITS)
        parts.append(((byte_doc[2:] << 20) | t)[inside])
    keys = distinct(np.concatenate(parts))
    return keys >> 20, keys & ((1 << 20) - 1)


def _rows(batches):
    """(y, text) -> (y, packed columns)."""
    for b in batches:
        packed = []
        for i, j, data, bounds in slices(b.column(1)):
            doc, col = indicators(data, bounds)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            packed += [col[a:z].astype("<i4").tobytes() for a, z in zip(cut[:-1], cut[1:])]
        yield pa.record_batch({"y": b.column(0), "cols": pa.array(packed, pa.binary())})


def fit(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, c: float = 1.0, epochs: int = 30, seed: int = 7):
    """(column weights already times their ratio, ratios, bias) of rows of distinct columns, y in {0, 1}."""
    size = np.array([r.size for r in rows])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    label = np.repeat(y, size)
    p = alpha + np.bincount(flat[label == 1], minlength=COLUMNS)
    q = alpha + np.bincount(flat[label == 0], minlength=COLUMNS)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = []
    for r in rows:
        v = ratio[r]
        norm = np.sqrt((v * v).sum())
        x.append(v / norm if norm > 0 else v)
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.maximum(np.bincount(y, minlength=2), 1) / max(1, len(y))
    top = c * np.sqrt(0.5 / share[y]) if len(y) else np.empty(0)        # the rarer class weighs more
    w, bias, dual = np.zeros(COLUMNS), 0.0, np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1.0 for v in x])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            s, r, v = sign[i], rows[i], x[i]
            new = min(max(dual[i] - (s * (w[r] @ v + bias) - 1.0) / square[i], 0.0), top[i])
            d = new - dual[i]
            if d:
                dual[i] = new
                w[r] += d * s * v
                bias += d * s
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w * ratio, ratio * ratio, bias


def _fit_group(alpha, c, epochs):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc_key").to_numpy(), kind="stable")
        cols = table.column("cols").combine_chunks()
        rows = [np.frombuffer(cols[int(i)].as_py(), "<i4").astype(np.int64) for i in order]
        w, sq, bias = fit(rows, table.column("y").to_numpy()[order], alpha, c, epochs)
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "sq": pa.array([sq.tobytes()], pa.binary()), "bias": [float(bias)]})
    return run


def margins(data, bounds, w, sq, bias):
    doc, col = indicators(data, bounds)
    n = bounds.size - 1
    norm = np.sqrt(np.bincount(doc, weights=sq[col], minlength=n))
    return np.bincount(doc, weights=w[col], minlength=n) / np.where(norm > 0, norm, 1.0) + bias


def _score(model):
    def run(batches):
        w, sq, bias = model.value
        for b in batches:
            s = np.empty(b.num_rows)
            for i, j, data, bounds in slices(b.column(2)):
                s[i:j] = 1.0 / (1.0 + np.exp(-2.0 * np.clip(margins(data, bounds, w, sq, bias), -300, 300)))
            yield pa.record_batch({"doc_id": b.column(0), "held_out": b.column(1), "score": s,
                                   "predicted": pa.array((s >= 0.5).astype(np.int32))})
    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             max_rows: int = 10_000, alpha: float = 1.0, c: float = 1.0, epochs: int = 30) -> DataFrame:
    """Fit on labelled rows that are not held out (crc32(id as text) mod 3 is not 1) and score every row.

    Returns one row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1; a null or empty text
    gets the score of no features), ``predicted`` (1 if score >= 0.5). Rows with a null or
    other label than 0 and 1 teach nothing; an id with several labels teaches each. Without labelled rows every score is 0.5.
    ``max_rows`` bounds the expected number of labelled rows that the fit sees. Ids and labels are no features.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    total = known.count()
    share = min(1.0, max_rows / total) if total else 0.0
    sample = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))      # about max_rows rows
    if share >= 1.0:
        sample = known
    taught = base.join(F.broadcast(sample), base["doc_id"] == sample["label_id"]).select("y", "text", F.xxhash64("doc_id", "y", "text").alias("k"))
    packed = taught.select("y", "text", "k").mapInArrow(_keyed_rows, "y int, cols binary, doc_key long")
    fitted = packed.groupBy().applyInArrow(_fit_group(alpha, c, epochs), "w binary, sq binary, bias double").collect()
    if fitted:
        model = (np.frombuffer(bytes(fitted[0]["w"])), np.frombuffer(bytes(fitted[0]["sq"])), fitted[0]["bias"])
    else:
        model = (np.zeros(COLUMNS), np.zeros(COLUMNS), 0.0)
    id_type = base.schema["doc_id"].dataType.simpleString()
    return base.select("doc_id", "held_out", "text").mapInArrow(
        _score(spark.sparkContext.broadcast(model)), f"doc_id {id_type}, held_out boolean, score double, predicted int")


def _keyed_rows(batches):
    for b in batches:
        for out in _rows([b]):
            yield pa.record_batch({"y": out.column(0), "cols": out.column(1), "doc_key": b.column(2)})
