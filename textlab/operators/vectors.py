"""Vector arithmetic over token-vector tables.

Token vectors are a table ``(token, vec ARRAY<DOUBLE>)`` with a row for every word of the lexicon. It grows with the
vocabulary, so tokens meet their vectors in joins by key; frequent tokens are counted per document first,
and what is left of their skew is split by adaptive execution. Where the frequent tokens are known, their vectors are a
broadcast of fixed size and are summed where the texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import materialize, partitions_for

BLOCK_ROWS = 20_000             # (pair, side, token) rows of a block of pairs
HOT_VECTORS = 100_000           # vectors, those of the most frequent tokens, that every task holds
DOCS_AT_ONCE = 100              # documents whose token vectors are held at once


def doc_cosine(tokens: DataFrame, keys, side_col: str, tok_col: str, vectors: DataFrame,
               side_a: str, side_b: str) -> DataFrame:
    """``token_cosine`` of the documents whose tokens are the rows of ``tokens``."""
    sides = [F.collect_list(F.when(F.col(side_col) == s, F.col(tok_col))).alias(c) for s, c in ((side_a, "__a"), (side_b, "__b"))]
    return token_cosine(tokens.groupBy(*keys).agg(*sides), keys, "__a", "__b", vectors)


def token_cosine(docs: DataFrame, keys, col_a: str, col_b: str, vectors: DataFrame, frequent: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Cosine between the summed vectors of two token arrays of each document, ``(*keys, cosine)``.

    The vectors of the ``frequent`` tokens (a column ``token`` of at most ``HOT_VECTORS`` rows) are summed in Arrow batches of documents. A
    document's other tokens, only those that match ``pattern`` if given, are counted and joined to their vectors by key. Both kinds of rows,
    weights for the two sides and a vector, are dealt by document to blocks of bounded size, which add them up. Documents
    where a side has no vector get NULL.
    """
    k = list(keys)
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    zero = F.lit(0.0)
    padded = F.concat(F.transform("vec", lambda x: F.coalesce(x, zero)), F.array_repeat(zero, F.greatest(F.lit(width) - F.size("vec"), F.lit(0))))
    v = vectors.where(F.col("vec").isNotNull()).select(F.col("token").alias("__t"), padded.alias("__vec"))
    words, sums = pa.array([], pa.string()), np.zeros((0, width))
    if frequent is not None:
        held = v.join(F.broadcast(frequent.select(F.col("token").alias("__t"))), "__t", "left_semi").toArrow().combine_chunks()
        coded = held.column("__t").cast(pa.string()).combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        words, sums = coded.dictionary, np.zeros((len(coded.dictionary), width))
        np.add.at(sums, coded.indices.to_numpy(), held.column("__vec").combine_chunks().flatten().to_numpy().reshape(-1, width))
    shared = docs.sparkSession.sparkContext.broadcast((words, sums))
    parts = materialize(docs.select(*k, F.col(col_a).alias("__a"), F.col(col_b).alias("__b")).mapInArrow(
        _sum_frequent(k, shared, pattern), f"{_types(docs, k)}, __t string, __wa double, __wb double, __vec array<double>"), "side_sums")
    rare = parts.where("__t is not null").drop("__vec").join(v, "__t").select(*k, "__wa", "__wb", "__vec")
    rows = parts.where("__t is null").drop("__t").unionByName(rare)
    blocks = partitions_for(docs.sparkSession, parts.count(), BLOCK_ROWS)
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(*k), F.lit(blocks)))
    d = rows.groupBy("__block").applyInArrow(_sum_block(k), f"{_types(docs, k)}, __dot double, __na double, __nb double")
    cos = F.when((F.col("__na") > 0) & (F.col("__nb") > 0),
                 F.col("__dot") / (F.sqrt("__na") * F.sqrt("__nb")))
    return d.select(*k, cos.alias("cosine"))


def _types(df: DataFrame, k) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in k)


def _sum_frequent(k, shared, pattern):
    """Documents with two token arrays -> rows (keys, null, weights, sum of the frequent vectors) and (keys, other token, counts, null)."""
    def side(lists, words, sums):
        offsets = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        tokens = pa.compute.utf8_lower(lists.flatten())
        doc = np.repeat(np.arange(len(lists)), np.diff(offsets))
        at = pa.compute.fill_null(pa.compute.index_in(tokens, value_set=words), -1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(at >= 0)
        total, any_hit = np.zeros((len(lists), sums.shape[1])), np.zeros(len(lists), bool)
        if hit.size:
            mine = doc[hit]
            start = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            total[mine[start]] = np.add.reduceat(sums[at[hit]], start, axis=0)
            any_hit[mine[start]] = True
        other = pa.compute.and_(pa.compute.is_valid(tokens), pa.array(at < 0))
        if pattern is not None:
            other = pa.compute.and_(other, pa.compute.fill_null(pa.compute.match_substring_regex(tokens, pattern), False))
        return total, any_hit, doc[other.to_numpy(zero_copy_only=False)], tokens.filter(other)

    def run(batches):
        words, sums = shared.value
        for whole in batches:
            for i in range(0, len(whole), DOCS_AT_ONCE):
                b = whole.slice(i, DOCS_AT_ONCE)
                doc, tok, wa, wb, vec = [], [], [], [], []
                rest = []
                for c, w in (("__a", (1.0, 0.0)), ("__b", (0.0, 1.0))):
                    total, some, other, tokens = side(b.column(c), words, sums)
                    mine = np.flatnonzero(some)
                    doc.append(mine), vec.append(total[mine]), wa.append(np.full(len(mine), w[0])), wb.append(np.full(len(mine), w[1]))
                    rest.append(pa.table({"d": pa.array(other, pa.int64()), "t": tokens, "a": pa.array(np.full(len(other), w[0])), "b": pa.array(np.full(len(other), w[1]))}))
                rest = pa.concat_tables(rest).group_by(["d", "t"]).aggregate([("a", "sum"), ("b", "sum")])
                n = sum(len(x) for x in doc)
                at = pa.array(np.concatenate([*doc, rest.column("d").to_numpy()]).astype(np.int64))
                tok = pa.concat_arrays([pa.nulls(n, pa.string()), *[x.cast(pa.string()) for x in rest.column("t").chunks]])
                flat = np.concatenate(vec)
                offsets = np.append(np.arange(n + 1), np.full(rest.num_rows, n)) * flat.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(at) for c in k], tok, pa.array(np.concatenate([*wa, rest.column("a_sum").to_numpy()])),
                     pa.array(np.concatenate([*wb, rest.column("b_sum").to_numpy()])), lists], [*k, "__t", "__wa", "__wb", "__vec"])
    return run


def _sum_block(keys):
    """Rows (keys, weights, vector) of a block of documents -> (keys, dot product and squared norms of the two weighted sums)."""
    def run(t: pa.Table) -> pa.Table:
        names = [_codes(t.column(c)) for c in keys]
        order = np.lexsort(names)
        x = t.column("__vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)[order]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in names], axis=0)
        start = np.flatnonzero(new)
        a, b = (np.add.reduceat(np.where(w[:, None] > 0, w[:, None] * x, 0.0), start, axis=0)
                for w in (t.column(c).to_numpy()[order] for c in ("__wa", "__wb")))
        cols = {c: t.column(c).take(pa.array(order[start])) for c in keys}
        return pa.table({**cols, "__dot": (a * b).sum(axis=1), "__na": (a * a).sum(axis=1), "__nb": (b * b).sum(axis=1)})
    return run


def _codes(column) -> np.ndarray:
    """Numbers of the values of a key column; null is a value too."""
    coded = pa.compute.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy(zero_copy_only=False)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _match_block(keys, baseline: float | None):
    """Rows (keys, is_pred, n, vec) of a block of pairs -> (keys, precision, recall, f1)."""
    def run(t: pa.Table) -> pa.Table:
        names = [pa.compute.dictionary_encode(t.column(c).combine_chunks()).indices.to_numpy() for c in keys]
        order = np.lexsort((t.column("is_pred").to_numpy(), *names))
        vec = t.column("vec").combine_chunks()
        x = _unit_rows(vec.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)[order])
        n, pred = t.column("n").to_numpy()[order].astype(np.float64), t.column("is_pred").to_numpy()[order]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in names], axis=0)
        start = np.flatnonzero(new)
        out = []
        for a, z in zip(start, [*start[1:], t.num_rows]):
            m = a + int(np.count_nonzero(~pred[a:z]))
            if m == a or m == z:
                out.append((None, None, None))
                continue
            sim = x[m:z] @ x[a:m].T
            p = float((sim.max(axis=1) * n[m:z]).sum() / n[m:z].sum())
            r = float((sim.max(axis=0) * n[a:m]).sum() / n[a:m].sum())
            f = 2 * p * r / (p + r) if p + r != 0 else 0.0
            if baseline is not None:
                p, r, f = ((s - baseline) / (1 - baseline) for s in (p, r, f))
            out.append((p, r, f))
        cols = {c: t.column(c).take(pa.array(order[start])) for c in keys}
        return pa.table({**cols, **{c: pa.array([o[i] for o in out], pa.float64()) for i, c in enumerate(("precision", "recall", "f1"))}})
    return run


def greedy_match(pairs: DataFrame, keys, pred_tokens: str, ref_tokens: str, vectors: DataFrame, baseline: float | None = None) -> DataFrame:
    """E5: BERTScore-style greedy matching per pair.

    Each prediction token is matched to its most similar reference token
    (cosine) and vice versa; P and R are the means of those maxima, F1 their
    harmonic mean. Only tokens with a vector take part; a pair without any on one side gets NULLs. With a ``baseline`` b each
    score x becomes ``(x - b) / (1 - b)``.

    The different tokens of each side, with their counts, meet their vectors in a join by token; the rows are
    then dealt by pair to blocks of bounded size, and a block matches its pairs one by one (the
    similarity matrix is different tokens by different tokens).
    """
    k = list(keys)
    long = pairs.select(*k, F.explode(F.array(F.struct(F.lit(True).alias("is_pred"), F.col(pred_tokens).alias("toks")),
                                              F.struct(F.lit(False).alias("is_pred"), F.col(ref_tokens).alias("toks")))).alias("s"))
    long = long.select(*k, "s.is_pred", F.explode("s.toks").alias("token")).groupBy(*k, "is_pred", "token").agg(F.count("*").alias("n"))
    long = materialize(long, "pair_tokens")
    blocks = partitions_for(long.sparkSession, long.count(), BLOCK_ROWS)
    rows = long.join(vectors.select("token", "vec"), "token").select(F.pmod(F.xxhash64(*k), F.lit(blocks)).alias("__block"), *k, "is_pred", "n", "vec")
    types = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in k)
    scores = rows.groupBy("__block").applyInArrow(_match_block(k, baseline), f"{types}, precision double, recall double, f1 double")
    scores = scores.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(k)], "precision", "recall", "f1")
    return pairs.select(*k).join(scores, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(k)], "left").select(*k, "precision", "recall", "f1")
