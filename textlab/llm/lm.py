"""Language-model scoring by deleted interpolation.

The probability of a token w after v mixes the maximum-likelihood estimates of the bigram, the
unigram and the uniform distribution; the three weights depend on how often the context v was
seen (buckets of its frequency) and are learnt by expectation-maximisation on the counts of a
held-out tenth of the training documents.

Documents are dealt to blocks of bounded size by a hash. A block sends the owners of the hash
ranges its distinct tokens and bigrams, Golomb coded, with its training counts; an owner adds
up and answers with the totals in the same order. No vocabulary is broadcast or collected, and a
token that stands in every document is one entry per block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textlab.llm.kernels import (U64, chain, counts_decode, counts_encode, distinct_counts, golomb_decode,
                                 golomb_encode, slices, words)
from textlab.session import materialize, ship_package

START, END = U64(0x5354415254), U64(0x454E44)       # stand for the hashes of the text's start and end
BLOCK_BYTES = 8 << 20
OWNER_ENTRIES = 1 << 21
SPARE_BITS = 20          # a bigram shares its hash with another about once in 2**20
BUCKETS = 24
TRAIN, HELD, TEST = 0, 1, 2
CELLS = 40               # cells of the held-out counts per factor of the two estimates


def held_out(id_col) -> F.Column:
    """Documents that are never learnt from: crc32(id as text) mod 7 = 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def _tokens(column):
    """(token hashes, first token of each document and the end) of a whole column; every document
    ends with END."""
    parts, sizes = [], []
    for i, j, data, bounds in slices(column):
        h, first, _, _ = words(data, bounds)
        parts.append(np.insert(h, first[1:], END))
        sizes.append(np.diff(first) + 1)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _bigrams(tokens: np.ndarray, first: np.ndarray, bits: int):
    """(context hash, bigram hash of ``bits`` bits) of every token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return before, chain(before, tokens) >> U64(64 - bits)


def _owner(keys: np.ndarray, bits: int, owners: int) -> np.ndarray:
    return (((keys >> U64(max(0, bits - 32))) * U64(owners)) >> U64(min(bits, 32))).astype(np.int64)


def _send(bits: int, owners: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        block, fold = table.column("block")[0].as_py(), table.column("fold")[0].as_py()
        tokens, first = _tokens(table.column("text"))
        _, pairs = _bigrams(tokens, first, bits)
        out = {k: [] for k in ("ord", "owner", "keys", "counts")}
        for order, (keys, width) in enumerate(((tokens, 64), (pairs, bits))):
            keys, n = distinct_counts(keys)
            cut = np.searchsorted(_owner(keys, width, owners[order]), np.arange(owners[order] + 1))
            for o, (a, z) in enumerate(zip(cut[:-1], cut[1:])):
                if z > a:
                    out["ord"].append(order)
                    out["owner"].append(o)
                    out["keys"].append(golomb_encode(keys[a:z]))
                    out["counts"].append(counts_encode(n[a:z]) if fold != TEST else None)
        m = len(out["ord"])
        return pa.table({"block": pa.array([block] * m, pa.int64()), "fold": pa.array([fold] * m, pa.int32()),
                         "ord": pa.array(out["ord"], pa.int32()), "owner": pa.array(out["owner"], pa.int32()),
                         "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})
    return run


MESSAGE = "block long, fold int, ord int, owner int, keys binary, counts binary"
ANSWER = "block long, fold int, ord int, owner int, total binary, rest binary, v long, n long, n_rest long"


def _add_up(table: pa.Table) -> pa.Table:
    """An owner's messages -> their totals over all training documents and (for held-out blocks)
    over the rest without the held-out tenth; last a row with the owner's own sums."""
    fold = table.column("fold").to_pylist()
    keys = [golomb_decode(x.as_py()) for x in table.column("keys")]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    starts = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    ids = np.empty(every.size, np.int64)
    ids[order] = np.cumsum(starts) - 1
    m = int(starts.sum())
    rest, held = np.zeros(m, np.int64), np.zeros(m, np.int64)
    cut = np.concatenate([[0], np.cumsum([k.size for k in keys])])
    for f, c, a, z in zip(fold, table.column("counts"), cut[:-1], cut[1:]):
        if f != TEST:
            (rest if f == TRAIN else held)[ids[a:z]] += counts_decode(c.as_py())       # keys are distinct in a message
    total = rest + held
    k = len(fold)
    one = pa.nulls(1, pa.binary())
    return pa.table({
        "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.nulls(1, pa.int64())]),
        "fold": pa.concat_arrays([table.column("fold").combine_chunks(), pa.nulls(1, pa.int32())]),
        "ord": pa.concat_arrays([table.column("ord").combine_chunks(), table.column("ord").combine_chunks()[:1]]),
        "owner": pa.concat_arrays([table.column("owner").combine_chunks(), table.column("owner").combine_chunks()[:1]]),
        "total": pa.concat_arrays([pa.array([counts_encode(total[ids[a:z]]) for a, z in zip(cut[:-1], cut[1:])], pa.binary()), one]),
        "rest": pa.concat_arrays([pa.array([counts_encode(rest[ids[a:z]]) if f == HELD else None
                                            for f, a, z in zip(fold, cut[:-1], cut[1:])], pa.binary()), one]),
        "v": pa.array([None] * k + [int((total > 0).sum())], pa.int64()),
        "n": pa.array([None] * k + [int(total.sum())], pa.int64()),
        "n_rest": pa.array([None] * k + [int(rest.sum())], pa.int64())})


def _answers(table: pa.Table, column: str, order: int) -> np.ndarray:
    """A block's totals of one order, in the order of its sorted keys."""
    rows = [(o, x.as_py()) for r, o, x in zip(table.column("ord").to_pylist(), table.column("owner").to_pylist(), table.column(column)) if r == order]
    return np.concatenate([counts_decode(x) for _, x in sorted(rows, key=lambda r: r[0])])


def _estimates(texts: pa.Table, answers: pa.Table, column: str, bits: int):
    """(first token of each document, counts of every token, of its bigram and of its context)."""
    tokens, first = _tokens(texts.column("text"))
    before, pairs = _bigrams(tokens, first, bits)
    keys, count = distinct_counts(tokens)[0], _answers(answers, column, 0)
    at = np.searchsorted(keys, tokens)
    c1 = count[at]
    ends = count[np.searchsorted(keys, END)] if keys.size else 0      # every document has one END, so this counts the starts
    ctx = np.empty_like(c1)
    ctx[1:] = c1[:-1]
    ctx[first[:-1]] = ends
    pair_keys, pair_count = distinct_counts(pairs)[0], _answers(answers, column, 1)
    return first, c1, pair_count[np.searchsorted(pair_keys, pairs)], ctx


def _bucket(ctx: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 unseen, then by powers of two."""
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(ctx + 1.0)).astype(np.int64))


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(a.size), where=b > 0) if np.ndim(b) else (a / b if b else np.zeros(a.size))


def _held_counts(bits: int, n_rest: int):
    """A held-out block -> its tokens counted in cells of (context bucket, bigram estimate, unigram
    estimate), with the sums of both estimates."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if texts.num_rows == 0 or answers.num_rows == 0:
            return pa.table({k: pa.array([], t) for k, t in (("b", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("n", pa.int64()), ("p2", pa.float64()), ("p1", pa.float64()))})
        _, c1, c2, ctx = _estimates(texts, answers, "rest", bits)
        p2, p1, b = _ratio(c2, ctx), _ratio(c1, n_rest), _bucket(ctx)

        def cell(p):
            return np.where(p > 0, np.maximum(1 - CELLS, np.floor(np.log2(np.where(p > 0, p, 1.0)))) + CELLS, 0).astype(np.int64)
        key = (b * (CELLS + 1) + cell(p2)) * (CELLS + 1) + cell(p1)
        u, inv = np.unique(key, return_inverse=True)
        return pa.table({"b": u // (CELLS + 1) ** 2, "i": u // (CELLS + 1) % (CELLS + 1), "j": u % (CELLS + 1),
                         "n": np.bincount(inv).astype(np.int64), "p2": np.bincount(inv, weights=p2), "p1": np.bincount(inv, weights=p1)})
    return run


def learn_weights(cells, uniform: float, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bucket x [uniform, unigram, bigram]) by expectation-maximisation on held-out
    cells (bucket, n, sum of bigram estimates, sum of unigram estimates). A bucket without held-out
    tokens gets the weights of the nearest one below it, the first ones those of no bigram."""
    w = np.tile(np.array([0.1, 0.9, 0.0]), (BUCKETS, 1))
    cells = np.array(cells, float).reshape(-1, 4)
    last = w[0]
    for b in range(BUCKETS):
        x = cells[cells[:, 0] == b]
        if x.size:
            n = x[:, 1]
            p = np.stack([np.full(n.size, uniform), x[:, 3] / n, x[:, 2] / n], axis=1)
            lam = np.full(3, 1 / 3)
            for _ in range(rounds):
                share = p * lam
                share /= share.sum(axis=1, keepdims=True)
                lam = np.maximum((share * n[:, None]).sum(axis=0) / n.sum(), 1e-9)
                lam /= lam.sum()
            if b == 0:
                lam = np.array([lam[0], 1 - lam[0], 0.0])
            last = lam
        w[b] = last
    return w


def _score(bits: int, n: int, v: int, weights: np.ndarray, id_type: pa.DataType):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if texts.num_rows == 0:
            e = pa.array([], pa.int64())
            return pa.table({"doc_id": pa.array([], id_type), "held_out": pa.array([], pa.bool_()), "n_tokens": e, "n_known": e,
                             "train_tokens": e, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        first, c1, c2, ctx = _estimates(texts, answers, "total", bits)
        lam = weights[_bucket(ctx)]
        p = lam[:, 2] * _ratio(c2, ctx) + lam[:, 1] * _ratio(c1, n) + lam[:, 0] / (v + 1)
        doc = np.repeat(np.arange(first.size - 1), np.diff(first))

        def total(x):
            return np.bincount(doc, weights=x, minlength=first.size - 1)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pc_equal(texts.column("fold"), TEST),
            "n_tokens": np.diff(first), "n_known": total(c1 > 0).astype(np.int64),
            "train_tokens": np.full(first.size - 1, n, np.int64),
            "base_score": total(np.log10((c1 + 1.0) / (n + 1.0 * (v + 1)))), "score": total(np.log10(p))})
    return run


def pc_equal(column, value):
    return pa.array([x == value for x in column.to_pylist()], pa.bool_())


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents that are not held out and score every whole text (null: empty).

    Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end per text. Returns one row
    per input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one unigram, log10), ``score`` (log10 probability under the
    interpolated model). Repeated rows count each time. Without training documents every token has
    probability 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_col, text_col = F.col(id_col), F.col(text_col)
    text = F.coalesce(text_col, F.lit(""))
    tenth = F.pmod(F.xxhash64(F.lit("held"), id_col), F.lit(10)) == 0
    fold = F.when(held_out(id_col), TEST).when(tenth, HELD).otherwise(TRAIN)
    base = docs.select(id_col.alias("doc_id"), text.alias("text"), fold.alias("fold"))
    size = {r["fold"]: r["s"] for r in base.groupBy("fold").agg(F.sum(F.octet_length("text") + 1).alias("s")).collect()}
    total = sum(size.values())
    blocks = {f: max(1, -(-size.get(f, 0) // BLOCK_BYTES)) for f in (TRAIN, HELD, TEST)}
    bits = min(64, max(32, math.ceil(math.log2(total / 4 + 2)) + SPARE_BITS))
    owners = (max(4, total // 40 // OWNER_ENTRIES), max(12, total // 6 // OWNER_ENTRIES))
    place = F.lit(None).cast("long")
    at = 0
    for f, n in blocks.items():
        place = F.when(F.col("fold") == f, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) + at).otherwise(place)
        at += n
    dealt = base.withColumn("block", place)

    messages = dealt.groupBy("block").applyInArrow(_send(bits, owners), MESSAGE)
    answers = materialize(messages.groupBy("ord", "owner").applyInArrow(_add_up, ANSWER), "answers")
    sums = answers.filter("block is null and ord = 0").agg(F.sum("v"), F.sum("n"), F.sum("n_rest")).first()
    v, n, n_rest = (int(x or 0) for x in sums)

    answers = answers.filter("block is not null")
    held = dealt.filter(F.col("fold") == HELD).groupBy("block").cogroup(answers.filter(F.col("fold") == HELD).groupBy("block")).applyInArrow(
        _held_counts(bits, n_rest), "b long, i long, j long, n long, p2 double, p1 double")
    cells = held.groupBy("b", "i", "j").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).collect()
    weights = learn_weights([(r["b"], r["n"], r["p2"], r["p1"]) for r in cells], 1.0 / (v + 1))
    if not n:
        weights = np.tile(np.array([1.0, 0.0, 0.0]), (BUCKETS, 1))
    id_type = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answers.select("block", "ord", "owner", "total").groupBy("block")).applyInArrow(
        _score(bits, n, v, weights, to_arrow_type(dealt.schema["doc_id"].dataType)),
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
