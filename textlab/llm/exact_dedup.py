"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. One pass over the texts writes a narrow table: row number, doc_id, length, SHA-256 and a
   64-bit fingerprint of the normalised text.
2. Blocks of that table sort their distinct fingerprints, cut them to as many bits as the
   corpus needs, and send them, Golomb coded, to the owners of the hash ranges.
3. An owner answers every message with a bitmap: which of its fingerprints another block sent
   too, or the block itself holds more than once.
4. The documents of marked fingerprints are the suspects. Only their texts are compared: byte
   for byte, as grouping keys, with equal texts already merged on the map side.

A fingerprint shared by a third of all rows is one entry per block and message.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.kernels import U64, distinct_counts, golomb_decode, golomb_encode
from textlab.llm.rows import marked
from textlab.session import materialize, ship_package

WHITESPACE = r"[\x20\x09-\x0D]"
BLOCK_ROWS = 1 << 20
OWNER_HASHES = 1 << 20
SPARE_BITS = 10          # a fingerprint is taken for another's copy about once in 2**10


def normalised(text) -> F.Column:
    """Text without ASCII whitespace; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE + "+", "")


def _send(bits: int, owners: int):
    """Blocks of fingerprints -> one message per owner."""
    import uuid

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= BLOCK_ROWS:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    def block(held):
        prints, counts = distinct_counts(np.concatenate(held).view(np.uint64) >> U64(64 - bits))
        name = uuid.uuid4().hex
        who = owner_of(prints, bits, owners)
        cut = np.searchsorted(who, np.arange(owners + 1))
        rows = [(o, a, z) for o, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
        return pa.record_batch({
            "block": pa.array([name] * len(rows), pa.string()),
            "owner": pa.array([o for o, _, _ in rows], pa.int32()),
            "prints": pa.array([golomb_encode(prints[a:z]) for _, a, z in rows], pa.binary()),
            "repeated": pa.array([np.packbits(counts[a:z] > 1).tobytes() for _, a, z in rows], pa.binary()),
        })
    return run


def owner_of(prints: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Owner of a fingerprint: equal ranges of its leading (at most 32) bits, in order."""
    lead = prints >> U64(max(0, bits - 32))
    return ((lead * U64(owners)) >> U64(min(bits, 32))).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """An owner's messages -> for each a bitmap of the fingerprints that are duplicated."""
    messages = [golomb_decode(x.as_py()) for x in table.column("prints")]
    repeated = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=m.size).astype(bool)
                for x, m in zip(table.column("repeated"), messages)]
    every, times = distinct_counts(np.concatenate(messages))
    shared = every[times > 1]
    maps = [np.packbits(np.isin(m, shared, assume_unique=True) | r).tobytes() for m, r in zip(messages, repeated)]
    return pa.table({"block": table.column("block"), "owner": table.column("owner"),
                     "duplicated": pa.array(maps, pa.binary())})


def _marked(batches):
    """Messages with their answers -> the marked fingerprints."""
    for b in batches:
        out = []
        for coded, bitmap in zip(b.column("prints"), b.column("duplicated")):
            m = golomb_decode(coded.as_py())
            out.append(m[np.unpackbits(np.frombuffer(bitmap.as_py(), np.uint8), count=m.size).astype(bool)])
        yield pa.record_batch({"cut": pa.array((np.concatenate(out) if out else np.empty(0, np.uint64)).view(np.int64))})


def duplicated_fingerprints(prints: DataFrame, bits: int, owners: int) -> DataFrame:
    """Fingerprints (column ``cut``: the leading ``bits`` of the long ``prints``) that occur in
    more than one row. ``prints`` must be a written table, so that a block stays what it was."""
    sent = materialize(prints.mapInArrow(
        _send(bits, owners), "block string, owner int, prints binary, repeated binary"), "golomb")
    answers = sent.groupBy("owner").applyInArrow(_answer, "block string, owner int, duplicated binary")
    return sent.join(answers, ["block", "owner"]).select("prints", "duplicated").mapInArrow(
        _marked, "cut long").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts (equal after deleting ASCII whitespace; a null text is empty).

    Returns one row per input row: ``doc_id``, ``keep_id`` (the row of most code points, then the
    smallest id, then the first written, stays; a null id comes after all others),
    ``group_size``, ``kept`` (true for exactly one row of a group, repeated rows
    included), ``text_sha256`` of the normalised text. Ids may be of any type that can be ordered. Columns other than the two
    named are not read; an empty table gives an empty result. Texts of any length are handled whole.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = normalised(F.col("text"))
    narrow = materialize(
        base.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), norm.alias("norm"))
        .select("doc_id", "chars", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("print"),
                F.monotonically_increasing_id().alias("rid")), "prints")
    n = narrow.count()
    bits = min(64, max(16, math.ceil(math.log2(n + 1)) + SPARE_BITS))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // OWNER_HASHES))
    twice = duplicated_fingerprints(narrow.select("print"), bits, owners)
    cut = F.shiftrightunsigned("print", 64 - bits) if bits < 64 else F.col("print")
    suspects = materialize(narrow.withColumn("cut", cut).join(twice, "cut", "left_semi"), "suspects")

    # the suspects' texts, compared byte for byte: the text itself is the grouping key
    # (bitmaps of their ids let a few others pass, whose texts are no suspect's and meet no group)
    ids = materialize(suspects.select(F.col("doc_id").alias("suspect")).distinct(), "suspect_ids")
    texts = marked(base, F.col("doc_id"), ids).filter("__maybe")
    classes = (texts.select(norm.alias("norm")).groupBy("norm").agg(F.count("*").alias("n"))
               .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "n"))
    classes = classes.groupBy("sha").agg(F.sum("n").alias("verified"), F.count("*").alias("texts"))
    best = suspects.groupBy("sha").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("back"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
    groups = materialize(best.join(classes, "sha").select(
        "sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"),
        F.assert_true((F.col("texts") == 1) & (F.col("verified") >= F.col("group_size")),
                      F.lit("different texts share a SHA-256")).alias("checked")), "groups")
    return (narrow.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256")))
