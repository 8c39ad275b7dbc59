"""Mixing sources to target weights by hash thresholds.

A document's place in its source is fixed by a hash of its id. Tokens are summed by source
and leading hash digits; the bucket in which a source's budget ends is the only one that is
looked at again, two digits deeper each time, until it is a single hash. Documents below the
threshold are taken, so the selection for a smaller budget lies inside that for a larger one,
nothing is sorted, and a rerun takes the same documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators.prefix import global_row_number
from textlab.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 2                  # hash digits per level: 256 buckets
HASH_DIGITS = 32


def word_count(text) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_col, text_col) -> F.Column:
    """32 hash digits that place a document in its source; a document without id is placed by its text."""
    return F.md5(F.coalesce(F.concat(F.lit("i"), id_col.cast("string")),
                            F.concat(F.lit("t"), F.coalesce(text_col, F.lit("")))))


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Token targets of the sources in ``sizes`` (source, source_size): sources in code point
    order, null last, have the given weights, repeating, of ``share`` times all tokens; a target
    stops at ``most`` times its source, and the excess goes to the others by weight until none is above.

    The sources stay a distributed table; a round sums it up into one row. Sources without
    tokens have target 0."""
    w = F.lit(float(weights[-1]))
    for i, x in enumerate(weights[:-1]):
        w = F.when((F.col("rn") - 1) % len(weights) == i, F.lit(float(x))).otherwise(w)
    table = materialize(global_row_number(sizes, [F.col("source").asc_nulls_last()])
                        .select("source", "source_size", w.alias("weight"),
                                (F.col("source_size") * F.lit(most)).alias("cap")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate, full = None, None
    while True:
        capped = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > F.col("cap")
        r = table.agg(F.sum(F.when(capped, F.col("cap")).otherwise(F.lit(0.0))),
                      F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("weight"))),
                      F.sum(capped.cast("long"))).first()
        if not r[1] or r[2] == full:
            break
        full, rate = r[2], max(0.0, share * total - r[0]) / r[1]
    rate = 0.0 if rate is None else rate
    return table.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(rate)).alias("target"))


def thresholds(narrow: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source: ``base`` whole copies of every document and the hash ``edge`` up to which
    documents get one more; the document at the edge gets it if that is nearer the target.

    ``narrow`` has source, size, h. One row per source."""
    left = goal.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("base"))
    edge = left.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")).withColumn("edge", F.lit(""))
    cand = narrow
    for level in range(DIGITS, HASH_DIGITS + 1, DIGITS):
        here = cand.alias("c").join(
            edge.alias("e"),
            F.col("c.source").eqNullSafe(F.col("e.source")) & (F.substring("c.h", 1, level - DIGITS) == F.col("e.edge")))
        hist = here.groupBy(F.col("e.source").alias("source"), F.col("e.edge").alias("edge"), F.col("e.rest").alias("rest"),
                            F.substring("c.h", 1, level).alias("bucket")).agg(
            F.sum("c.size").alias("s"), F.min("c.h").alias("lo"), F.max("c.h").alias("hi"))
        w = Window.partitionBy("source").orderBy("bucket")          # at most 256 rows a source
        hist = (hist.withColumn("before", F.sum("s").over(w) - F.col("s"))
                .withColumn("last", F.lead("bucket").over(w).isNull()))
        found = hist.filter((F.col("before") <= F.col("rest")) & ((F.col("before") + F.col("s") > F.col("rest")) | F.col("last")))
        found = found.groupBy("source").agg(F.max_by(
            F.struct("bucket", "before", "lo", "hi", "s"), "bucket").alias("f"), F.first("rest").alias("rest"))
        edge = materialize(found.select(
            "source", F.col("f.bucket").alias("edge"), (F.col("rest") - F.col("f.before")).alias("rest"),
            (F.col("f.lo") == F.col("f.hi")).alias("single"), F.col("f.s").alias("s"), F.col("f.hi").alias("hi")), "edge")
        if not edge.filter(~F.col("single")).head(1):
            break
        cand = materialize(cand.alias("c").join(
            edge.alias("e"), F.col("c.source").eqNullSafe(F.col("e.source")) & (F.substring("c.h", 1, level) == F.col("e.edge")),
            "left_semi"), "boundary")
    edge = edge.select(F.col("source").alias("edge_source"), F.col("hi").alias("edge"),
                       (F.col("s") <= 2 * F.col("rest")).alias("take_edge"))
    return left.join(edge, left["source"].eqNullSafe(edge["edge_source"]), "left").drop("edge_source")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often every document is taken.

    Returns one row per input row: ``doc_id``, ``source``, ``size`` (words; null text: 0),
    ``source_size``, ``target`` of its source, ``copies`` and ``taken`` = copies x size. No
    document is taken more than ``most`` times. Rows of one source that share an id are taken or
    left together. Null sources are a source of their own, the last. An empty table gives an empty result.
    """
    narrow = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        place(F.col(id_col), F.col(text_col)).alias("h")), "sizes")
    t = _plan(narrow, weights, share, most)
    return (narrow.join(t, narrow["source"].eqNullSafe(t["t_source"])).withColumn("copies", _copies(F.col("h"), most))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def _plan(narrow: DataFrame, weights, share: float, most: float) -> DataFrame:
    """One row for every source (column t_source) of ``narrow`` (source, size, h): its size, target and thresholds."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    return materialize(thresholds(narrow, targets(sizes, weights, share, most)), "thresholds").withColumnRenamed("source", "t_source")


def _copies(h, most: float) -> F.Column:
    """How often the thresholds take a row of place ``h``."""
    more = (F.col("base") < F.lit(int(most))) & (F.coalesce(h < F.col("edge"), F.lit(False)) | F.coalesce((h == F.col("edge")) & F.col("take_edge"), F.lit(False)))
    return F.col("base") + more.cast("long")


def mixture(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it: a filter by the thresholds of the row's source, which needs
    no list of ids. Columns stay as they are."""
    narrow = materialize(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                                     place(F.col(id_col), F.col(text_col)).alias("h")), "sizes")
    t = _plan(narrow, weights, share, most).select("t_source", "base", "edge", "take_edge")
    t = t.select(*[F.col(c).alias(f"__{c}") for c in t.columns])
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__docs_row")
    taken = docs.select(row, docs[source_col].alias("__source"), place(docs[id_col], docs[text_col]).alias("__h")).join(
        t, F.col("__source").eqNullSafe(F.col("__t_source")))
    taken = taken.select("__docs_row", F.col("__h").alias("h"), *[F.col(f"__{c}").alias(c) for c in ("base", "edge", "take_edge")])
    return taken.withColumn("copies", _copies(F.col("h"), most).cast("int")).filter("copies > 0").select(
        "__docs_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__docs_row.*")
