"""Row numbers and filters by row, for stages that decide about single rows of a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import materialize

BUCKET = 1 << 15                # bits of a bitmap
BITS_PER_ROW = 16
MAX_BUCKETS = 1 << 14           # 64 MB of bitmaps at most


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that tells its rows apart and stays the same whenever they are read: a digest of
    a row's file and place in it. Rows that do not come straight from files are written first."""
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select("*", F.unhex(F.md5(F.concat_ws(":", meta["file_path"], meta["row_index"].cast("string")))).alias(name))
    except AnalysisException:
        return materialize(docs.withColumn(name, F.unhex(F.md5(F.monotonically_increasing_id().cast("string")))), "numbered")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def marked(docs: DataFrame, key: F.Column, keys: DataFrame, name: str = "__maybe") -> DataFrame:
    """``docs`` with a boolean column ``name``: false where ``key`` surely is not in the one column of ``keys`` (a written table).

    The test is a table of bitmaps of the hashes of ``keys``, about 16 bits a key and 64 MB at most.
    """
    n, buckets = keys.count(), 1
    while buckets < MAX_BUCKETS and buckets * BUCKET < n * BITS_PER_ROW:
        buckets *= 2

    def at(value):
        return F.pmod(F.xxhash64(value), F.lit(buckets * BUCKET))

    own = F.col(keys.columns[0])
    maps = materialize(keys.select(F.shiftright(at(own), 15).alias("__bucket"), F.pmod(at(own), F.lit(BUCKET)).alias("bit"))
                       .groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__map")), "bitmaps")
    tested = docs.select("*", at(key).alias("__at")).withColumn("__bucket", F.shiftright("__at", 15)).join(F.broadcast(maps), "__bucket", "left")
    bit = F.pmod(F.col("__at"), F.lit(BUCKET))
    byte = F.conv(F.hex(F.substring(F.col("__map"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return tested.select(*[F.col(c) for c in docs.columns], (F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")), F.lit(0)) == 1).alias(name))


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose number (column ``name``) is not in the one column of ``gone``.

    Rows that surely stay pass without a shuffle; the others (those that go, and a few) are compared by number.
    """
    gone = materialize(gone.toDF("__gone").distinct(), "gone")
    tested = marked(docs, F.col(name), gone)
    rest = tested.filter("__maybe").drop("__maybe")
    return tested.filter("not __maybe").drop("__maybe").unionByName(rest.join(gone, rest[name] == F.col("__gone"), "left_anti"))
