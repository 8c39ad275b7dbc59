"""Structured Streaming counterpart of the append-only training log.

The log grows while training runs (one CSV row per step, re-run steps after
a resume appended later). The stream keeps the last row per key in a table in the shared folder: every micro-batch is reduced to
its own last rows and merged into the parts of the table that it touches, a part being a range of steps. The table is the
state, so nothing is held in the driver or in a state store, and a merge may run twice without harm (a restart from the
checkpoint repeats at most the last one). The moving average (W3) is a batch window over that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlab.operators.trainlog import LOG_SCHEMA, keep_last
from textlab.session import materialize, release

STEPS_PER_PART = 100_000
PART = "part"


def read_log_stream(spark: SparkSession, log_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """CSV log files as a stream, in order of file time. ``ingest_seq`` (file time, name, start of the block) orders re-runs of different files."""
    r = spark.readStream.schema(LOG_SCHEMA).option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.csv(log_dir)
    return s.select("*", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
                                  F.col("_metadata.file_block_start").alias("block")).alias("ingest_seq"))


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``; empty where nothing has been written yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert_last(batch: DataFrame, path: str, key_cols, step_col: str, seq_col: str = "ingest_seq") -> None:
    """Merge a micro-batch into the table at ``path``: the last row of every key stays. Only the parts that the batch touches are
    written; running it again with the same batch changes nothing."""
    spark, keys = batch.sparkSession, list(key_cols)
    # rows of one block follow each other; a later one is a later row of the log
    ordered = batch.withColumn("__row", F.monotonically_increasing_id()).withColumn(seq_col, F.struct(seq_col, "__row")).drop("__row")
    last = keep_last(ordered, keys, seq_col).withColumn(seq_col, F.col(f"{seq_col}.{seq_col}"))
    last = materialize(last.select(*batch.columns, F.floor(F.col(step_col) / STEPS_PER_PART).cast("long").alias(PART)), "batch")
    old = _table(spark, path, last.schema).join(F.broadcast(last.select(PART).distinct()), PART, "left_semi").select(*last.columns)    # a row for a range of steps
    # a key's row of the batch wins over an equal place in the table: the batch is the later one
    both = old.withColumn("__new", F.lit(0)).unionByName(last.withColumn("__new", F.lit(1))).withColumn("__at", F.struct(seq_col, "__new"))
    merged = materialize(keep_last(both, keys, "__at").select(*last.columns), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    release(last, merged)


def keep_last_stream(stream: DataFrame, path: str, checkpoint: str, key_cols=("step",), step_col: str = "step", seq_col: str = "ingest_seq",
                     available_now: bool = True) -> StreamingQuery:
    """W1 on a stream: keep the table at ``path`` at the last row per key. ``checkpoint`` (in the shared folder) is where a
    stopped query goes on; with ``available_now`` it takes what is there and stops."""
    w = stream.writeStream.foreachBatch(lambda batch, _: upsert_last(batch, path, key_cols, step_col, seq_col)).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    if available_now:
        q.awaitTermination()
    return q


def read_last(spark: SparkSession, path: str) -> DataFrame:
    """The table of last rows."""
    return spark.read.parquet(path).drop(PART)
