"""Training-log analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from textlab.operators.prefix import running_total
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
LOG_SCHEMA = "step BIGINT, loss DOUBLE, lr DOUBLE, vram_gb DOUBLE"
MOVING_WINDOW = 100
# ----------------------------------------------------------------------------


def with_place(df: DataFrame, by_time: bool = True, out: str = "ingest_seq") -> DataFrame:
    """Rows read from files with their place in the log: (file time, file name, start of the block, row in the block).

    Spark reads large files first and packs blocks of several files into one task, so a plain row number does not follow the files. The rows
    of one block are read by one task in their order, so the number only has to order those. With ``by_time`` false files
    go by name alone, as the parts of one write do.
    """
    meta = df.metadataColumn("_metadata")
    time = [meta["file_modification_time"].alias("time")] if by_time else []
    return df.select("*", F.struct(*time, meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
                                   F.monotonically_increasing_id().alias("row")).alias(out))


def read_train_log(spark: SparkSession, path: str, by_time: bool = True, schema: str = LOG_SCHEMA) -> DataFrame:
    """Header CSV ``step,loss,lr,vram_gb`` with an explicit schema (and partition columns from folder names); ``ingest_seq`` is the
    row's place in the log (see ``with_place``), which orders re-run steps."""
    return with_place(spark.read.schema(schema).option("header", True).csv(path), by_time)


def write_train_log(df: DataFrame, path: str, order_col: str, run_col: str, files: int) -> None:
    """A log as header CSVs in a folder for each run, its rows in ``order_col`` order over the names of the files."""
    (df.repartitionByRange(files, order_col).sortWithinPartitions(run_col, order_col).drop(order_col)
     .write.partitionBy(run_col).option("header", True).mode("overwrite").csv(path))


def keep_last(df: DataFrame, key_cols, seq_col: str = "ingest_seq") -> DataFrame:
    """The last-ingested row per key (re-run steps after a resume).

    An aggregation with ``max_by`` (partial aggregation map-side), not a
    sorted window.
    """
    keys = list(key_cols)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq_col)).alias("__last"))
    return agg.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def moving_avg(df: DataFrame, value_col: str, order_col: str = "step", run_cols=("run",),
               window: int = MOVING_WINDOW, out: str = "loss_avg") -> DataFrame:
    """Mean of the last ``window`` values (fewer at the start), per run.

    Expressed without a per-run window (a run may hold a large share of all
    rows): exact DECIMAL prefix sums S and row numbers i per run come from the
    two-phase prefix sum, and ``S(i - window)`` is fetched by an equi-join on
    ``(run, i)``; the difference is divided by that of the running counts of
    non-NULL values, so a NULL neither adds to the sum nor to the divisor.
    """
    runs = list(run_cols)
    d = df.withColumn("__x", F.col(value_col).cast("decimal(38,18)")).withColumn("__one", F.lit(1))
    d = d.withColumn("__has", F.col(value_col).isNotNull().cast("int"))
    d = running_total(d, [*runs, order_col], ["__x", "__one", "__has"], group_cols=runs, out=["__S", "__i", "__n"])
    lag = d.select(*runs, (F.col("__i") + window).alias("__i"), F.col("__S").alias("__S_lag"), F.col("__n").alias("__n_lag"))
    j = d.join(lag, [*runs, "__i"], "left")
    n = F.col("__n") - F.coalesce(F.col("__n_lag"), F.lit(0))
    avg = F.try_divide(F.col("__S") - F.coalesce(F.col("__S_lag"), F.lit(0)), n).cast("double")
    return j.withColumn(out, avg).drop("__x", "__one", "__has", "__S", "__i", "__n", "__S_lag", "__n_lag")


def position_in_run(df: DataFrame, order_col: str = "step", run_cols=("run",), out: str = "pos") -> DataFrame:
    """1-based position in ``order_col`` order per run (two-phase prefix sum)."""
    from textlab.operators.prefix import global_row_number
    runs = list(run_cols)
    return global_row_number(df, [*runs, order_col], group_cols=runs, out=out)


def lr_factor(step: Column, total: Column, warmup: Column) -> Column:
    """Linear warm-up to 1, then linear decay to 0 (never negative)."""
    s, t, w = step.cast("double"), total.cast("double"), warmup.cast("double")
    return (F.when(s < w, F.try_divide(s, w))
            .otherwise(F.greatest(F.lit(0.0), F.try_divide(t - s, t - w))))
