"""Distributed running totals and row numbers without a single-partition window.

A plain ``sum(x) over (order by k)`` moves every row into one task. Here the
rows are range-partitioned on the ordering key, checkpointed so that the
partition of every row stays fixed if a task is re-run, and the running total
is assembled from a per-partition window plus the sum of all earlier
partitions (a table with one row per partition and group, broadcast back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import materialize


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))


def range_checkpoint(df: DataFrame, order_cols, partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order_cols`` and tag each row with its partition id ``__pid``.

    The tagged rows are written to shared storage once, so the id of every
    row is fixed data from then on (a re-run task cannot move a row to a
    different range partition).
    """
    n = _partitions(df, partitions)
    ranged = df.repartitionByRange(n, *order_cols).withColumn("__pid", F.spark_partition_id())
    return materialize(ranged, "ranged")


def running_total(df: DataFrame, order_cols, value_col, group_cols=(), out="cum",
                  partitions: int | None = None, inclusive: bool = True) -> DataFrame:
    """Running sum(s) of ``value_col`` (a name or a list) in ``order_cols`` order,
    restarting per ``group_cols``; ``out`` names the result column(s).

    ``order_cols`` must start with ``group_cols`` and identify rows uniquely
    (ties would make the running total order-dependent).
    """
    vals = [value_col] if isinstance(value_col, str) else list(value_col)
    outs = [out] if isinstance(out, str) else list(out)
    gcols = list(group_cols)
    ranged = range_checkpoint(df, order_cols, partitions)
    frame_end = 0 if inclusive else -1
    local_w = (Window.partitionBy("__pid", *gcols).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, frame_end))
    local = ranged
    for i, v in enumerate(vals):
        local = local.withColumn(f"__local{i}", F.coalesce(F.sum(v).over(local_w), F.lit(0)))
    tot = ranged.groupBy("__pid", *gcols).agg(*[F.sum(v).alias(f"__ptot{i}") for i, v in enumerate(vals)])
    off_w = Window.partitionBy(*gcols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (partition, group): bounded by partitions x groups
    off = tot.select("__pid", *gcols, *[F.coalesce(F.sum(f"__ptot{i}").over(off_w), F.lit(0)).alias(f"__off{i}")
                                        for i in range(len(vals))])
    res = local.join(F.broadcast(off), ["__pid", *gcols])
    for i, o in enumerate(outs):
        res = res.withColumn(o, F.col(f"__local{i}") + F.col(f"__off{i}"))
    drop = [f"__local{i}" for i in range(len(vals))] + [f"__off{i}" for i in range(len(vals))] + ["__pid"]
    return res.drop(*drop)


def global_row_number(df: DataFrame, order_cols, group_cols=(), out: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """1-based row number in ``order_cols`` order (per group), computed without a single-task window."""
    one = df.withColumn("__one", F.lit(1))
    res = running_total(one, order_cols, "__one", group_cols, out=out, partitions=partitions)
    return res.drop("__one")
