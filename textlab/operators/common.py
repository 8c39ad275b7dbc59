"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, small: DataFrame) -> DataFrame:
    """Attach the columns of ``small`` -- a frame with a known, tiny row count
    (one statistics row, a fixed bin grid) -- to every row of ``df``.

    Expressed as a broadcast equi-join on a constant key; ``small`` must be
    bounded by construction (never a data-sized table).
    """
    k = "__attach_key"
    return (df.withColumn(k, F.lit(0))
            .join(F.broadcast(small.withColumn(k, F.lit(0))), k)
            .drop(k))


def r6(c, digits: int = 6):
    """Round a DOUBLE for cross-engine comparison."""
    return F.round(c, digits)
