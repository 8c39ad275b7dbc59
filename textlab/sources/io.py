"""Readers and writers (S1-S4, S6, S7 text form)."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SPLIT_SCHEMA = "id STRING, article STRING, highlights STRING"
TOKEN_COUNT_SCHEMA = "tokenizer STRING, run_ts TIMESTAMP, token_count BIGINT"
# ----------------------------------------------------------------------------


def read_csv_splits(spark: SparkSession, paths: dict[str, str], schema: str = SPLIT_SCHEMA) -> DataFrame:
    """Header CSVs with quoted multi-line text, one per split, as one frame tagged ``split``.

    The schema is explicit (never inferred); the id column is dropped.
    """
    frames = []
    for split, path in paths.items():
        df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
              .option("escape", '"').option("quote", '"').csv(path))
        frames.append(df.drop("id").withColumn("split", F.lit(split)))
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str = SPLIT_SCHEMA) -> DataFrame:
    """S1 with a Parquet fast path: ``.parquet`` inputs are read columnar (projection
    and filters reach the reader), anything else as quoted multi-line CSV."""
    if all(str(p).rstrip("/").endswith(".parquet") for p in paths.values()):
        frames = [spark.read.parquet(p).select("article", "highlights").withColumn("split", F.lit(s))
                  for s, p in paths.items()]
        return reduce(lambda a, b: a.unionByName(b), frames)
    return read_csv_splits(spark, paths, schema)


def write_processed(df: DataFrame, path: str, cols=("cleaned_text", "highlights"), fmt: str = "parquet") -> None:
    """Project to the text columns (no ids) and write."""
    w = df.select(*cols).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_stats_json(report: DataFrame, path: str) -> None:
    """S3: a one-row nested statistics document as JSON (one small file)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_describe_csv(stats: DataFrame, path: str) -> None:
    """A small describe table as one CSV with header (row labels kept as a column)."""
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: What Spark says of a path that is not there, and of a file that is not Parquet.
UNREADABLE = ("PATH_NOT_FOUND", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def append_token_count(spark: SparkSession, path: str, tokenizer: str, token_count: int,
                       run_ts: _dt.datetime | None = None) -> None:
    """Append a labelled token-count record. A missing table is started, a corrupt one replaced; any
    other failure to read it is raised, so that a short storage error does not cost the history."""
    ts = run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    row = spark.createDataFrame([(tokenizer, ts, int(token_count))], TOKEN_COUNT_SCHEMA)
    mode = "append"
    try:
        spark.read.schema(TOKEN_COUNT_SCHEMA).parquet(path).limit(1).collect()
    except Exception as e:
        if not any(x in str(e) for x in UNREADABLE):
            raise
        mode = "overwrite"
    row.write.mode(mode).parquet(path)


def read_token_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_COUNT_SCHEMA).parquet(path)
