"""The oracle SQL rewrite makes DuckDB round exactly like Spark (ties included)."""

import duckdb
from pyspark.sql import functions as F

from textlab.plans.registry import spark_rounding


def test_duckdb_round_matches_spark_on_ties(spark):
    vals = sorted({k / d for d in (640, 1024, 3200, 80, 7, 3) for k in range(0, 2 * d + 1, 3)})
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE")
    got_spark = [r[0] for r in df.select(F.round("x", 6)).orderBy("x").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in vals])
    got_duck = [r[0] for r in con.execute(spark_rounding("SELECT round(x, 6) FROM t ORDER BY x")).fetchall()]
    assert got_spark == got_duck
