"""Training-log operators (batch and streaming) against plain-Python references."""

import os
import time

from pyspark.sql import functions as F

from textlab.operators import trainlog as TL
from textlab.streaming import trainlog as ST


def test_keep_last_and_moving_avg(spark):
    rows = [(0, 1, 5.0, 0), (0, 2, 4.0, 1), (0, 1, 3.0, 2), (0, 3, 2.0, 3), (1, 1, 9.0, 4)]
    df = spark.createDataFrame(rows, "run INT, step INT, loss DOUBLE, ingest_seq INT")
    last = {(r["run"], r["step"]): r["loss"] for r in TL.keep_last(df, ["run", "step"]).collect()}
    assert last == {(0, 1): 3.0, (0, 2): 4.0, (0, 3): 2.0, (1, 1): 9.0}
    ma = TL.moving_avg(TL.keep_last(df, ["run", "step"]), "loss", window=2).orderBy("run", "step").collect()
    assert [round(r["loss_avg"], 9) for r in ma] == [3.0, 3.5, 3.0, 9.0]


def test_lr_factor(spark):
    df = spark.range(0, 12).select(F.col("id").alias("step"))
    got = [r[0] for r in df.select(TL.lr_factor(F.col("step"), F.lit(10), F.lit(2))).orderBy("step").collect()]
    exp = [s / 2 if s < 2 else max(0, (10 - s) / 8) for s in range(12)]
    assert got == exp


HEAD = "step,loss,lr,vram_gb\n"


def write(path, rows):
    path.write_text(HEAD + "".join(f"{s},{x},0.1,1.0\n" for s, x in rows))


def test_log_reader_keeps_the_order_of_files(spark, tmp_path):
    """File b is the largest, so Spark reads it first; c is the last one, and its rows win."""
    write(tmp_path / "a.csv", [(1, 5.0), (2, 4.0), (2, 4.5)])
    write(tmp_path / "b.csv", [(s, 100.0 + s) for s in range(1, 4000)])
    write(tmp_path / "c.csv", [(2, 3.5), (3, 3.0)])
    for i, name in enumerate("abc"):
        os.utime(tmp_path / f"{name}.csv", (1_700_000_000 + i, 1_700_000_000 + i))
    last = {r["step"]: r["loss"] for r in TL.keep_last(TL.read_train_log(spark, str(tmp_path)), ["step"]).collect()}
    assert (last[1], last[2], last[3], last[4]) == (101.0, 3.5, 3.0, 104.0) and len(last) == 3999
    # the file time decides, unless the names do
    os.utime(tmp_path / "a.csv", (1_800_000_000, 1_800_000_000))
    last = {r["step"]: r["loss"] for r in TL.keep_last(TL.read_train_log(spark, str(tmp_path)), ["step"]).collect()}
    assert (last[1], last[2], last[3]) == (5.0, 4.5, 3.0)
    last = {r["step"]: r["loss"] for r in TL.keep_last(TL.read_train_log(spark, str(tmp_path), by_time=False), ["step"]).collect()}
    assert (last[1], last[2], last[3]) == (101.0, 3.5, 3.0)


def test_written_log_reads_back_in_order(spark, tmp_path):
    rows = [(i, i % 3, i % 7, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, run int, step long, loss double").repartition(5)
    TL.write_train_log(df, str(tmp_path / "log"), "seq", "run", 4)
    back = TL.read_train_log(spark, str(tmp_path / "log"), by_time=False, schema="step BIGINT, loss DOUBLE")
    got = {}
    for r in back.orderBy("run", "ingest_seq").collect():
        got.setdefault(r["run"], []).append((r["step"], r["loss"]))
    assert got == {k: [(s, x) for _, run, s, x in rows if run == k] for k in range(3)}


def test_stream_stops_and_goes_on(spark, tmp_path):
    log, table, checkpoint = tmp_path / "log", str(tmp_path / "last"), str(tmp_path / "checkpoint")
    log.mkdir()

    def run():
        q = ST.keep_last_stream(ST.read_log_stream(spark, str(log), 1), table, checkpoint)
        assert q.exception() is None and not q.isActive
        return sum(p["numInputRows"] for p in q.recentProgress), {r["step"]: r["loss"] for r in ST.read_last(spark, table).collect()}

    write(log / "a.csv", [(1, 5.0), (2, 4.0), (250_000, 1.0)])
    time.sleep(1.1)
    write(log / "b.csv", [(2, 3.5), (3, 3.0), (3, 2.9)])            # a resumed run logs step 2 again
    n, got = run()
    assert n == 6 and got == {1: 5.0, 2: 3.5, 3: 2.9, 250_000: 1.0}
    time.sleep(1.1)
    write(log / "c.csv", [(3, 2.5), (4, 2.0)])
    n, got = run()                                                   # a new query on the old checkpoint reads the new file only
    assert n == 2 and got == {1: 5.0, 2: 3.5, 3: 2.5, 4: 2.0, 250_000: 1.0}
    n, got = run()
    assert n == 0 and len(got) == 5


def test_merging_a_batch_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "last")
    df = spark.createDataFrame([(0, 1, 5.0, 3), (0, 1, 6.0, 4), (1, 1, 7.0, 1)], "run int, step long, loss double, ingest_seq int")
    for _ in range(2):
        ST.upsert_last(df, path, ["run", "step"], "step")
        assert sorted((r["run"], r["loss"]) for r in ST.read_last(spark, path).collect()) == [(0, 6.0), (1, 7.0)]
    ST.upsert_last(df.where("ingest_seq = 3"), path, ["run", "step"], "step")          # an older row does not win
    assert sorted((r["run"], r["loss"]) for r in ST.read_last(spark, path).collect()) == [(0, 6.0), (1, 7.0)]


def test_sample_is_the_rows_of_smallest_hash(spark):
    import hashlib

    from textlab.operators.selection import sample_rows
    df = spark.range(5000).selectExpr("id", "id % 7 as x").repartition(6)
    order = sorted(range(5000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    for n in (0, 1, 10, 777, 4999, 5000, 9000):
        assert sorted(r["id"] for r in sample_rows(df, "id", n).collect()) == sorted(order[:n])
    same = spark.range(300).selectExpr("cast(1 as long) as id", "id as x")             # one key for all rows
    assert sample_rows(same, "id", 120).count() == 120
    assert sample_rows(df.limit(0), "id", 5).collect() == []
