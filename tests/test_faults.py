"""Cases that once gave wrong results."""

import pytest

from textlab.operators.trainlog import moving_avg
from textlab.session import ensure_checkpoint_dir
from textlab.sources import io


def test_moving_average_skips_null_losses(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, 3.0), (2, 1, None)], "run INT, step INT, loss DOUBLE")
    got = {(r.run, r.step): r.loss_avg for r in moving_avg(df, "loss", window=100).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): 2.0, (2, 1): None}


def test_token_counts_survive_other_errors(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "counts")
    io.append_token_count(spark, path, "word", 5)
    real = type(spark.read).parquet

    def fails(self, *a, **k):
        raise OSError("storage is away")
    monkeypatch.setattr(type(spark.read), "parquet", fails)
    with pytest.raises(OSError):
        io.append_token_count(spark, path, "word", 6)
    monkeypatch.setattr(type(spark.read), "parquet", real)
    io.append_token_count(spark, path, "word", 7)
    assert sorted(r.token_count for r in io.read_token_counts(spark, path).collect()) == [5, 7]


def test_no_private_scratch_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
