"""Readers and writers: multi-line CSV splits, log CSV order, token-count appends, vocab text."""

import os
import tempfile

from textlab.operators import trainlog as TL
from textlab.operators.tokenizers.vocab import read_vocab_text, write_vocab_text
from textlab.sources import io as IO


def test_read_csv_splits_multiline(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    paths = {}
    for split in ("train", "validation", "test"):
        p = os.path.join(d, f"{split}.csv")
        with open(p, "w") as f:
            f.write('id,article,highlights\n')
            f.write(f'a1,"First line\nsecond, with comma and ""quote""","hl {split}"\n')
            f.write('a2,plain,"x\ny"\n')
        paths[split] = p
    df = IO.read_csv_splits(spark, paths)
    rows = sorted((r["split"], r["article"], r["highlights"]) for r in df.collect())
    assert len(rows) == 6
    assert ("test", 'First line\nsecond, with comma and "quote"', "hl test") in rows
    assert set(df.columns) == {"article", "highlights", "split"}


def test_read_train_log_keeps_file_order(spark):
    d = tempfile.mkdtemp(prefix="log-")
    p = os.path.join(d, "log.csv")
    with open(p, "w") as f:
        f.write("step,loss,lr,vram_gb\n")
        for i, (s, l) in enumerate([(1, 5.0), (2, 4.0), (1, 3.0)]):
            f.write(f"{s},{l},0.001,1.5\n")
    df = TL.read_train_log(spark, p)
    last = {r["step"]: r["loss"] for r in TL.keep_last(df, ["step"]).collect()}
    assert last == {1: 3.0, 2: 4.0}


def test_append_token_count(spark):
    d = tempfile.mkdtemp(prefix="tc-")
    p = os.path.join(d, "counts")
    IO.append_token_count(spark, p, "word", 10)
    IO.append_token_count(spark, p, "char", 20)
    got = sorted((r["tokenizer"], r["token_count"]) for r in IO.read_token_counts(spark, p).collect())
    assert got == [("char", 20), ("word", 10)]


def test_vocab_text_round_trip(spark):
    v = spark.createDataFrame([(0, "<pad>", 0.0), (1, "<unk>", 0.0), (2, "▁a", -1.5), (3, "b", -2.25)],
                              "id INT, piece STRING, score DOUBLE")
    d = os.path.join(tempfile.mkdtemp(prefix="voc-"), "v")
    write_vocab_text(v, d)
    back = sorted(tuple(r) for r in read_vocab_text(spark, d).collect())
    assert back == sorted(tuple(r) for r in v.collect())


def test_read_splits_parquet_fast_path(spark):
    d = tempfile.mkdtemp(prefix="pq-")
    paths = {}
    for split in ("train", "test"):
        p = os.path.join(d, f"{split}.parquet")
        spark.createDataFrame([("x1", f"a {split}", "h")], "id STRING, article STRING, highlights STRING") \
            .write.parquet(p)
        paths[split] = p
    df = IO.read_splits(spark, paths)
    assert sorted((r["split"], r["article"]) for r in df.collect()) == [("test", "a test"), ("train", "a train")]
