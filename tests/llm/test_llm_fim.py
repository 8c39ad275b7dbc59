"""Fill-in-middle: the boundary set against a plain list, the operator against slicing in Python."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlab.llm.fim import BoundarySet, _Array, _Bitmap, _Runs, fill_in_middle, restored, starts

LONG = "aß€😀 x\n" * 40000
ROWS = [(1, "hello world"), (2, None), (3, ""), (4, "a<P>b" * 3), (5, "Öl ist teuer 😀 und schwarz"), (5, "another row of id 5"),
        (None, "no id"), (None, None), (6, LONG), (7, "<"), (8, "<S" * 50), (9, "x")] + [(i, f"text {i} ü" * (i % 7)) for i in range(10, 90)]


def expected(i, t, seed=1, percent=90, spm=20):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[j:j + 8], 16) for j in (0, 8, 16, 24))
    n = len(t)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < spm:
        return i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_containers_of_every_form():
    rng = np.random.default_rng(3)
    for present, form in ((np.ones(70000, bool), _Runs), (rng.random(200000) < 0.5, _Bitmap), (rng.random(200000) < 0.01, _Array),
                          (np.concatenate([np.zeros(3 << 16, bool), np.ones(5, bool)]), _Runs)):
        s = BoundarySet(present)
        assert any(isinstance(c, form) for c in s.containers)
        want = np.flatnonzero(present)
        assert len(s) == want.size
        for k in {0, 1, want.size - 1, *rng.integers(0, want.size, 300).tolist()}:
            assert s.select(k) == want[k]
        with pytest.raises(IndexError):
            s.select(want.size)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=400), st.integers(1, 200))
def test_select_is_the_kth_member(bits, times):
    present = np.repeat(np.array(bits), times)
    s = BoundarySet(present)
    assert [s.select(k) for k in range(0, len(s), 7)] == np.flatnonzero(present)[::7].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aß€😀 \n<P>S", max_size=60))
def test_units(text):
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert np.flatnonzero(starts(data)).tolist() == offsets
    for unit in ("word", "line"):
        at = np.flatnonzero(starts(data, unit)).tolist()
        assert at[0] == 0 and at[-1] == data.size and set(at) <= set(offsets)
    words = text.split()
    assert len(np.flatnonzero(starts(data, "word"))) == max(len(words), 1 if data.size else 0) + 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], "doc_id long, text string, output string, n int, form string").repartition(5)


def test_fill_in_middle_against_slicing(docs):
    out = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(((*expected(i, t), t or "") for i, t in ROWS), key=repr)
    assert got == want
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


def test_words_lines_and_other_parameters(docs):
    for unit in ("word", "line"):
        out = fill_in_middle(docs, seed=7, unit=unit, fim_percent=100, spm_percent=50)
        rows = out.withColumn("back", restored(F.col("output"), F.col("form"))).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").collect()
        by_id = {}
        for r in rows:
            by_id.setdefault(r["doc_id"], set()).add((r["back"] == (r["t"] or "")))
        assert all(True in x for x in by_id.values())
    out = fill_in_middle(docs, sentinels=("[p]", "[s]", "[m]"), fim_percent=100)
    assert {r["form"] for r in out.filter("doc_id = 4").collect()} <= {"psm", "spm"}


def test_empty_table_and_bad_parameters(docs):
    assert fill_in_middle(docs.limit(0)).collect() == []
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("", "a", "b"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="page")
