"""Approximate neighbours: exact on small tables at full recall, recall against brute force elsewhere, balanced lists, graph walk."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from textlab.llm import ann
from textlab.llm.ann import balanced_lists, fit, nearest, postings, proximity_graph, walk


def brute(rows, k, every):
    live = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(live):
        if i % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(live) if b != a and len(w) == len(v))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def small_rows():
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(6)]) for i in range(260)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, -1.0, 3.0, 1.0]) for i in range(90)]                 # a vector with a third of all rows
    rows += [(40, [5.0, 5.0, 5.0, 5.0, 5.0, 5.0]), (40, [5.0, 5.0, 5.0, 5.0, 5.0, 5.0]), (41, [0.5] * 6), (40, [9.0] * 6)]
    rows += [(60, [1.0, 2.0]), (61, [2.0, 1.0]), (62, [3.0, -1.0]), (80, [4.0])]
    rows += [(100, None), (120, []), (140, [0.0] * 6), (160, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (180, [math.nan] + [1.0] * 5),
             (200, [math.inf] + [1.0] * 5), (None, [1.0] * 6), (220, [None] * 6)]
    return rows


@pytest.mark.parametrize("element", ["float", "double"])
def test_small_table_against_brute_force(spark, element):
    rows = small_rows()
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], f"vec_id long, embedding array<{element}>, key int, score string, dim int").repartition(5)
    got = sorted(tuple(r) for r in nearest(df, k=5, every=20, recall=1.0).collect())
    assert got == brute(rows, 5, 20)


def test_fewer_candidates_than_wanted_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in nearest(df, k=20, every=20).collect())
    assert got == [(0, 1, 21, 1.0), (0, 2, 20, 0.0), (20, 1, 21, 1.0), (20, 2, 0, 0.0)]
    assert nearest(df.limit(1), k=20).collect() == []
    assert nearest(df.limit(0), k=20).collect() == []


def test_recall_on_vectors_of_many_norms(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))) * rng.lognormal(0, 0.5, size=(1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest(df).collect()}
    want = {(q, int(j)) for q in range(0, 1500, 20) for j in np.argsort(np.where(np.arange(1500) == q, np.inf, -(x @ x[q])))[:20]}
    assert len(got) == len(want) and len(want & set(got)) >= 0.9 * len(want)
    assert all(s == pytest.approx(float(x[q] @ x[j]), rel=1e-12) for (q, j), s in got.items())


def test_lists_are_balanced_and_the_walk_finds_them():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(3000, 12)), 0.01 * rng.normal(size=(1000, 12)) + 2]).astype(np.float32)    # a dense quarter
    parts = balanced_lists(x, 200)
    assert sorted(np.concatenate(parts).tolist()) == list(range(4000)) and max(p.size for p in parts) <= 20
    c = np.stack([x[p].mean(axis=0) for p in parts])
    model = {"c": c, "norm": np.square(c).sum(axis=1), "graph": proximity_graph(c)}
    at, d = walk(model, x[::10], 48)
    far = np.sqrt(np.square(x[::10][:, None] - c).sum(axis=2))
    assert np.mean(at[:, 0] == far.argmin(axis=1)) > 0.97 and (np.diff(d, axis=1) >= 0).all()
    assert np.allclose(np.take_along_axis(far, at, 1), d, atol=1e-2)


def test_boundary_vectors_are_replicated_and_the_ratio_prunes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16))
    top = float(np.sqrt(np.square(x).sum(axis=1)).max())
    model = fit(x, top, 4000, 10, 0.9, 4, 0.15, 8)
    up = np.hstack([x, np.sqrt(top * top - np.square(x).sum(axis=1))[:, None]]).astype(np.float32)
    held = postings(model, up[:500], 4, 0.15)
    assert (held[:, 0] >= 0).all() and 1.2 < (held >= 0).sum(axis=1).mean() <= 4
    assert np.isfinite(model["ratio"]) and model["beam"] < len(model["radius"])


def test_a_cell_holds_the_hits_of_a_few_queries_at_once(monkeypatch):
    rng, k, lists = np.random.default_rng(5), 4, 30
    x, q = (rng.integers(-3, 4, (n, 8)).astype("<f4") for n in (lists * 20, 2000))             # many equal scores
    posts = [sorted({i % lists, (7 * i) % lists}) for i in range(len(x))]
    cand = pa.table({"key": pa.array([b"c%05d" % i for i in range(len(x))]), "lists": pa.array(posts, pa.list_(pa.int32())), "vec": pa.array([v.tobytes() for v in x]),
                     "members": pa.array([[{"vec_id": 3 * i, "rid": i}] for i in range(len(x))], ann._MEMBERS)})
    asked = pa.table({"key": pa.array([b"q%05d" % i for i in range(len(q))]), "vec": pa.array([v.tobytes() for v in q]),
                      "lists": pa.array([list(range(lists)) if i % 10 else [i % lists] for i in range(len(q))], pa.list_(pa.int32()))})
    most, cut = [0], ann._cut

    def counted(i, *rest):
        most[0] = max(most[0], len(i))
        return cut(i, *rest)
    monkeypatch.setattr(ann, "_cut", counted)
    monkeypatch.setattr(ann, "HITS", 2000, raising=False)
    monkeypatch.setattr(ann, "ASKED_AT_ONCE", 100, raising=False)
    out = ann._cell("<f4", k)(cand, asked)
    assert most[0] < 2000 + 100 * lists * (k + 1)                                               # all at once: 270,000
    assert max(b.num_rows for b in out.to_batches()) <= 100 * (k + 1)
    want = []
    for i, v in enumerate(q):
        seen = [j for j in range(len(x)) if i % 10 or i % lists in posts[j]]
        best = sorted((-float(v.astype(float) @ x[j].astype(float)), 3 * j) for j in seen)[:k + 1]
        want += [(b"q%05d" % i, b"c%05d" % (j // 3), -s) for s, j in best]
    assert sorted(zip(*(out.column(c).to_pylist() for c in ("key", "near", "score")))) == sorted(want)
