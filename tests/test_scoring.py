"""Scoring: brute-force references and properties."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlab.functions.stem import stem
from textlab.operators import scoring as SC


def lcs_dp(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = m[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(m[i - 1][j], m[i][j - 1])
    return m[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=30), st.lists(st.sampled_from("abcde"), max_size=30))
def test_lcs_bitparallel_equals_dp(a, b):
    assert SC.lcs_length(a, b) == lcs_dp(a, b)


def test_porter_known_stems():
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file",
             "happy": "happi", "relational": "relat", "conditional": "condit", "rational": "ration",
             "generalization": "gener", "hopeful": "hope", "goodness": "good", "revival": "reviv",
             "adjustment": "adjust", "adoption": "adopt", "controll": "control", "roll": "roll"}
    for w, s in cases.items():
        assert stem(w) == s, (w, stem(w), s)


def test_meteor_identity_and_empty():
    assert SC.meteor_one([], ["a"]) == 0.0
    s = SC.meteor_one("the cat sat on the mat".split(), "the cat sat on the mat".split())
    assert 0.99 < s <= 1.0


def test_rouge_identity(spark):
    df = spark.createDataFrame([(1, "The cat, the hat!", "the cat the hat"), (2, "", "x")],
                               "k INT, p STRING, r STRING")
    t = df.select("k", SC.rouge_tokens("p").alias("pt"), SC.rouge_tokens("r").alias("rt"))
    r1 = {r["k"]: r for r in SC.rouge_n(t, ["k"], "pt", "rt", 1).collect()}
    assert r1[1]["rouge1_f"] == 1.0
    assert r1[2]["rouge1_f"] == 0.0
    rl = {r["k"]: r for r in SC.rouge_l(t, ["k"], "pt", "rt").collect()}
    assert rl[1]["rougeL_f"] == 1.0 and rl[2]["rougeL_f"] == 0.0


def test_rouge_n_matches_python(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(40):
        p = " ".join(rnd.choice("a b c d e f".split()) for _ in range(rnd.randint(0, 12)))
        r = " ".join(rnd.choice("a b c d e f".split()) for _ in range(rnd.randint(0, 12)))
        rows.append((k, p, r))
    df = spark.createDataFrame(rows, "k INT, p STRING, r STRING")
    t = df.select("k", SC.rouge_tokens("p").alias("pt"), SC.rouge_tokens("r").alias("rt"))
    got = {r["k"]: r for r in SC.rouge_n(t, ["k"], "pt", "rt", 2).collect()}
    from collections import Counter
    for k, p, r in rows:
        pt, rt = p.split(), r.split()
        pg = Counter(zip(pt, pt[1:]))
        rg = Counter(zip(rt, rt[1:]))
        ov = sum(min(c, pg[g]) for g, c in rg.items())
        pr = ov / max(sum(pg.values()), 1)
        rc = ov / max(sum(rg.values()), 1)
        f = 2 * pr * rc / (pr + rc) if pr + rc > 0 else 0.0
        assert abs(got[k]["rouge2_f"] - f) < 1e-12


def test_greedy_match_and_cosine_against_numpy(spark):
    import numpy as np

    from textlab.operators.vectors import doc_cosine, greedy_match
    rng = np.random.default_rng(1)
    vec = {w: rng.normal(size=5) for w in "abcdefgh"}
    vec["zero"] = np.zeros(5)
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "token string, vec array<double>")
    rnd = random.Random(3)
    words = [*"abcdefgh", "zero", "other"]
    rows = [(k, k % 3, rnd.choices(words, k=rnd.randint(0, 9)), rnd.choices(words, k=rnd.randint(0, 9))) for k in range(80)] + [(99, 0, None, ["a"]), (100, 0, ["a"] * 500, ["a"])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, p array<string>, r array<string>").repartition(3)
    got = {r["conv_id"]: r for r in greedy_match(df, ["conv_id", "turn"], "p", "r", table, 0.1).collect()}
    cos = df.selectExpr("conv_id", "explode(array(struct('p' as side, p as t), struct('r' as side, r as t))) as s").selectExpr("conv_id", "s.side", "explode(s.t) as tok")
    near = {r["conv_id"]: r["cosine"] for r in doc_cosine(cos, ["conv_id"], "side", "tok", table, "p", "r").collect()}
    assert len(got) == len(rows)
    for k, _, p, r in rows:
        a, b = ([vec[w] for w in x or [] if w in vec] for x in (p, r))
        if not a or not b:
            assert got[k]["precision"] is None and got[k]["f1"] is None
            continue
        unit = [np.array([v / (np.linalg.norm(v) or 1) for v in x]) for x in (a, b)]
        sim = unit[0] @ unit[1].T
        pr, rc = sim.max(axis=1).mean(), sim.max(axis=0).mean()
        f = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        assert np.allclose([got[k]["precision"], got[k]["recall"], got[k]["f1"]], [(x - 0.1) / 0.9 for x in (pr, rc, f)])
        x, y = sum(a), sum(b)
        if np.linalg.norm(x) > 0 and np.linalg.norm(y) > 0:
            assert abs(near[k] - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-9
