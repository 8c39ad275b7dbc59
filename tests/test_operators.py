"""Distributed building blocks: exact quantiles, prefix sums, registry, histogram."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import profile as PR
from textlab.operators.prefix import global_row_number, running_total
from textlab.operators.quantiles import quantiles
from textlab.operators.tokenizers import registry
from textlab.operators.tokenizers.vocab import unk_id


@pytest.mark.parametrize("kind", ["hot", "integers", "wide", "one", "extremes"])
def test_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(1)
    vals = {"hot": np.concatenate([rng.random(500), np.full(400, 0.25), rng.integers(0, 5, 100) / 4.0]),       # a hot value
            "integers": rng.integers(-50, 5000, 1000).astype(float), "one": np.full(30, 7.5),
            "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 500), -(10.0 ** rng.integers(-5, 300, 300)), [0.0, -0.0]]),
            "extremes": np.concatenate([rng.normal(size=50), [1.7e308, -1.7e308, np.inf, np.inf, -np.inf]])}[kind]
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(vals)] + [(None, 1.0), (None, 2.0), (9, None)], "g INT, v DOUBLE")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r["g"]: [r[f"q_{i}"] for i in range(len(probs))]
           for r in quantiles(df.repartition(7), "v", probs, ["g"]).collect()}
    for g in range(3):
        with np.errstate(all="ignore"):
            exp = np.percentile(vals[np.arange(len(vals)) % 3 == g], [p * 100 for p in probs])
        ok = np.isfinite(exp)
        assert np.allclose(np.array(got[g])[ok], exp[ok], rtol=1e-9, atol=1e-12)
    assert np.allclose(got[None], [1.0, 1.1, 1.25, 1.5, 1.9, 1.99, 2.0]) and got[9] == [None] * len(probs)


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame([(v,) for v in range(10001)], "v LONG").repartition(3)
    r = quantiles(df, "v", [0.5, 0.999]).first()
    assert (r["q_0"], r["q_1"]) == (5000.0, 9990.0)
    assert quantiles(df.limit(0), "v", [0.5], ["v"]).collect() == []


def test_running_total_and_row_number(spark):
    rows = [(i, (i * 7) % 13) for i in range(300)]
    df = spark.createDataFrame(rows, "k INT, x INT").repartition(5)
    got = {r["k"]: r["cum"] for r in running_total(df, ["k"], "x", out="cum").collect()}
    acc = 0
    for k, x in rows:
        acc += x
        assert got[k] == acc
    rn = {r["k"]: r["rn"] for r in global_row_number(df, ["k"]).collect()}
    assert rn == {k: k + 1 for k, _ in rows}


def test_describe_invariant_under_repartition(spark):
    df = spark.createDataFrame([(float(i % 17) / 3, i % 5) for i in range(200)], "a DOUBLE, b INT")
    d1 = sorted(tuple(r) for r in PR.describe(df, ["a", "b"]).collect())
    d2 = sorted(tuple(r) for r in PR.describe(df.repartition(9), ["a", "b"]).collect())
    assert d1 == d2


def test_histogram_matches_numpy(spark):
    vals = [0.0, 1.0, 1.0, 2.5, 3.0, 9.99, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE")
    h = sorted((r["bin"], r["n"]) for r in PR.histogram(df, "x", 5).collect())
    exp, _ = np.histogram(vals, bins=5)
    assert [n for _, n in h] == list(exp)


def test_registry_and_unk():
    for name in registry.NAMES:
        t = registry.get(name)
        assert callable(t.train) and callable(t.encode)
    with pytest.raises(KeyError):
        registry.get("wordpiece")
    assert unk_id() == 1


def test_conf_override_restores(spark):
    from textlab.session import conf_override
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with conf_override(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "3"}):
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
