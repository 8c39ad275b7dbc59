"""SURVEY §5 golden-arithmetic invariants, checked on our own query outputs (sf0.001)."""

import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_tokens_count_equals_rows_times_mean_lengths_plus_specials(spark, q):
    totals = {r["tokenizer"]: r for r in q["token_total"](spark, SF).collect()}
    stats = {(r["tokenizer"], r["field"]): r for r in q["length_stats"](spark, SF).collect()}
    for tok, t in totals.items():
        a, h = stats[(tok, "article")], stats[(tok, "highlight")]
        assert a["count"] == t["n_rows"]
        expected = t["n_rows"] * (a["mean"] + h["mean"] + 4)
        assert abs(t["tokens_count"] - expected) < 1e-5 * t["n_rows"]


def test_threshold_rule(spark, q):
    for r in q["length_filter_report"](spark, SF).collect():
        assert r["threshold"] == math.floor(r["p90"] * 1.1)
        assert r["kept_samples"] <= r["total_samples"]


def test_augmentation_doubles_rows(spark, q):
    n = q["filter_len_ratio"](spark, SF).count()
    u = q["augment_union"](spark, SF)
    assert u.count() == 2 * n
    assert u.where("is_augmented").count() == n


def test_filter_accounting(spark, q):
    r = q["filter_violations"](spark, SF).first()
    assert r["remaining"] + r["total_removed"] == r["original_samples"]
    assert r["removed_short"] + r["removed_ratio_low"] + r["removed_ratio_high"] >= r["total_removed"]
    assert q["filter_len_ratio"](spark, SF).count() == r["remaining"]


def test_percent_removed_consistent(spark, q):
    r = q["cleaning_impact"](spark, SF).first()
    assert r["chars_removed"] == r["total_raw_chars"] - r["total_cleaned_chars"]
    assert abs(r["pct_removed"] - 100 * r["chars_removed"] / r["total_raw_chars"]) < 1e-6


def test_pos_shares_sum_to_one(spark, q):
    for phase in ("before", "after"):
        s = sum(r["share"] for r in q["pos_corpus_share"](spark, SF).where(f"phase = '{phase}'").collect())
        assert abs(s - 1.0) < 1e-5
