"""Source divergence audit against a brute-force version in plain Python."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm.divergence import audit, radix_order, term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    count, seen, groups = collections.Counter(), collections.defaultdict(set), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").translate(FOLD)):
            count[lang, source, t] += 1
            seen[lang, t].add(k)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in seen.items() if x == lang and len(d) >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(n):
            total = sum(n)
            return [1 + 10 ** 9 * (x + 1) // (total + len(n)) for x in n]

        p = {s: shares([count[lang, s, t] for t in kept]) for s in sources}
        q = shares([sum(count[lang, s, t] for s in sources) for t in kept])
        for s in sources:
            pair = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            term = [((a - b) ** 2 // b, t) for t, a, b in zip(kept, p[s], q) if count[lang, s, t] and a > b]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, r) for r, (v, t) in enumerate(found[:top if part == "term" else None], 1)]
    return sorted(out)


WORDS = (["a", "B", "Öl", "ÖL", "straße", "eightchr", "ninechars", "sixteen" + "x" * 9, "seventeen" + "y" * 8, "z" * 32, "z" * 33, "w" * 5000, "日本語",
          "日本語日本", "日本語日本語", "€", "aa", "ab", "zz", "\x80x"] + [f"w{chr(97 + i)}" for i in range(26)])


def corpus():
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) + rng.choice(["", ".", " 1a2b_c\x7fd", "\nX-y"]), rng.choice(["en", "de", None, ""]),
             rng.choice(["s1", "s2", "S1", "ü", None, ""])) for _ in range(150)]
    return rows + [("hot word " * 20000, "en", "s1")] * 70 + [(None, "fr", "only"), ("", "fr", "two"), ("!!! 123", "fr", "three"), ("lonely", "xx", "one"),
                                                               (None, None, None), ("", "nothing", "n1"), ("123", "nothing", "n2")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, n int, term string, p int")


def table(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_against_brute_force(spark):
    rows = corpus()
    assert table(audit(frame(spark, rows).repartition(7))) == brute(rows)
    assert table(audit(frame(spark, rows), min_docs=2, top=3)) == brute(rows, 2, 3)


def test_sources_of_several_tiles(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(WORDS[:12], k=6)), "en", f"src{i % 290}") for i in range(600)]
    assert table(audit(frame(spark, rows))) == brute(rows)


def test_counts_of_terms_and_documents(spark):
    rows = [(f"{w} {w} other", "en", "s") for w in WORDS] + [(w, "en", "s") for w in WORDS]
    got = {r["term"]: (r["n"], r["docs"]) for r in term_counts(frame(spark, rows).coalesce(1)).collect()}
    want, docs = collections.Counter(), collections.defaultdict(set)
    for k, (t, _, _) in enumerate(rows):
        for x in TERM.findall(t.translate(FOLD)):
            want[x] += 1
            docs[x].add(k)
    assert got.pop("") == (len(rows), 0)
    assert got == {t: (n, len(docs[t])) for t, n in want.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2 ** 64 - 1), st.sampled_from([0, 1, 2 ** 40]), st.integers(0, 70000)), max_size=60))
def test_radix_order_is_stable(rows):
    words = [np.array([r[k] for r in rows], np.uint64) for k in (0, 1)]
    digits = np.array([r[2] for r in rows], np.int64)
    want = sorted(range(len(rows)), key=lambda i: (rows[i], i))
    assert radix_order(words, digits).tolist() == want


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_empty_tables(spark, rows):
    assert table(audit(frame(spark, [("x", "en", "s")]).limit(0) if not rows else frame(spark, rows))) == []
