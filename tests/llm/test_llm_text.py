"""Text operators of textlab.llm against brute force on a small table of awkward rows."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import kernels
from textlab.llm.exact_dedup import exact_groups
from textlab.llm.jaccard import jaccard_components
from textlab.llm.langid import identify
from textlab.llm.line_dedup import drop_recurring_lines
from textlab.llm.lm import learn_weights, score_texts
from textlab.llm.quality import classify

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (0, "The cat sat on the mat and saw the dog run", "en"),
    (1, "The cat  sat on the mat and saw the dog\trun", "en"),
    (2, "the CAT sat on the mat and saw the dog run", "en"),
    (3, "Der Hund läuft über die Straße und sieht die Katze", "de"),
    (4, None, "en"), (5, "", "en"), (6, " \t\n", None), (7, "Öl", None), (8, "123 456 !!", "de"),
    (9, BASE, "en"), (10, BASE + " tail", "en"), (11, BASE.replace("w30", "x30"), "en"), (12, "tail " + BASE, None),
    (13, "one two", "en"), (14, "one two", "en"), (15, "ab" * 40000, "en"), (15, "ab" * 40000, "en"),
    (None, "the lost row of the table", None), (None, None, None), (16, "Die Katze und der Hund", "de"),
    (17, "line one " * 3000, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns carry names that the operators use inside
    return spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], "doc_id long, text string, lang string, n int, sig string, size int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def tokens(t):
    return WORD.findall((t or "").translate(FOLD))


def test_kernels_words_and_golomb():
    texts = ["", "a b", " x\ty ", "Ä ö\x0bü", "abc"]
    import pyarrow as pa
    data, bounds = kernels.text_buffer(pa.array(texts))
    h, first, start, end = kernels.words(data, bounds)
    assert np.diff(first).tolist() == [len(tokens(t)) for t in texts]
    found = [bytes(data[a:z]).decode() for a, z in zip(start, end)]
    assert [x.translate(FOLD) for x in found] == [w for t in texts for w in tokens(t)]
    assert len(set(h.tolist())) == len({w for t in texts for w in tokens(t)})
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (kernels.golomb_decode(kernels.golomb_encode(v)) == v).all()
    v = np.arange(300, dtype=np.uint64)
    assert (kernels.golomb_decode(kernels.golomb_encode(v)) == v).all()
    c = np.array([0, 1, 254, 255, 256, 10**12])
    assert kernels.counts_decode(kernels.counts_encode(c)).tolist() == c.tolist()


def test_exact_groups(docs, empty):
    got = exact_groups(docs).collect()
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t, _ in ROWS]
    groups = collections.defaultdict(list)
    for (i, t, _), k in zip(ROWS, norm):
        groups[k].append((-len(t or ""), i is None, i))
    want = []
    for (i, t, _), k in zip(ROWS, norm):
        keep = min(groups[k], key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))[2]
        want.append((i, keep, len(groups[k]), hashlib.sha256(k.encode()).hexdigest()))
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == collections.Counter(want)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_groups(empty).collect() == []


def test_exact_groups_of_one_fingerprint(spark):
    """A third of all rows is one text, spread over many partitions."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text")).repartition(17)
    got = exact_groups(d).groupBy("group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()
    assert {(r.group_size, r.n, r.k) for r in got} == {(1, 2000, 2000), (1000, 1000, 1)}


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard_components(docs, empty, width, num, den):
    sets = []
    for _, t, _ in ROWS:
        w = tokens(t)
        sets.append(frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(ROWS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(ROWS)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _, _) in enumerate(ROWS):
        least[find(k)].append(i)
    want = collections.Counter((i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _, _) in enumerate(ROWS))
    got = jaccard_components(docs, width, (num, den)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    if width == 3:
        assert jaccard_components(empty, width, (num, den)).collect() == []


def test_jaccard_many_near_copies(spark):
    """A chain and a crowd of near copies; every link counts, far pairs of the crowd included."""
    rows = [(i, " ".join(f"c{k}" for k in range(i, i + 40))) for i in range(12)]                      # each linked to the next only
    words = [f"b{k}" for k in range(100)]
    for i in range(60):
        w = list(words)
        for k in range(i % 4):
            w[(i * 7 + 13 * k) % 100] = f"m{i}x{k}"
        rows.append((100 + i, " ".join(w)))
    got = dict(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 1, (90, 100)).select("doc_id", "component_id").collect())
    sets = {i: set(t.split()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}


def test_language(docs, empty):
    got = {(r.doc_id, r.lang_pred) for r in identify(docs).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (8, "und"), (16, "de"), (0, "en")} <= got
    assert identify(empty).collect() == []


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality(docs, empty, spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = classify(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got) > 0
    some = classify(docs, spark.createDataFrame([(0, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")).collect()
    assert len(some) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in some)
    assert classify(empty, labels).collect() == []
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}


def test_lm_base_and_counts(docs, empty):
    got = collections.defaultdict(list)
    for r in score_texts(docs).collect():
        got[r.doc_id].append(r)
    seen, n = collections.Counter(), 0
    for i, t, _ in ROWS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update(tokens(t) + ["\n"])
    n, v = sum(seen.values()), len(seen)
    for i, t, _ in ROWS:
        w = tokens(t) + ["\n"]
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)
        assert any(r.n_tokens == len(w) and r.n_known == sum(seen[x] > 0 for x in w) and r.train_tokens == n
                   and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0 for r in got[i])
    assert score_texts(empty).collect() == []


def test_lm_predicts_better_than_the_unigram(spark):
    r = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.b < r.s < 0
    w = learn_weights([(3, 100, 60.0, 1.0), (3, 50, 0.0, 0.5)], 1e-6)
    assert np.allclose(w.sum(axis=1), 1) and w[3][2] > w[3][1]


def test_line_dedup(docs, empty, spark):
    rows = [(i, f"User user{i} logged in from host h{i} today\nunique sentence number {i} of its own kind x{i} y{i} z{i}\n\nok") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "User user7 logged in from host h9 today"), (53, "User nobody walked out of the house")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_recurring_lines(
        spark.createDataFrame(rows, "doc_id long, text string"), fixed=0.5, same_docs=None).collect()}
    assert got == brute_lines(rows, fixed=0.5, same_docs=None)
    assert got[50] == (None, 0, 0) and got[51] == ("", 1, 0) and got[52] == ("", 1, 1)
    assert got[53] == (rows[-1][1], 1, 0) and got[3][2] >= 1
    assert drop_recurring_lines(empty).collect() == [] and drop_recurring_lines(docs).count() == len(ROWS)


def brute_lines(rows, lead=3, min_tokens=3, min_docs=10, fixed=0.6, same_docs=2):
    """Templates and unchanged lines by plain counting, per different text."""
    texts = {t: [(p, x.strip(" \t\r\x0b\x0c")) for p, x in enumerate(t.split("\n"))] for _, t in rows if t is not None}
    split = functools.cache(lambda line: re.split("[\x20\x09-\x0d]+", line))
    general = lambda ts: ["<*>" if re.search("[0-9]", x) else x for x in ts]
    leaf = functools.cache(lambda line: (len(split(line)), *general(split(line)[:lead])))
    leaves, there, support, same, templates = (collections.defaultdict(set) for _ in range(5))
    for t, lines in texts.items():
        for p, x in lines:
            if x:
                same[x].add(t)
            if x and len(split(x)) >= min_tokens:
                leaves[leaf(x)].add(t)
                there[x].add(t)
                for at, w in enumerate(general(split(x))):
                    support[leaf(x), at, w].add(t)
    named = {}
    for x in there:
        if len(leaves[leaf(x)]) >= min_docs:
            t = [w if w != "<*>" and len(support[leaf(x), at, w]) >= min_docs else "<*>" for at, w in enumerate(general(split(x)))]
            if sum(len(support[leaf(x), at, w]) >= min_docs and w != "<*>" for at, w in enumerate(general(split(x)))) >= fixed * len(t):
                named[x] = (leaf(x), *t)
                templates[named[x]] |= there[x]
    gone = {x for x, t in named.items() if len(templates[t]) >= min_docs}
    if same_docs:
        gone |= {x for x, t in same.items() if len(t) >= (same_docs if len(split(x)) >= min_tokens else min_docs)}
    out = {}
    for i, t in rows:
        lines = texts.get(t, [])
        kept = [x for (p, line), x in zip(lines, (t or "").split("\n")) if line not in gone or not line]
        out[i] = (t if t is None or len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("n", [9, 12])
def test_line_dedup_counts_a_text_once(spark, n):
    """One text with many lines of a leaf is one text: it does not make its own token a constant."""
    rows = [(i, f"alpha beta gamma x{'abcdefghij'[i]} mark two{'abcdefghij'[i]}") for i in range(10)]
    rows += [(90, "\n".join(f"alpha beta gamma delta mark item{'y' * (k + 1)}" for k in range(n)))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert got[90] == ("", n, n) and got[3] == ("", 1, 1)


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["log", "in", "out", "user", "from", "to", "7", "a1", "the", "x"]
    rows = []
    for i in range(160):
        lines = [" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(rng.integers(1, 6))]
        lines += ["the line that all have\tnow"] * int(rng.random() < 0.4)
        rows.append((i, "\n".join((" " * int(rng.integers(0, 2)) + x) for x in lines)))
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "long " * 3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pos int, line string").repartition(5)
    for args in ({}, {"same_docs": None}, {"min_docs": 4, "fixed": 0.3, "lead": 2}):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_recurring_lines(df, **args).collect()}
        assert got == brute_lines(rows, **args)


@pytest.mark.parametrize("n", [2, 3, 9])
def test_line_dedup_drops_a_constant_passage(spark, n):
    """A passage of 60 words, 3 of them numbers, in few texts; a short line goes at ten texts only."""
    passage = " ".join(f"word{'abc'[i % 3] * (i // 3 + 1)}" if i % 20 else str(i) for i in range(60))
    rows = [(i, f"only here stands number {'x' * (i + 1)} of all\n{' ' * (i % 2)}{passage}\nRead more\n") for i in range(n)]
    rows += [(20 + i, f"{'y' * (i + 1)} is nothing else than this\nSee also") for i in range(10)] + [(40, passage + " more"), (41, None)]
    # the same text twice is one text: its lines do not recur
    rows += [(50, "a line of two equal texts"), (51, "a line of two equal texts")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_recurring_lines(
        spark.createDataFrame(rows, "doc_id long, text string"), same_docs=2).collect()}
    for i, t in rows[:n]:
        assert got[i] == (t.split("\n")[0] + "\nRead more\n", 4, 1)
    for i, t in rows[n:n + 10]:
        assert got[i] == (t.split("\n")[0], 2, 1)
    assert got[40] == (rows[n + 10][1], 1, 0) and got[41] == (None, 0, 0)
    assert got[50] == got[51] == ("a line of two equal texts", 1, 0)


def letter_grams(text):
    """1 to 3 letters of a lower-cased text, a word's edges as blanks; three only around a letter that is not alone."""
    x = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    x = [ord(c) for c in re.sub(" +", " ", x)]
    out = collections.Counter((0, 0, c) for c in x if c != 32)
    out.update((0, a, b) for a, b in zip(x, x[1:]) if a != 32 or b != 32)
    out.update((a, b, c) for a, b, c in zip(x, x[1:], x[2:]) if b != 32 and (a != 32 or c != 32))
    return out


@pytest.mark.parametrize("size", [7, 400])
def test_language_against_brute_force(spark, size):
    rng = np.random.default_rng(1)
    words = {"en": "the cat and a dog of house in hill I run".split(), "de": "der Hund und die Katze über Straße im Öl ein".split(),
             "fr": "le chat et la été rue à il regarde un œuf".split()}
    rows = []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join(rng.choice(words[lang], rng.integers(1, 25))) + rng.choice(["", ".", " 12x", "\n", "'s"])
        rows.append((i, text, lang if i % 7 else None))
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !!", "fr"), (203, "x", "en"), (204, "I a", None), (None, "the dog", "en"), (5, "le chat " * 4000, "fr"),
             (206, "ЖЖ щ", "ru"), (207, "ЖЖ", None), (208, "the dog", "en"), (208, "the dog", "en")]
    got = identify(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string").repartition(4), size).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if lang is not None and not held(i):
            counts[lang].update(letter_grams(t))
    top = lambda c: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])}
    profiles = {lang: top(c) for lang, c in counts.items() if c}
    want = []
    for i, t, _ in rows:
        mine = top(letter_grams(t))
        best = min(((sum(abs(r - p[g]) if g in p else size for g, r in mine.items()), lang) for lang, p in profiles.items()))
        want.append((str(i), held(i), best[1], round(1 - best[0] / (len(mine) * size), 9)) if mine else (str(i), held(i), "und", 0.0))
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)
