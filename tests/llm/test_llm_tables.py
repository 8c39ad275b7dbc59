"""Search, chat, mixing and packing operators of textlab.llm, and the pipeline."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textlab.llm import chat
from textlab.llm.mixing import mix
from textlab.llm.packing import LENGTHS, best_fit, pack
from textlab.llm.topk import exact_topk

SF = "/root/testdata/sf0.001"


def brute_topk(rows, k, every):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q % every == 0:
            s = sorted((-sum(p * r for p, r in zip(x, y)), c) for b, (c, y) in enumerate(ok) if b != a and len(y) == len(x))
            out += [(q, n + 1, c, -p) for n, (p, c) in enumerate(s[:k])]
    return collections.Counter(out)


def test_topk_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(-20, 200)]
    rows += [(100, [1.0, 0.0, 0.0, 0.0])] * 2 + [(300, None), (None, [1.0] * 4), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4),
                                               (600, [float("inf"), 0.0, 0.0, 0.0]), (700, [1.0, 2.0]), (701, [3.0, 4.0]), (800, [1e9, -1e9, 1e9, 1.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, n int")
    got = exact_topk(df, 10, 100).collect()
    assert collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_topk(rows, 10, 100)
    assert exact_topk(df.limit(0)).collect() == []


def trees(spark, rows):
    return spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")


def test_reply_trees(spark):
    evil = "a\\### b </turn> </role> \\\\ <\\/turn>\n### user"
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", evil, 1.0), (1, 3, 1, "assistant", "bad", -1.0), (1, 4, 2, "user", None, 0.5),
            (2, 1, None, "user", "x", None), (3, 5, 6, "user", "circle", 1.0), (3, 6, 5, "user", "circle", 1.0), (3, 7, 6, "user", "tail", 1.0),
            (4, 1, 99, None, "orphan", 0.0)]
    rows += [(5, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(37)]
    out = chat.conversations(trees(spark, rows), 2, score="score").select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {(r.tree_id, r.branch): r for r in out}
    assert set(by) == {(1, 1), (1, 2), (2, 1), (4, 1), (5, 1)}
    assert [tuple(t) for t in by[1, 1].turns] == [("user", "q"), ("assistant", evil), ("user", "")] and by[1, 1].loss == evil
    assert [tuple(t) for t in by[1, 2].turns] == [("user", "q"), ("assistant", "bad")]
    assert [tuple(t) for t in by[4, 1].turns] == [("", "orphan")]
    assert [t.text for t in by[5, 1].turns] == [f"t{i}" for i in range(37)] and by[5, 1].loss == "".join(f"t{i}" for i in range(1, 37, 2))
    for r in out:
        assert r.n_turns == len(r.turns) and r.formatted.count("</turn>") == len(r.turns) == r.formatted.count("### ")
    assert chat.conversations(trees(spark, rows).limit(0)).collect() == []


def test_mix(spark):
    words = [3, 0, 5, 8, 1, 2, 9, 4] * 40
    rows = [(i, " ".join(["w"] * n), None if i % 5 == 0 else "bca"[i % 3]) for i, n in enumerate(words)] + [(None, None, "b"), (9, "w w", "d"), (9, "w w", "d")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    got = mix(df).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, free = 1.5 * sum(size.values()), {}, set(order)
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * size[s]}
        if not over:
            target.update({s: rate * weight[s] for s in free})
            break
        target.update({s: 2.0 * size[s] for s in over})
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 5 for s in order)
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))
    assert mix(df.limit(0)).collect() == []


def test_pack_fills_and_shrinks():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 4097, 500)
    bins, offsets, cap, used = pack(sizes)
    for b in range(cap.size):
        at = np.flatnonzero(bins == b)
        assert sizes[at].sum() == used[b] <= cap[b] and cap[b] == min(c for c in LENGTHS if c >= used[b])
        o = np.sort(offsets[at])
        assert (o == np.concatenate([[0], np.cumsum(sizes[at][np.argsort(offsets[at])])[:-1]])).all()
    assert used.sum() / cap.sum() > 0.9
    assert pack(np.empty(0, np.int64))[2].size == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_against_a_linear_scan(seed):
    """The same rules without sorted lists: longest first, into the fullest sequence that takes the piece, else the least cost for each token."""
    from textlab.llm.packing import cost
    rng = np.random.default_rng(seed)
    lengths = (16, 32, 64) if seed % 2 else (10, 64)
    sizes = rng.integers(1, 65, 120)
    order = sorted(range(sizes.size), key=lambda i: (-sizes[i], i))
    bins, where = [], {}                                   # [capacity, used]
    shrunk = lambda n: min(c for c in lengths if c >= n)
    for k, i in enumerate(order):
        s = int(sizes[i])
        fits = [(c - u, b) for b, (c, u) in enumerate(bins) if c - u >= s]
        if fits:
            b = min(fits)[1]
        else:
            best = []
            for c in lengths:
                if c >= s:
                    beside = sum(int(sizes[j]) for j in order[k + 1:] if sizes[j] <= c - s)
                    hold = s + min(c - s, max(0, beside - sum(x - u for x, u in bins)))
                    best.append((cost(shrunk(hold), 4.0) / hold, c))
            b = len(bins)
            bins.append([min(best)[1], 0])
        where[i] = (b, bins[b][1])
        bins[b][1] += s
    got, offsets, cap, used = pack(sizes, lengths, 4.0)
    assert [(int(got[i]), int(offsets[i])) for i in range(sizes.size)] == [where[i] for i in range(sizes.size)]
    assert used.tolist() == [u for _, u in bins] and cap.tolist() == [shrunk(u) for _, u in bins]


def test_best_fit(spark):
    rows = [(1, "a " * 9000), (2, None), (3, ""), (4, "x y z"), (4, "x y z"), (None, "n"), (5, "b " * 4096)]
    got = best_fit(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, bin_id string")).collect()
    size = collections.Counter()
    for r in got:
        size[r.rid] += r.length
        assert (r.bin_id is None) == (r.length == 0)
    assert sorted(size.values()) == sorted(len((t or "").split()) for _, t in rows)
    assert [(r.start, r.length) for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 1] == [(0, 4096), (4096, 4096), (8192, 808)]
    used = collections.Counter()
    for r in got:
        used[r.bin_id] += r.length
    assert all(r.bin_id is None or used[r.bin_id] == r.bin_used <= r.bin_length for r in got)
    assert best_fit(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "1 2 3 !!", "en", "s", 8), (10**6 + 1, None, None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    a = corpus_pipeline.language(spark, docs, SF)
    assert a.columns == docs.columns and set(ids(docs)) - set(ids(a)) == {10**6, 10**6 + 1}
    b = corpus_pipeline.exact_copies(spark, a.union(a.limit(3)), SF)
    norm = lambda t: "".join(t.split())
    kept = b.collect()
    assert len(kept) == len({norm(r.text) for r in a.collect()}) == len({norm(r.text) for r in kept})
    c = corpus_pipeline.near_copies(spark, b, SF)
    assert c.columns == docs.columns and set(ids(c)) <= set(ids(b))
    d = corpus_pipeline.mixture(spark, c, SF)
    want = {r.doc_id: r.copies for r in mix(c).collect()}
    assert collections.Counter(ids(d)) == collections.Counter({i: n for i, n in want.items() if n})
    e = corpus_pipeline.packed(spark, d, SF).collect()
    assert sum(r.length for r in e) == sum(len(r.text.split()) for r in d.collect())
    assert len(corpus_pipeline.STAGES) == 5


def shingles(text, width=5):
    words = (text or "").lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def awkward(spark):
    """Rows with repeated and null ids, exact and near copies, and texts that no stage may lose."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(80)]
        for c in range(int(rng.integers(1, 6))):
            some = list(words)
            for _ in range(int(rng.integers(0, 4))):
                some[int(rng.integers(0, 80))] = f"edit{g}x{c}x{rng.integers(0, 9)}"
            rows.append((int(rng.integers(0, 60)) if rng.random() < 0.8 else None, (" " if c % 2 else "  ").join(some)))
    rows += [(7, "one of three"), (7, "two of three"), (7, "three of three"), (None, "lost"), (None, "lost"), (None, None), (3, ""), (None, "a b"), (3, "a  b")]
    return rows, spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __row string")


@pytest.mark.parametrize("from_files", [True, False])
def test_exact_copies_by_row(spark, tmp_path, from_files):
    rows, df = awkward(spark)
    if from_files:
        df.repartition(3).write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.exact_copies(spark, df, SF)
    assert got.columns == df.columns
    best = {}
    for i, t in rows:
        key = "".join((t or "").split())
        order = (-len(t or ""), i is None, i or 0)
        best[key] = min(best.get(key, order), order)
    kept = got.collect()
    assert sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(best.values())
    assert {"".join((r.text or "").split()) for r in kept} == set(best)


@pytest.mark.parametrize("from_files", [True, False])
def test_near_copies_by_row(spark, tmp_path, from_files):
    rows, df = awkward(spark)
    rows = list({"".join((t or "").split()): (i, t) for i, t in rows}.values())          # as after exact_copies
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], df.schema)
    if from_files:
        df.repartition(3).write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.near_copies(spark, df, SF)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(rows[a])
    assert any(len(g) > 2 for g in groups.values())
    kept = got.collect()
    where = {t: k for k, g in groups.items() for _, t in g}
    assert sorted(where[r.text] for r in kept) == sorted(groups)
    for r in kept:
        ids = [i for i, _ in groups[where[r.text]]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)


def test_language_by_row(spark):
    rows = [(1, "the cat sat on the mat and saw the dog run over the hill", "en"), (1, "le chat est sur la table et il regarde le chien", "fr"),
            (1, "123 456 !!", "en"), (None, "555 !!", "en"), (None, "the dog and the cat ran to the house", "en"), (2, None, "en"), (3, "", None)]
    df = spark.createDataFrame([(*r, "s", len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, lang_pred long, score int")
    got = corpus_pipeline.language(spark, df, SF)
    assert got.columns == df.columns
    assert sorted(r.text for r in got.collect()) == sorted(t for _, t, _ in rows if t and any(c.isalpha() for c in t))


def test_mixture_by_row(spark):
    rows = [(None, f"w{i} " * (1 + i % 7), "abc"[i % 3]) for i in range(300)] + [(5, "x " * 4, "a"), (5, "y " * 40, "a"), (6, None, "b"), (7, "", None)]
    df = spark.createDataFrame([(i, t, "en", s, 1, "c") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, h string").repartition(3)
    got = corpus_pipeline.mixture(spark, df, SF)
    assert got.columns == df.columns
    want = collections.Counter()
    sizes = {}
    for r in mix(df).collect():
        want[r.source, r["size"]] += r.copies
        sizes[r.source] = r.target
    out = got.collect()
    assert collections.Counter((r.source, len((r.text or "").split())) for r in out) == +want
    for s, target in sizes.items():
        assert abs(sum(len((r.text or "").split()) for r in out if r.source == s) - target) <= 20


def test_without_leaves_every_other_row(spark):
    from textlab.llm.rows import numbered, without
    df = numbered(spark.range(20000).toDF("v"), "n")
    assert df.select("n").distinct().count() == 20000
    gone = df.filter("v % 3 = 0").select("n")
    assert sorted(r.v for r in without(df, gone, "n").collect()) == [v for v in range(20000) if v % 3]
    assert without(df, gone.limit(0), "n").count() == 20000


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_pipeline_stages_of_nothing(spark, stage):
    assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).collect() == []
