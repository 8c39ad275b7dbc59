"""Tokenizers: BPE batched training equals sequential BPE; encode/decode round trips."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from textlab.operators.tokenizers import bpe, char, word
from textlab.operators.tokenizers.vocab import decode


def merge_once(sym, a, b):
    out, i = [], 0
    while i < len(sym):
        if i + 1 < len(sym) and sym[i] == a and sym[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(sym[i])
            i += 1
    return out


def sequential_bpe(words, n_pieces, max_len=16):
    """One merge at a time (count desc, then the shorter, then the smaller piece, then the shorter first part) until there
    are ``n_pieces`` different pieces."""
    counts = Counter(words)
    state = {w: list(w) for w in counts}
    pieces = []
    while len(pieces) < n_pieces:
        pc = Counter()
        for w, sym in state.items():
            for a, b in zip(sym, sym[1:]):
                if len(a) + len(b) <= max_len:
                    pc[(a, b)] += counts[w]
        if not pc:
            break
        (a, b), _ = min(pc.items(), key=lambda t: bpe.order_key(*t[0], t[1]))
        if a + b not in pieces:
            pieces.append(a + b)
        state = {w: merge_once(sym, a, b) for w, sym in state.items()}
    return pieces


@pytest.mark.parametrize("seed", range(4))
def test_bpe_in_epochs_equals_one_merge_at_a_time(spark, seed):
    rnd = random.Random(seed)
    alphabet = "abcde" if seed % 2 else "ab"
    stems = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    words = [rnd.choice(stems) + rnd.choice(["", "ab", "ba", rnd.choice(stems)]) for _ in range(900)]
    df = spark.createDataFrame([(w,) for w in words], "word STRING")
    n_chars = len(set("".join(words)) | {"▁"})
    expected = sequential_bpe(["▁" + w for w in words], 150)
    history = []
    vocab = bpe.train_bpe(df, 4 + n_chars + 150, start_pairs=8 if seed < 2 else 64, run_symbols=400 if seed < 2 else 10**6, history=history)
    rows = vocab.orderBy("id").collect()
    assert [r["piece"] for r in rows][4:4 + len(expected)] == expected
    assert [r["id"] for r in rows] == list(range(len(rows))) and len({r["piece"] for r in rows}) == len(rows)
    assert [x for _, x in history] == sorted((x for _, x in history), reverse=True)       # words leave as they finish
    assert len(history) < sum(m for m, _ in history)


@pytest.mark.parametrize("seed", range(40))
def test_bpe_steps_on_many_small_corpora(seed):
    """The epoch's own logic without Spark: runs, steps, limits from the pair counts."""
    rnd = random.Random(seed)
    words = Counter("".join(rnd.choice("abc"[: rnd.choice([2, 3])]) for _ in range(rnd.randint(2, 12))) for _ in range(60))
    expected = sequential_bpe([w for w, n in words.items() for _ in range(n)], 40, 8)
    state, symbols, pieces = {w: list(w) for w in words}, set("".join(words)), []
    while len(pieces) < 40:
        pc = Counter()
        for w, sym in state.items():
            for a, b in zip(sym, sym[1:]):
                if len(a) + len(b) <= 8:
                    pc[(a, b)] += words[w]
        top = [(a, b, c) for (a, b), c in sorted(pc.items(), key=lambda t: bpe.order_key(*t[0], t[1]))]
        if not top:
            break
        k = rnd.choice([2, 3, 5, 9])
        chosen, first_out = top[:k], top[k] if len(top) > k else None
        runs = Counter()
        for w, sym in state.items():
            for r in bpe.cut_runs(sym, {p[:2] for p in chosen}):
                runs[r] += words[w]
        limits = {}
        for s in {a + b for a, b, _ in chosen}:
            ways = [(a, b) for a, b, _ in chosen if a + b == s]
            if len(ways) > 1 or s in symbols:
                right, left = Counter(), Counter()
                for (a, b), c in pc.items():
                    if a == s or any(a == w[1] for w in ways):
                        right[b] += c
                    if b == s or any(b == w[0] for w in ways):
                        left[a] += c
                limits[s] = (len(ways), max([0, *right.values(), *left.values()]))
        known = set(symbols)
        merges = bpe.take_steps(list(runs.items()), first_out, symbols, limits, 40 - len(pieces), 8)
        for a, b in merges:
            if a + b not in known:
                known.add(a + b)
                pieces.append(a + b)
        ranks = {}
        for i, m in enumerate(merges):
            ranks.setdefault(m, []).append(i)
        one_by_one = dict(state)
        for a, b in merges:
            one_by_one = {w: merge_once(sym, a, b) for w, sym in one_by_one.items()}
        state = {w: bpe.apply_in_order(sym, ranks) for w, sym in state.items()}
        assert state == one_by_one
    assert pieces == expected


def test_bpe_batches_equal_one_word_at_a_time(monkeypatch):
    from textlab.operators.tokenizers.merges import Merges, lists_of_strings, numbered, runs
    rng = random.Random(11)
    for seed in range(60):
        words = ["".join(rng.choices("aab%s\U0001F600" % ("c" if seed % 2 else "\n"), k=rng.randint(1, 9))) for _ in range(40)]
        lists, times = pa.array([list(w) for w in words][3:], pa.list_(pa.string())), np.arange(1, len(words) - 2)
        lists = pa.concat_arrays([lists, lists])[len(lists):]                           # a slice
        symbols, merges = sorted({c for w in words for c in w if c != "\U0001F600"}), []
        for _ in range(12):                                                             # pieces that are spelled twice, pairs that return
            a, b = rng.choice(symbols), rng.choice(symbols)
            merges.append((a, b))
            symbols.append(a + b)
        ranks: dict = {}
        for i, p in enumerate(merges):
            ranks.setdefault(p, []).append(i)
        table = Merges(sorted({s for a, b in merges for s in (a, b, a + b)}), [(*p, r) for p, r in ranks.items()], True)
        sym, size, strings = numbered(lists, pa.array(table.names, pa.string()))
        assert lists_of_strings(strings, *table.merged(sym, size)).to_pylist() == [bpe.apply_in_order(list(w), ranks) for w in words[3:]]
        pairs = {p for p in merges if len(p[0] + p[1]) == 2}
        names = sorted({s for p in pairs for s in p})
        keys = np.array(sorted(names.index(a) * len(names) + names.index(b) for a, b in pairs), np.int64)
        want, got = Counter(), Counter()
        for w, n in zip(words[3:], times):
            for r in bpe.cut_runs(list(w), pairs):
                want[r] += int(n)
        if len(keys):
            for r, n in zip(*runs(lists, times, pa.array(names, pa.string()), keys)):
                got[tuple(r.as_py())] += int(n)
        assert got == want
        ids = {"<unk>": 1, **{c: 100 + i for i, c in enumerate("abc")}, **{s: 4 + i for i, s in enumerate(dict.fromkeys(a + b for a, b in merges))}}
        order = {p: i for p, i in ids.items() if len(p) > 1 and i >= 4}
        one = [tuple(ids.get(p, 1) for p in bpe.bpe_segment("▁" + w, order)) for w in words]
        monkeypatch.setattr(bpe, "merge_all", None)                                     # no word is merged alone
        assert bpe.segmenter(ids)(words) == one
        assert bpe.segmenter(ids)([]) == []
        monkeypatch.undo()


def test_substrings_of_a_batch():
    from textlab.operators.tokenizers.unigram import substrings
    rng = random.Random(12)
    for max_len in (2, 4, 16):
        words = ["".join(rng.choices("aab\U0001F600x", k=rng.randint(0, 20))) for _ in range(50)]
        times, want = np.array([rng.randint(1, 2**40) for _ in words]), Counter()
        for w, n in zip(words, times.tolist()):
            for i in range(len(w)):
                for j in range(i + 2, min(len(w), i + max_len) + 1):
                    if "x" not in w[i:j]:
                        want[w[i:j]] += n
        found, n = substrings(words, times, np.array(sorted(map(ord, "ab\U0001F600"))), max_len)
        assert len(set(found)) == len(found) and dict(zip(found, n.tolist())) == want
    assert substrings([], np.empty(0, np.int64), np.array([97]), 16)[0] == []


def test_bpe_segment_uses_ranks():
    ranks = {"ab": 4, "abc": 5, "bc": 6}
    assert bpe.bpe_segment("abc", ranks) == ["abc"]
    assert bpe.bpe_segment("abd", ranks) == ["ab", "d"]
    assert bpe.bpe_segment("", ranks) == []


def test_word_and_char_round_trip(spark):
    texts = ["the cat sat on the mat", "a b c", "", "the the the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, t STRING")
    words = df.select(F.explode(F.split("t", " ")).alias("word")).where("word <> ''")
    for mod in (word, char):
        train = mod.train_word_vocab if mod is word else mod.train_char_vocab
        enc = mod.encode_word if mod is word else mod.encode_char
        v = train(words, 1000)
        out = decode(enc(df, "t", v, "ids"), "ids", v, "back").orderBy("id").collect()
        assert [r["back"] for r in out] == texts
        assert all(1 not in r["ids"] for r in out)


def _all_segmentations(w, pieces):
    if not w:
        yield []
        return
    for j in range(1, len(w) + 1):
        if w[:j] in pieces:
            for rest in _all_segmentations(w[j:], pieces):
                yield [w[:j]] + rest


def test_viterbi_is_optimal():
    import math
    from textlab.operators.tokenizers import unigram
    rnd = random.Random(11)
    for _ in range(50):
        alphabet = "abc"
        pieces = {c: math.log(rnd.random()) for c in alphabet}
        for _ in range(8):
            p = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 4)))
            pieces[p] = math.log(rnd.random())
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 8)))
        trie = unigram.build_trie(pieces)
        seg, score = unigram.viterbi(w, trie)
        every = list(_all_segmentations(w, pieces))
        best = max(sum(pieces[p] for p in s) for s in every)
        assert abs(score - best) < 1e-9 and "".join(seg) == w
        counts, z = unigram.forward_backward(w, trie)
        weight = [math.exp(sum(pieces[p] for p in s)) for s in every]
        assert abs(z - math.log(sum(weight))) < 1e-9
        for p in pieces:
            want = sum(x * s.count(p) for x, s in zip(weight, every)) / sum(weight)
            assert abs(counts.get(p, 0.0) - want) < 1e-9


def _unigram_words(n=300):
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(n)] + ["aé"]


def test_unigram_em_does_not_lower_likelihood(spark):
    from textlab.operators.tokenizers import unigram
    df = spark.createDataFrame([(w,) for w in _unigram_words()], "word STRING")
    hist = []
    vocab = unigram.train_unigram(df, 30, seed_size=60, history=hist)
    assert vocab.count() == 30 and hist[0][0] > hist[-1][0]
    # within each prune round the two EM steps run on the same piece set
    for (n1, l1), (n2, l2) in zip(hist, hist[1:]):
        if n1 == n2:
            assert l2 >= l1 - 1e-2


def test_unigram_does_not_depend_on_partitions_and_covers_characters(spark):
    from textlab.operators.tokenizers import unigram
    df = spark.createDataFrame([(w,) for w in _unigram_words(1200)], "word STRING")
    one = unigram.train_unigram(df, 40, seed_size=80, rows_per_partition=1000).orderBy("id").collect()
    many = unigram.train_unigram(df.repartition(7), 40, seed_size=80, rows_per_partition=20).orderBy("id").collect()
    assert one == many
    pieces = {r["piece"] for r in one}
    assert set("▁abcd") <= pieces and "é" not in pieces and not any("é" in p for p in pieces)
    full = unigram.train_unigram(df, 40, seed_size=80, coverage=1.0)
    assert "é" in {r["piece"] for r in full.collect()}


@pytest.mark.parametrize("kind", ["bpe", "unigram", "char", "word"])
def test_encode_then_decode(spark, kind):
    from textlab.operators.tokenizers import registry
    tok = registry.get(kind)
    texts = ["the cat sat on the mat", "  a  b\tc\n", "", None, "the the the", "Öl \u00a0 für die Straße 😀", "x" * 3000, "new☃char the"]
    train = spark.createDataFrame([(w,) for t in texts[:-1] if t for w in t.split()], "word STRING")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, t STRING").repartition(3)
    v = tok.train(train, 400)
    rows = decode(tok.encode(df, "t", v, "ids"), "ids", v, "back").orderBy("id").collect()
    known = {r["piece"] for r in v.collect()}
    for t, r in zip(texts, rows):
        words = (t or "").split()
        if kind == "word":
            want = [w if "▁" + w in known else "⁇" for w in words]
            assert r["ids"] == [next((x["id"] for x in v.collect() if x["piece"] == "▁" + w), 1) for w in words]
            assert r["back"].replace(" ", "") == "".join(want)
        else:
            assert r["back"] == "".join(c if c in known or c == " " else "⁇" for c in " ".join(words))


def test_bpe_segment_equals_repeated_best_merge():
    rnd = random.Random(2)
    for _ in range(300):
        pieces = {}
        for _ in range(12):
            pieces.setdefault("".join(rnd.choice("ab") for _ in range(rnd.randint(2, 5))), len(pieces))
        word = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14)))
        sym = list(word)
        while True:
            ranked = [(pieces[a + b], i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if a + b in pieces]
            if not ranked:
                break
            i = min(ranked)[1]
            sym[i:i + 2] = [sym[i] + sym[i + 1]]
        assert bpe.bpe_segment(word, pieces) == sym


def test_oov_summary_all_counts_both_columns_of_train(spark, monkeypatch):
    from textlab.plans import q_tokens as QT
    rows = [("train", [2, 1, 7, 3], [2, 1, 1, 3]), ("train", [2, 3], [2, 8, 3]), ("validation", [2, 1, 3], [2, 1, 3]),
            ("test", [2, 1, 1, 3], [2, 9, 3])]

    def encoded(spark, sf_dir, kind):
        return spark.createDataFrame([(i, s, kind, a, h) for i, (s, a, h) in enumerate(rows)],
                                     "doc_id long, split string, tokenizer string, article_ids array<int>, highlight_ids array<int>")
    monkeypatch.setattr(QT, "_encode_splits", encoded)
    got = {r.tokenizer: (r.tokens, r.unk, r.ratio) for r in QT.oov_summary_all(spark, "none").collect()}
    assert got == {k: (13, 3, 0.230769) for k in ("bpe", "word", "char", "unigram")}


def test_trainers_read_long_lines(spark, monkeypatch):
    from textlab.plans import tokenize as TK
    rows = [(1, "some words here", "short"), (2, "filler " * 5000 + "zebra", "end"), (3, None, "mid " * 1500)]
    monkeypatch.setattr(TK, "train_rows", lambda s, d: s.createDataFrame(rows, "doc_id long, cleaned_text string, highlights string"))
    got = {r.word: r["count"] for r in TK.words(spark, "none").groupBy("word").count().collect()}
    assert got == {"some": 1, "words": 1, "here": 1, "short": 1, "filler": 5000, "zebra": 1, "end": 1, "mid": 1500}


def test_unigram_mstep_of_tiny_counts(spark):
    from decimal import Decimal

    from textlab.operators.tokenizers.unigram import _mstep
    counts = spark.createDataFrame([("ab", Decimal(1)), ("b", Decimal(10**30)), (None, Decimal(-5))], "piece string, c decimal(38,0)")
    table = spark.createDataFrame([("a", 0.0), ("ab", 0.0), ("b", 0.0), ("bb", 0.0)], "piece string, logp double")
    got = {r["piece"]: r["logp"] for r in _mstep(counts, table).collect()}
    assert set(got) == {"a", "ab", "b"} and got["b"] == 0.0 and got["ab"] < -60 and got["a"] < got["ab"]


def test_a_worker_works_on_parts_and_has_one_broadcast_of_a_vocabulary(spark):
    import pyarrow as pa

    from textlab.operators.tokenizers import arrow, vocab
    seen = []

    def part(texts):
        seen.append(len(texts))
        return texts
    texts = pa.array([str(i) for i in range(2 * arrow.TEXTS_AT_ONCE + 1)])
    assert arrow.in_parts(part)(texts).equals(texts) and max(seen) == arrow.TEXTS_AT_ONCE and len(seen) == 3
    assert arrow.in_parts(part)(texts.slice(0, 0)).equals(texts.slice(0, 0))
    v = vocab.specials(spark)
    assert vocab.piece_ids(v) is vocab.piece_ids(v)


def test_lattices_of_many_words_equal_one_by_one():
    import math

    import numpy as np

    from textlab.operators.tokenizers import unigram
    from textlab.operators.tokenizers.lattice import Pieces
    rnd = random.Random(3)
    logp = {"".join(rnd.choice("abcd▁é") for _ in range(rnd.randint(1, 7))): math.log(rnd.random()) - 3 for _ in range(400)}
    logp |= {"ab": -4.0, "a": -2.0, "b": -2.0, "x" * 17: -1.0}          # a tie, and a piece beyond the length
    logp.pop("d", None)
    words = ["", "ab", "d", "😀a\0b", "aab" * 70] + ["▁" + "".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    times, unk = np.arange(1, len(words) + 1), min(logp.values()) - unigram.UNK_PENALTY
    trie, pieces = unigram.build_trie(logp), Pieces(logp, unigram.MAX_PIECE_LEN, unk)
    piece, c, z = pieces.expected(words, times)
    got = Counter()
    for p, x in zip(piece.tolist(), np.rint(c * unigram.UNITS).tolist()):
        got[pieces.names[p]] += x
    want = Counter()
    for w, n, ll in zip(words, times.tolist(), z):
        counts, one = unigram.forward_backward(w, trie, unk_logp=unk)
        assert abs(one - ll) < 1e-9
        want.update({p: round(n * x * unigram.UNITS) for p, x in counts.items()})
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 2 for p in want)
    found, n = pieces.best(words)
    one_by_one = [unigram.viterbi(w, trie, unk_logp=unk)[0] for w in words]
    assert n.tolist() == [len(s) for s in one_by_one]
    assert [pieces.names[p] if p >= 0 else None for p in found.tolist()] == [p if p in logp else None for s in one_by_one for p in s]
    assert [x.tolist() for x in Pieces({}, 16, -1.0).best(["ab", ""])] == [[-1, -1], [2, 0]]


@pytest.mark.parametrize("kind", ["bpe", "unigram", "char", "word"])
def test_trainers_take_counted_words(spark, kind):
    from textlab.operators.tokenizers import registry
    plain = spark.createDataFrame([(w,) for w in _unigram_words()], "word STRING")
    once = plain.groupBy("word").agg(F.count("*").alias("n"))
    train = registry.get(kind).train
    assert train(once, 40).orderBy("id").collect() == train(plain, 40).orderBy("id").collect()


def test_the_text_is_cut_up_once_for_all_trainers(spark, monkeypatch):
    from textlab.plans import tokenize as TK
    cut = []
    monkeypatch.setattr(TK, "words", lambda s, d: cut.append(d) or s.createDataFrame([(w,) for w in _unigram_words()], "word STRING"))
    for kind in ("word", "char", "bpe"):
        assert TK.train(spark, "words-once", kind, 40).count() > 4
    assert cut == ["words-once"]


def test_token_statistics_write_numbers_only(spark, monkeypatch):
    from textlab.plans import tokenize as TK
    rows = [(1, "The cat, the cat", "a cat"), (2, None, ""), (2, "...", None), (4, "dog_1 x", "zebra")]
    monkeypatch.setattr(TK, "train_rows", lambda s, d: s.createDataFrame(rows, "doc_id long, cleaned_text string, highlights string"))
    monkeypatch.setattr(TK, "train", lambda s, d, kind: s.createDataFrame(
        [(4, "▁the", 0.0), (5, "▁cat", 0.0), (6, "▁x", 0.0), (7, "▁a", 0.0)], "id int, piece string, score double"))
    first = TK.train_stats(spark, "numbers-a", "word")
    assert not TK.has_stage(spark, TK._train_key("numbers-a", "word"))               # counted as they are made
    enc = TK.train_encoded(spark, "numbers-b", "word")
    assert "string" not in [t for _, t in [*first.dtypes, *enc.dtypes]]
    then = TK.train_stats(spark, "numbers-b", "word")                              # read from the table
    order = ["doc_id", "cleaned_len", "token_article_len"]
    assert then.orderBy(order).collect() == first.orderBy(order).collect()
    got = [tuple(r) for r in TK.with_compression(first).orderBy(order).select(
        "doc_id", "cleaned_len", "token_article_len", "article_unk", "token_highlight_len", "summary_unk", "compression").collect()]
    assert got == [(1, 4, 4, 2, 2, 0, 1.0), (2, 0, 0, 0, 0, 0, None), (2, 0, 1, 1, 0, 0, None), (4, 2, 2, 1, 1, 1, 1.0)]


def test_encoded_corpus_has_no_texts(spark, monkeypatch):
    from textlab.plans import tokenize as TK
    monkeypatch.setattr(TK, "corpus", lambda s, d: s.createDataFrame([(1, "train", "a b", None)], "doc_id long, split string, cleaned_text string, highlights string"))
    monkeypatch.setattr(TK, "train", lambda s, d, kind: s.createDataFrame([(4, "▁a", 0.0)], "id int, piece string, score double"))
    assert [r.asDict() for r in TK.encoded(spark, "no-texts", "word").collect()] == [{"doc_id": 1, "split": "train", "article_ids": [4, 1], "highlight_ids": []}]


def test_length_filter_counts_words_once_for_all_rules(spark, tmp_path):
    from textlab.operators import filters as FL
    rows = [(1, "w " * 300, "w " * 30), (2, "w " * 250, "w " * 30), (3, "w " * 300, "w"), (4, "w " * 300, "w " * 151), (5, None, "w"), (6, "", None), (7, "w " * 251, None),
            (8, "w " * 300, "w " * 15), (9, "w " * 300, "w " * 150)]
    spark.createDataFrame(rows, "id int, a string, h string").write.parquet(str(tmp_path / "t"))
    d = FL.with_pair_lengths(spark.read.parquet(str(tmp_path / "t")), "a", "h", unit="word")
    kept = FL.filter_len_ratio(d)
    assert sorted(r["id"] for r in kept.collect()) == sorted(r["id"] for r in d.where(FL.keep_mask()).collect()) == [1, 8, 9]
    plan = kept.select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all") + plan.count("regexp_count") <= 3


def test_words_are_stretches_without_white_space(spark):
    from textlab.functions import text as TX
    pieces = ["a", "é", "!", "~", "_", "\x7f", "\x1b", "😀", "\\", "]", " ", "\n", "\u00a0", "\u2003", "\x00", "\x1c", "\x85", "\u200b"]
    rnd = random.Random(4)
    texts = [None, "", " ", "\n\n"] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", TX.word_len_ws("t").alias("n"))
    assert d.where(F.col("n") != F.regexp_count(F.coalesce("t", F.lit("")), F.lit("[^" + TX.WS + "]+"))).count() == 0 and d.where("n > 1").count() > 100
