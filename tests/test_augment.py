"""Augmentation: Spark job vs a plain-Python statement of the same rules."""

import hashlib
import math
import re

import pytest

from textlab.operators import augment as AG

LEX = [("run", "VERB"), ("race", "VERB"), ("rush", "VERB"), ("fast", "ADJ"), ("fine", "ADJ"), ("the", "DET"), ("very", "ADV"),
       ("jump", "VERB"), ("cat", "NOUN"), ("rare", "VERB"), ("fresh", "ADJ")]                  # by rank


def synonyms(word):
    """The other entries of a word's POS and first letter, in order."""
    pos = dict(LEX).get(word)
    return sorted(w for w, p in LEX if p == pos and w[0] == word[0] and w != word)


def lexicon(spark):
    rows = []
    for i, (w, p) in enumerate(LEX, 1):
        group = sorted(x for x, q in LEX if q == p and x[0] == w[0])
        rows.append((w, p, w[0], i, group.index(w), len(group)))
    return spark.createDataFrame(rows, "token STRING, pos STRING, letter STRING, rank BIGINT, member BIGINT, members BIGINT")


TEXTS = ["The cat will run very fast , then jump .", "Run run RUN fast fresh Rare rare", "", "nothing here matches",
         "the the the run", None, "rush fine " * 300]
PRETOKEN = re.compile(r"\d+|\w+|[^\w\s]")


def py_augment(doc_id, text, ratio=0.15, seed=42):
    lex = {t: (p, synonyms(t)) for t, p in LEX}
    toks = PRETOKEN.findall(text or "")
    rows = []
    for i, t in enumerate(toks):
        if re.fullmatch(r"[^\w]+", t):
            tag, syn = "PUNCT", []
        else:
            tag, syn = lex.get(t.lower(), ("NOUN", []))
        syn = [s for s in syn if s.lower() != t.lower()] if tag in AG.CANDIDATE_POS else []
        rows.append((i, t, tag, syn))
    content = sum(1 for r in rows if r[2] not in AG.NON_CONTENT_POS)
    cands = [r for r in rows if r[2] in AG.CANDIDATE_POS]
    k = min(math.floor(content * ratio), len(cands))
    key = lambda i: f"{seed}:{doc_id}:a:{i}"
    with_syn = sorted([r for r in cands if r[3]], key=lambda r: hashlib.md5(key(r[0]).encode()).hexdigest())
    chosen = {r[0] for r in with_syn[:k]}
    out = []
    for i, t, tag, syn in rows:
        if i in chosen:
            h = int(hashlib.md5((key(i) + ":syn").encode()).hexdigest()[:8], 16)
            out.append(sorted(syn)[h % len(syn)])
        else:
            out.append(t)
    return " ".join(out), len(rows), len(cands), len(chosen), content


@pytest.mark.parametrize("hot", [0, 4, 100])
def test_augment_matches_python(spark, hot):
    df = spark.createDataFrame([(i, "a", t, 7) for i, t in enumerate(TEXTS)], "doc_id BIGINT, field STRING, text STRING, member INT").repartition(3)
    got = {r["doc_id"]: r for r in AG.augment_docs(df, ["doc_id", "field"], "text", lexicon(spark), ratio=0.3, hot=hot).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        text, total, cand, repl, content = py_augment(i, t, ratio=0.3)
        r = got[i]
        assert r["aug_text"] == text
        assert (r["tokens_total"], r["tokens_candidate"], r["tokens_replaced"], r["content_tokens"] or 0) == \
            (total, cand, repl, content)
        assert r["replace_ratio_actual"] == repl / max(1, content)
        assert all(r[f"before_{p}"] == r[f"after_{p}"] for p in AG.TAGS)
    assert got[6]["tokens_replaced"] > 0


def test_chosen_is_a_row_for_a_document_without_window_or_token_rows(spark):
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate(TEXTS)] + [(None, "a", "run fast race")], "doc_id BIGINT, field STRING, text STRING")
    keys = ["doc_id", "field"]
    chosen = AG.choose_replacements(AG.tag_documents(df, keys, "text", lexicon(spark), hot=4), keys, lexicon(spark), ratio=0.3, hot=4)
    assert "Window" not in chosen._jdf.queryExecution().executedPlan().toString()
    rows = {r["doc_id"]: r for r in chosen.collect()}
    assert len(rows) == chosen.count() == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        out = py_augment(i, t, ratio=0.3)[0].split(" ") if t else []
        toks = PRETOKEN.findall(t or "")
        assert [p["token"] for p in rows[i]["picks"]] == [toks[p["pos_in_doc"]] for p in rows[i]["picks"]]
        assert {j for j, (a, b) in enumerate(zip(toks, out)) if a != b} <= {p["pos_in_doc"] for p in rows[i]["picks"]}
        assert len(rows[i]["picks"]) == rows[i]["tokens_replaced"]
    got = AG.with_picks(df, keys, "text", AG.picked(chosen, keys, lexicon(spark))).collect()
    assert all(" ".join(r["out_tokens"]) == py_augment(r["doc_id"], r["text"], ratio=0.3)[0] for r in got if r["doc_id"] is not None)


def test_lexicon_holds_all_words_with_their_places(spark, tmp_path):
    from collections import Counter

    from textlab.sources import tables
    texts = ["the cat sat Sat cats", "the dog 12 x_y ok", None, "", "zebra the", "dot dig den"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["token"]: r for r in tables.lexicon(spark, str(tmp_path)).collect()}
    counts = Counter(w for t in texts for w in PRETOKEN.findall(t or "") if re.fullmatch("[a-z]+", w))
    assert set(got) == set(counts)
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == sorted(counts, key=lambda t: (-counts[t], t))
    for t, r in got.items():
        group = sorted(x for x in got if got[x]["pos"] == r["pos"] and x[0] == t[0])
        assert (r["letter"], r["member"], r["members"]) == (t[0], group.index(t), len(group))
    assert got["dig"]["members"] == 4


def test_token_cosine_sums_frequent_vectors_where_the_texts_are(spark):
    from textlab.operators.vectors import token_cosine
    vec = [("x", [1.0, 0.0]), ("y", [0.0, 2.0]), ("y", [0.0, 1.0]), ("z", [1.0, 1.0]), ("n", None)]
    v = spark.createDataFrame(vec, "token string, vec array<double>")
    docs = spark.createDataFrame([(1, ["X", "y", ","], ["x", "z"]), (2, ["q"], ["x"]), (3, [], None), (4, ["z", "z", "n"], ["Z"]), (None, ["x"], ["y"])],
                                 "id long, a array<string>, b array<string>").repartition(3)
    want = {1: (1 * 2 + 3 * 1) / (math.sqrt(10) * math.sqrt(5)), 4: 1.0, None: 0.0, 2: None, 3: None}
    for frequent in ([], ["y", "z"], ["x", "y", "z", "n"]):
        f = spark.createDataFrame([(w,) for w in frequent], "token string")
        out = token_cosine(docs, ["id"], "a", "b", v, f, "^[a-z]+$")
        got = {r["id"]: r["cosine"] for r in out.collect()}
        assert {k: got.get(k) for k in want} == pytest.approx(want)
