"""Synonym-replacement augmentation.

The lexicon (``token, pos, letter, rank, member, members``) holds all words and is never broadcast whole. Per (document, field):

1. pre-tokens are tagged by the lexicon: the ``HOT_TOKENS`` entries of lowest rank are a broadcast of fixed size; of the other
   words, a document's different ones are looked up by key and come back to it. Punctuation is tagged by
   pattern and unlisted words default to NOUN (G5);
2. candidates are VERB/ADJ/ADV tokens; synonyms are the other members of the entry's group, so their number is
   ``members - 1`` (J4, F6);
3. ``k = min(int(content * ratio), candidates)`` where content excludes
   PUNCT/DET (F7); the candidates that have synonyms are ranked by a seeded
   hash and the first ``k`` are replaced (W5) -- the same outcome as drawing
   candidates without replacement until ``k`` draws have a synonym;
4. a second seeded hash gives the place of the synonym in its group, and a join on (pos, letter, place) fetches it (W6);
   only replaced tokens take part, and their places are spread evenly;
5. the replaced tokens come back to their document as one list and are put into the token array (G1).

Steps 2 and 3 need a document's tokens at once. Texts meet there by key as whole rows, and Arrow batches of them are counted and
ranked as flat arrays: token rows are neither shuffled nor sorted, and only the replaced tokens are written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.text import PRETOKEN_RE, pretokens

# --- fixed values -----------------------------------------------------------
REPLACE_RATIO = 0.15
CANDIDATE_POS = ("VERB", "ADJ", "ADV")
NON_CONTENT_POS = ("PUNCT", "DET")
TAGS = ("VERB", "ADJ", "ADV", "DET", "NOUN", "PUNCT")
RARE_LABELS = ("SCONJ", "INTJ", "X", "SYM", "SPACE")
PUNCT_RE = r"^[^\p{L}\p{N}_]+$"
SEED = 42
# ----------------------------------------------------------------------------
HOT_TOKENS = 50_000         # entries of the lexicon, the most frequent ones, that every task holds
DOCS_AT_ONCE = 500          # documents whose tokens are held as flat arrays
# ----------------------------------------------------------------------------
MARK_RE = PRETOKEN_RE.rsplit("|", 1)[1]         # the pre-tokens that are PUNCT


_ENTRY = ("pos", "letter", "member", "members")


def _rare_words(df: DataFrame, k, text_col: str, lexicon: DataFrame, hot: int) -> DataFrame:
    """``(*keys, __word, __entry)``: the different words of each text that are in the lexicon, but not among its ``hot`` entries."""
    frequent = lexicon.where(F.col("rank") <= hot).select(F.col("token").alias("__hot"))
    rare = lexicon.where(F.col("rank") > hot).select(F.col("token").alias("__rare"), F.struct(*[F.col(c) for c in _ENTRY]).alias("__entry"))
    words = df.select(*k, F.explode(F.array_distinct(F.transform(pretokens(text_col), lambda t: F.lower(t)))).alias("__word"))
    words = words.where(F.col("__word").rlike("^[a-z]+$")).join(F.broadcast(frequent), F.col("__word") == F.col("__hot"), "left_anti")
    return words.join(rare, F.col("__word") == F.col("__rare")).select(*k, "__word", "__entry")


def tag_tokens(df: DataFrame, keys, text_col: str, lexicon: DataFrame, hot: int = HOT_TOKENS) -> DataFrame:
    """``(*keys, pos_in_doc, token, tag, pos, letter, member, members)``; the entry's columns are NULL for words outside the
    lexicon. An empty text is one row without a token."""
    k = list(keys)
    entry = F.struct(*[F.col(c) for c in _ENTRY])
    frequent = lexicon.where(F.col("rank") <= hot).select(F.col("token").alias("__hot"), entry.alias("__hot_entry"))      # at most ``hot`` rows
    found = (_rare_words(df, k, text_col, lexicon, hot).groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(k)])
             .agg(F.map_from_entries(F.collect_list(F.struct("__word", "__entry"))).alias("__found")))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(k)]
    toks = df.select(*k, text_col).repartition(*k).join(found, same, "left").select(
        *k, F.posexplode_outer(pretokens(text_col)).alias("pos_in_doc", "token"), "__found")
    word = F.lower(F.col("token"))
    t = toks.join(F.broadcast(frequent), word == F.col("__hot"), "left")
    e = F.coalesce(F.col("__hot_entry"), F.when(F.col("__found").isNotNull(), F.try_element_at("__found", word)))
    t = t.select(*k, "pos_in_doc", "token", e.alias("__e"))
    tag = (F.when(F.col("token").isNull(), F.lit(None))
           .when(F.col("token").rlike(PUNCT_RE), "PUNCT")
           .otherwise(F.coalesce(F.col("__e.pos"), F.lit("NOUN"))))
    return t.select(*k, "pos_in_doc", "token", tag.alias("tag"), *[F.col(f"__e.{c}").alias(c) for c in _ENTRY])


def tag_documents(df: DataFrame, keys, text_col: str, lexicon: DataFrame, hot: int = HOT_TOKENS) -> DataFrame:
    """G5 for whole documents: ``(*keys, texts, marks, found)``, one row for a key: the pre-tokens of its texts, the different ones that are
    PUNCT, and the entries of its words outside the ``hot`` ones."""
    k = list(keys)
    found = F.struct("__word", *[F.col(f"__entry.{c}").alias(c) for c in _ENTRY])
    rare = _rare_words(df, k, text_col, lexicon, hot).select(*k, F.lit(None).cast("string").alias("__text"), found.alias("__found"))
    both = df.select(*k, F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.lit(None).cast(rare.schema["__found"].dataType).alias("__found")).unionByName(rare)
    docs = both.repartition(*k).groupBy(*k).agg(F.collect_list("__text").alias("__texts"), F.collect_list("__found").alias("found"))
    marks = F.array_distinct(F.flatten(F.transform("__texts", lambda t: F.regexp_extract_all(t, F.lit(MARK_RE), 0))))
    return docs.select(*k, F.transform("__texts", lambda t: pretokens(t)).alias("texts"), marks.alias("marks"), "found")


def _flat(lists: pa.Array):
    """(values, offsets from 0) of a list array, which may be a slice."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten(), offsets - offsets[0]


def _entries(found, frequent):
    """(words, pos, letters, member, members): the frequent entries and those in ``found``, each once."""
    words, entry = found.field(0), [found.field(i) for i in range(1, 5)]
    _, first = np.unique(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), return_index=True)
    return [pa.concat_arrays([f, x.take(pa.array(first))]) for f, x in zip(frequent, [words, *entry])]


def _chosen_places(salt: str, places, members, member, k: int):
    """(indices of the ``k`` places of least hash, the place of each one's synonym in its group)."""
    start = hashlib.md5(f"{salt}:".encode())
    digests = []
    for i, at in enumerate(places):
        h = start.copy()
        h.update(b"%d" % at)
        digests.append((h.digest(), i))
    out = sorted(i for _, i in sorted(digests)[:k])
    picks = []
    for i in out:
        at = int.from_bytes(hashlib.md5(f"{salt}:{places[i]}:syn".encode()).digest()[:4], "big") % (members[i] - 1)
        picks.append(at + (at >= member[i]))
    return out, picks


_PICK = "struct<pos_in_doc:int,token:string,tag:string,pos:string,letter:string,pick:bigint>"
_REPLACED = ("ADJ", "ADV", "VERB")
_COUNTS = ("tokens_total", "tokens_candidate", "tokens_replaced", "content_tokens", *[f"replaced_{p}" for p in _REPLACED],
           *[f"before_{p}" for p in TAGS], *[f"after_{p}" for p in TAGS])


def choose_replacements(tagged: DataFrame, keys, lexicon: DataFrame, ratio: float = REPLACE_RATIO, seed: int = SEED, hot: int = HOT_TOKENS) -> DataFrame:
    """F6, F7, W5 on ``tag_documents``: a row for a key with its counts (see ``augment_docs``) and ``picks``, its replaced tokens; ``pick`` is
    the place of the synonym in its group."""
    k = list(keys)
    rows = lexicon.where(F.col("rank") <= hot).select("token", *_ENTRY).toArrow().combine_chunks()          # at most ``hot`` rows
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = [rows.column(i).cast(t).combine_chunks() for i, t in enumerate(types)]
    shared = tagged.sparkSession.sparkContext.broadcast([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns])

    def choose(b: pa.RecordBatch) -> pa.RecordBatch:
        lists, outer = _flat(b.column("texts"))
        flat, inner = _flat(lists)
        start = inner[outer]                                                # first token of every document, and the end
        doc = np.repeat(np.arange(len(b)), np.diff(start))
        place = np.arange(len(flat)) - np.repeat(inner[:-1], np.diff(inner))
        found = b.column("found").flatten()
        words, pos, letters, member, members = _entries(found.cast(pa.struct([(f.name, t) for f, t in zip(found.type, types)])), shared.value)
        at = pc.fill_null(pc.index_in(pc.utf8_lower(flat), value_set=words), len(words)).to_numpy(zero_copy_only=False)
        code = {p: i for i, p in enumerate(TAGS)}
        code |= {p: len(TAGS) + i for i, p in enumerate(sorted(set(pc.unique(pos).to_pylist()) - set(TAGS)))}
        named = np.array([*(code[p] for p in pos.to_pylist()), code["NOUN"]])
        tag = named[at]
        tag[pc.is_in(flat, value_set=pc.unique(b.column("marks").flatten())).to_numpy(zero_copy_only=False)] = code["PUNCT"]
        count = np.bincount(doc * len(code) + tag, minlength=len(b) * len(code)).reshape(len(b), len(code))
        candidates = sum(count[:, code[p]] for p in CANDIDATE_POS)
        content = count.sum(axis=1) - sum(count[:, code[p]] for p in NON_CONTENT_POS)
        most = np.minimum(np.floor(content * ratio).astype(np.int64), candidates)
        group, member = (np.append(x.to_numpy(zero_copy_only=False), 0) for x in (members, member))
        able = np.flatnonzero(np.isin(tag, [code[p] for p in CANDIDATE_POS]) & (group[at] > 1))
        ends = np.searchsorted(able, start)
        which, picks, n = [], [], []
        for salt, a, z, some in zip(b.column("__salt").to_pylist(), ends[:-1], ends[1:], most.tolist()):
            mine = able[a:z]
            out, found_at = _chosen_places(salt, place[mine].tolist(), group[at[mine]].tolist(), member[at[mine]].tolist(), some) if some else ([], [])
            which.append(mine[out])
            picks += found_at
            n.append(len(out))
        which = np.concatenate(which) if which else np.empty(0, np.int64)
        replaced = np.bincount(doc[which] * len(code) + tag[which], minlength=count.size).reshape(count.shape)
        names, entry = pa.array(list(code)), pa.array(at[which])
        chosen = pa.StructArray.from_arrays(
            [pa.array(place[which].astype(np.int32)), flat.take(pa.array(which)), names.take(pa.array(tag[which])), pos.take(entry), letters.take(entry),
             pa.array(picks, pa.int64())], ["pos_in_doc", "token", "tag", "pos", "letter", "pick"])
        # a synonym has the POS of its group, that of the word it replaces
        by_tag = [count[:, code[p]] for p in TAGS]
        counts = [count.sum(axis=1), candidates, np.array(n), content, *[replaced[:, code[p]] for p in _REPLACED], *by_tag, *by_tag]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), chosen)
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in k], *[pa.array(x.astype(np.int64)) for x in counts], lists], [*k, *_COUNTS, "picks"])

    def run(batches):
        for b in batches:
            for i in range(0, len(b), DOCS_AT_ONCE):
                yield choose(b.slice(i, DOCS_AT_ONCE))

    salt = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in k])
    schema = ", ".join([f"`{c}` {tagged.schema[c].dataType.simpleString()}" for c in k] + [f"{c} bigint" for c in _COUNTS] + [f"picks array<{_PICK}>"])
    return tagged.withColumn("__salt", salt).mapInArrow(run, schema)


def picked(chosen: DataFrame, keys, lexicon: DataFrame) -> DataFrame:
    """``(*keys, pos_in_doc, token, tag, out_token, out_tag)`` of the replaced tokens."""
    by_place = lexicon.select("pos", "letter", F.col("member").alias("pick"), F.col("token").alias("out_token"))
    return (chosen.select(*keys, F.explode("picks").alias("__p")).select(*keys, "__p.*")
            .join(by_place, ["pos", "letter", "pick"]).select(*keys, "pos_in_doc", "token", "tag", "out_token", F.col("pos").alias("out_tag")))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _put(tokens: pa.Array, picks: pa.Array) -> pa.Array:
    """The token arrays with the picked tokens in their places."""
    out = []
    for i in range(0, len(tokens), DOCS_AT_ONCE):
        flat, offsets = _flat(tokens.slice(i, DOCS_AT_ONCE))
        part = picks.slice(i, DOCS_AT_ONCE)
        n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        new = part.flatten()
        at = np.repeat(offsets[:-1], n) + new.field("pos_in_doc").to_numpy(zero_copy_only=False).astype(np.int64)
        if len(np.unique(at)) < len(at):
            raise ValueError("two replacements for one token: the keys of the documents repeat")
        source = np.arange(len(flat))
        source[at] = len(flat) + np.arange(len(at))
        values = pa.concat_arrays([flat.cast(pa.string()), new.field("out_token").cast(pa.string())]).take(pa.array(source))
        out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def _picks_by_key(picks: DataFrame, names) -> DataFrame:
    return picks.groupBy(*[F.col(c).alias(n) for c, n in names]).agg(F.collect_list(F.struct("pos_in_doc", "out_token")).alias("__picks"))


def with_picks(df: DataFrame, keys, text_col: str, picks: DataFrame, out: str = "out_tokens") -> DataFrame:
    """``df`` with the token array of ``text_col`` after the replacements."""
    names = [(c, f"__k{i}") for i, c in enumerate(keys)]
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names]
    return df.join(_picks_by_key(picks, names), same, "left").withColumn(out, _put(pretokens(text_col), F.col("__picks"))).drop("__picks", *[n for _, n in names])


def augment_docs(df: DataFrame, keys, text_col: str, lexicon: DataFrame, ratio: float = REPLACE_RATIO,
                 seed: int = SEED, chosen: DataFrame | None = None, picks: DataFrame | None = None, hot: int = HOT_TOKENS) -> DataFrame:
    """G1-G3 + A14 inputs: augmented text and per-document statistics.

    Output: keys, ``aug_text``, tokens_total, tokens_candidate, tokens_replaced,
    content_tokens, replace_ratio_actual, replaced_{ADJ,ADV,VERB} and per-tag
    counts before/after (``before_<TAG>``, ``after_<TAG>``). ``chosen`` and ``picks`` may be given where they are written already.
    """
    k = list(keys)
    chosen = chosen if chosen is not None else choose_replacements(tag_documents(df, k, text_col, lexicon, hot), k, lexicon, ratio, seed, hot)
    picks = picks if picks is not None else picked(chosen, k, lexicon)
    # texts, counts and picks meet by the same keys, so that a text moves once; a document without a key has no row
    g = df.select(*k, text_col).join(chosen.drop("picks"), k).join(_picks_by_key(picks, [(c, c) for c in k]), k, "left")
    return g.select(*k, F.array_join(_put(pretokens(text_col), F.col("__picks")), " ").alias("aug_text"), *_COUNTS).withColumn(
        "replace_ratio_actual", F.col("tokens_replaced") / F.greatest(F.lit(1), F.col("content_tokens")).cast("double"))


def pos_distribution(docs: DataFrame, keys, phase: str) -> DataFrame:
    """Per-document normalized tag counts, long format ``(*keys, tag, share)``; empty document -> no rows."""
    long = docs.select(*keys, "tokens_total", F.explode(F.array(*[
        F.struct(F.lit(p).alias("tag"), F.col(f"{phase}_{p}").alias("n")) for p in TAGS])).alias("s"))
    long = long.where((F.col("s.n") > 0) & (F.col("tokens_total") > 0))
    return long.select(*keys, F.col("s.tag").alias("tag"),
                       (F.col("s.n") / F.col("tokens_total").cast("double")).alias("share"))


def pos_corpus_share(dist: DataFrame) -> DataFrame:
    """Sum of per-document shares per tag, renormalized to 1."""
    s = dist.groupBy("tag").agg(F.sum("share").alias("s"))
    tot = s.agg(F.sum("s").alias("t"))
    from textlab.operators.common import attach
    return attach(s, tot).select("tag", (F.col("s") / F.col("t")).alias("share"))


def rare_to_other(shares: DataFrame, label_col: str, value_col: str, rare=RARE_LABELS) -> DataFrame:
    """Fold the listed labels into ``Other``."""
    lab = F.when(F.col(label_col).isin(*rare), F.lit("Other")).otherwise(F.col(label_col))
    return shares.groupBy(lab.alias(label_col)).agg(F.sum(value_col).alias(value_col))


def pos_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outer-aligned before/after shares, missing -> 0, with the change."""
    j = before.select("tag", F.col("share").alias("before")).join(
        after.select("tag", F.col("share").alias("after")), "tag", "full_outer")
    j = j.select("tag", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return j.withColumn("delta", F.col("after") - F.col("before"))
