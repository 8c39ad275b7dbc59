"""Unigram-LM tokenizer (K4 training, K8 Viterbi encoding), after Kudo (2018).

Training runs on the table of distinct training words with counts:

* characters outside the ``coverage`` of all characters get no piece; a word's lattice crosses them at a fixed cost;
* seeds: the substrings (2..16 characters) that occur twice or more, weighted by ``count * length``. A batch's words are cut up
  at once as flat arrays, it emits its own counts, and a ``groupBy`` adds them up; the ``seed_size`` heaviest, and every covered character, are the first pieces;
* E-step: forward-backward over the words' segmentation lattices, thousands of words at once as flat arrays (``lattice.py``); a
  partition emits whole-number sums of expected counts, so that no order of summation shows in the result;
* M-step and pruning are queries on the piece table: log-probabilities ``log(c / sum c)``, and a piece's loss, its
  expected count times the log-probability it adds over its best segmentation by other pieces. The pieces of largest
  loss stay, 75 % a round, until the target is reached; characters always stay.

What a step needs of the model, the piece table of at most ``seed_size`` rows and the alphabet, is a broadcast variable.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators.common import attach
from textlab.operators.tokenizers.arrow import UNK, encode_words
from textlab.operators.tokenizers.lattice import POINTS, Pieces, _flat
from textlab.operators.tokenizers.vocab import SPACE, SPECIAL_PIECES, counted, piece_ids, specials
from textlab.session import conf_override, materialize, partitions_for, release

# --- fixed values -----------------------------------------------------------
MAX_PIECE_LEN = 16
SEED_SIZE = 100_000
COVERAGE = 0.9995
EM_STEPS = 2
SHRINK = 0.75
UNK_PENALTY = 10.0
ROOM = 1.1
# ----------------------------------------------------------------------------
UNITS = 1 << 20                 # whole-number parts of an expected count
WORDS_AT_ONCE = 2500            # words whose lattices are held as flat arrays

NEG_INF = float("-inf")
_LP = ""  # key of a piece's log-probability inside a trie node (never a character)


def _logsumexp(vals: list) -> float:
    if len(vals) == 1:
        return vals[0]
    if not vals:
        return NEG_INF
    m = max(vals)
    if m == NEG_INF:
        return NEG_INF
    return m + math.log(sum(math.exp(v - m) for v in vals))


def build_trie(logp: dict) -> dict:
    """Character trie of the pieces; a node holds its piece's log-probability under ``_LP``."""
    root: dict = {}
    for p, lp in logp.items():
        node = root
        for ch in p:
            node = node.setdefault(ch, {})
        node[_LP] = lp
    return root


def lattice(w: str, trie: dict, max_len: int = MAX_PIECE_LEN, unk_logp: float | None = None) -> list:
    """Edges (end, piece, log p) of ``w`` from every start, found by walking the trie (only prefixes of pieces are visited). A
    character without a piece is crossed at ``unk_logp``, if given, by an edge without a piece."""
    n = len(w)
    starts: list = []
    for i in range(n):
        node, edges = trie, []
        for j in range(i, min(n, i + max_len)):
            node = node.get(w[j])
            if node is None:
                break
            lp = node.get(_LP)
            if lp is not None:
                edges.append((j + 1, w[i:j + 1], lp))
        if unk_logp is not None and not (edges and edges[0][0] == i + 1):
            edges.append((i + 1, None, unk_logp))
        starts.append(edges)
    return starts


def forward_backward(w: str, trie: dict, max_len: int = MAX_PIECE_LEN, unk_logp: float | None = None):
    """Expected piece counts for one word and its log-likelihood."""
    n, starts = len(w), lattice(w, trie, max_len, unk_logp)
    into: list = [[] for _ in range(n + 1)]
    alpha = [NEG_INF] * (n + 1)
    alpha[0] = 0.0
    for i in range(n):
        if i:
            alpha[i] = _logsumexp(into[i])
        if alpha[i] != NEG_INF:
            for j, _, lp in starts[i]:
                into[j].append(alpha[i] + lp)
    z = _logsumexp(into[n]) if n else 0.0
    if z == NEG_INF:
        return {}, NEG_INF
    beta = [NEG_INF] * n + [0.0]
    counts: dict = {}
    for i in range(n - 1, -1, -1):
        beta[i] = _logsumexp([lp + beta[j] for j, _, lp in starts[i] if beta[j] != NEG_INF])
        if alpha[i] == NEG_INF:
            continue
        for j, p, lp in starts[i]:
            if p is not None and beta[j] != NEG_INF:
                counts[p] = counts.get(p, 0.0) + math.exp(alpha[i] + lp + beta[j] - z)
    return counts, z


def viterbi(w: str, trie: dict, max_len: int = MAX_PIECE_LEN, exclude: str | None = None, unk_logp: float | None = None):
    """Best segmentation of ``w`` (list of pieces) and its log-probability.

    Characters without a piece become single-character pieces scored
    ``unk_logp`` when given (encoding), otherwise they make ``w`` unsegmentable.
    """
    n, starts = len(w), lattice(w, trie, max_len, unk_logp)
    best, back = [NEG_INF] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] == NEG_INF:
            continue
        for j, p, lp in starts[i]:
            if best[i] + lp > best[j] and (exclude is None or p != exclude):
                best[j], back[j] = best[i] + lp, i
    if best[n] == NEG_INF:
        return None, NEG_INF
    out, j = [], n
    while j > 0:
        out.append(w[back[j]:j])
        j = back[j]
    return out[::-1], best[n]


# ---- training ------------------------------------------------------------------------

def alphabet(state: DataFrame, coverage: float) -> DataFrame:
    """(piece, n): the most frequent characters until ``coverage`` of all is reached (ties by code point)."""
    counts = state.select(F.explode(F.split("w", "")).alias("piece"), "n").where("piece <> ''").groupBy("piece").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    w = Window.orderBy(F.desc("n"), "piece").rowsBetween(Window.unboundedPreceding, -1)          # the alphabet: a few thousand rows
    return attach(counts, total).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(
        F.col("before") < F.lit(coverage) * F.col("total")).select("piece", "n")


def substrings(words, times, covered: np.ndarray, max_len: int):
    """(substrings, n): what the words have of 2 to ``max_len`` ``covered`` code points, once each, with the sums of ``times``. A substring is the
    number of the one without its last character, and that character."""
    codes, size, first = _flat(words)
    text, place, word = "".join(words), np.arange(len(codes)), np.repeat(np.arange(len(words)), size)
    stop = np.where(np.isin(codes, covered), len(codes), place)              # of the stretch of covered characters
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], (first + size)[word])
    at, node, found, n = place, codes, [], [np.empty(0, np.int64)]
    for length in range(2, max_len + 1):
        live = stop[at] - at >= length
        at, node = at[live], node[live]
        if not len(at):
            break
        keys, one, node = np.unique(node * POINTS + codes[at + length - 1], return_index=True, return_inverse=True)
        n.append(np.zeros(len(keys), np.int64))
        np.add.at(n[-1], node, times[word[at]])
        found += [text[i:i + length] for i in at[one].tolist()]
    return found, np.concatenate(n)


def seed_pieces(state: DataFrame, seed_size: int, coverage: float = COVERAGE, max_len: int = MAX_PIECE_LEN) -> DataFrame:
    """(piece, n): the covered characters, and the ``seed_size`` heaviest substrings of them that occur more than once."""
    chars = materialize(alphabet(state, coverage), "unigram_chars")
    known = state.sparkSession.sparkContext.broadcast({r["piece"] for r in chars.collect()})

    def subs(batches):
        covered = np.array(sorted(map(ord, known.value)), np.int64)
        for b in batches:
            pieces, n = substrings(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), covered, max_len)
            yield pa.record_batch({"piece": pa.array(pieces, pa.string()), "n": pa.array(n, pa.int64())})

    counts = state.select("w", "n").mapInArrow(subs, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    heavy = counts.orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(seed_size)
    return chars.unionByName(heavy)


class _Model:
    """The piece table as a broadcast trie, for one step."""

    def __init__(self, table: DataFrame):
        rows = table.select("piece", "logp").collect()                   # at most seed_size and the alphabet
        self.shared = table.sparkSession.sparkContext.broadcast({r["piece"]: r["logp"] for r in rows})


def _trie_of(shared):
    logp = shared.value
    return build_trie(logp), min(logp.values(), default=0.0) - UNK_PENALTY


def _pieces_of(shared, max_len: int) -> Pieces:
    logp = shared.value
    return Pieces(logp, max_len, min(logp.values(), default=0.0) - UNK_PENALTY)


def _estep(state: DataFrame, table: DataFrame, max_len: int) -> DataFrame:
    """(piece, c, ll): expected counts in whole numbers of 1 / UNITS; the row without a piece has the likelihood, in the same units."""
    shared = _Model(table).shared

    def run(batches):
        pieces = _pieces_of(shared, max_len)
        acc, ll = [0] * len(pieces.names), 0
        for b in batches:
            total = np.zeros(len(acc), np.int64)
            for i in range(0, len(b), WORDS_AT_ONCE):
                part = b.slice(i, WORDS_AT_ONCE)
                n = part.column(1).to_numpy(zero_copy_only=False)
                piece, c, z = pieces.expected(part.column(0).to_pylist(), n)
                np.add.at(total, piece, np.rint(c * UNITS).astype(np.int64))
                ll += sum(np.rint(n * z * UNITS).astype(np.int64).tolist())
            for p in np.flatnonzero(total).tolist():
                acc[p] += int(total[p])
        seen = [i for i, c in enumerate(acc) if c]
        yield pa.record_batch({"piece": pa.array([*(pieces.names[i] for i in seen), None], pa.string()),
                               "c": pa.array([*(acc[i] for i in seen), ll], pa.decimal128(38, 0))})

    return state.select("w", "n").mapInArrow(run, "piece string, c decimal(38,0)").groupBy("piece").agg(F.sum("c").cast("decimal(38,0)").alias("c"))


def _mstep(counts: DataFrame, table: DataFrame) -> DataFrame:
    """(piece, c, logp): log shares of the expected counts; pieces without any go, but characters keep a floor."""
    have = counts.where("piece is not null and c > 0")
    total = have.agg(F.sum("c").cast("double").alias("total"), F.min("c").cast("double").alias("least"))
    lp = F.round(F.when(F.col("c") > 0, F.log(F.col("c").cast("double")) - F.log("total")).otherwise(
        F.log("least") - F.log("total") - F.lit(UNK_PENALTY)), 9)
    kept = table.select("piece").join(have, "piece", "left").where((F.col("c") > 0) | (F.length("piece") == 1))
    return attach(kept, total).select("piece", F.coalesce(F.col("c"), F.lit(0)).cast("decimal(38,0)").alias("c"), lp.alias("logp"))


def _losses(table: DataFrame, max_len: int) -> DataFrame:
    """The pieces of two characters and more with the ``loss`` of leaving each out."""
    shared = _Model(table).shared

    def run(batches):
        trie, _ = _trie_of(shared)
        for b in batches:
            loss = []
            for p, c, lp in zip(*(x.to_pylist() for x in b.columns)):
                _, alt = viterbi(p, trie, max_len, exclude=p)
                loss.append(c * (lp - alt) if alt != NEG_INF else float("inf"))
            yield pa.record_batch({"piece": b.column(0), "logp": b.column(2), "loss": pa.array(loss, pa.float64())})

    long = table.where(F.length("piece") > 1).select("piece", F.col("c").cast("double").alias("c"), "logp")
    return long.repartition("piece").mapInArrow(run, "piece string, logp double, loss double")


def train_unigram(words: DataFrame, vocab_size: int, seed_size: int | None = SEED_SIZE, max_len: int = MAX_PIECE_LEN,
                  em_steps: int = EM_STEPS, shrink: float = SHRINK, coverage: float = COVERAGE, history: list | None = None,
                  rows_per_partition: int = 20_000) -> DataFrame:
    """K4: vocabulary = 4 specials + pieces by log-probability (score = log p). ``history`` receives (pieces, likelihood) of every E-step."""
    spark = words.sparkSession
    counts = materialize(counted(words).select(F.concat(F.lit(SPACE), F.col("word")).alias("w"), "n"), "unigram_words")
    n_parts = partitions_for(spark, counts.count(), rows_per_partition)      # by distinct words: the E-step is CPU-bound
    state = materialize(counts.repartition(n_parts, "w"), "unigram")
    release(counts)
    target = max(1, vocab_size - len(SPECIAL_PIECES))
    room = math.ceil(ROOM * target)                # EM stops a little above the target, as pieces may lose all their counts
    # EM rounds are a fixed loop of small jobs: static plans, no adaptive re-planning
    with conf_override(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(n_parts)}):
        seeds = materialize(seed_pieces(state, seed_size or SEED_SIZE, coverage, max_len), "unigram_seeds")
        total = seeds.agg(F.sum("n").cast("double").alias("total"))
        table = materialize(attach(seeds, total).select("piece", F.round(F.log(F.col("n") / F.col("total")), 9).alias("logp")), "unigram_pieces")
        release(seeds)
        table = _em_prune(state, table, room, max_len, em_steps, shrink, history)
    release(state)
    # characters always stay: where the pieces are more than the target, others give way
    top = table.orderBy(F.desc(F.length("piece") == 1), F.desc("logp"), "piece").limit(target)
    w = Window.orderBy(F.desc("logp"), "piece")                              # at most vocab_size rows
    ranked = top.select((F.row_number().over(w) + len(SPECIAL_PIECES) - 1).cast("int").alias("id"), "piece", F.round("logp", 6).alias("score"))
    return specials(spark).unionByName(ranked)


def _em_prune(state, table, target, max_len, em_steps, shrink, history) -> DataFrame:
    while True:
        for _ in range(em_steps):
            counts = materialize(_estep(state, table, max_len), "unigram_counts")
            if history is not None:
                ll = counts.where("piece is null").first()
                history.append((table.count(), float(ll["c"]) / UNITS if ll else 0.0))
            before, table = table, materialize(_mstep(counts, table), "unigram_pieces")
            release(before, counts)
        n = table.count()
        if n <= target:
            return table
        chars = table.where(F.length("piece") == 1)
        keep = max(target, math.ceil(n * shrink)) - chars.count()
        if keep <= 0:                          # characters alone fill the vocabulary
            return chars
        kept = _losses(table, max_len).orderBy(F.desc("loss"), "piece").limit(keep)
        before, table = table, materialize(kept.select("piece", "logp").unionByName(chars.select("piece", "logp")), "unigram_pieces")
        release(before)


def encode_unigram(df: DataFrame, col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """K8: Viterbi segmentation of each whitespace word under the piece log-probabilities; map-only, a task segments every distinct word once."""
    scores = getattr(vocab, "shared_scores", None)
    if scores is None:
        rows = vocab.where(F.col("id") >= len(SPECIAL_PIECES)).select("piece", "score").collect()          # at most vocab_size
        scores = vocab.shared_scores = vocab.sparkSession.sparkContext.broadcast({r["piece"]: float(r["score"]) for r in rows})

    def segmenter(d: dict):
        pieces = _pieces_of(scores, MAX_PIECE_LEN)
        ids = np.array([*(d.get(p, UNK) for p in pieces.names), UNK], np.int32)

        def segment(words):
            out = []
            for i in range(0, len(words), WORDS_AT_ONCE):
                found, n = pieces.best([SPACE + w for w in words[i:i + WORDS_AT_ONCE]])
                flat, end = ids[found].tolist(), np.cumsum(n).tolist()
                out += [tuple(flat[a:z]) for a, z in zip([0, *end], end)]
            return out
        return segment
    return df.withColumn(out, encode_words(piece_ids(vocab), segmenter)(F.coalesce(F.col(col), F.lit(""))))
