"""Byte-pair-encoding tokenizer (K3 training, K7 encoding).

Training state is the table of *distinct* training words with their count and current symbols; words of one
symbol leave it. Plain BPE takes one pair at a time: the most frequent one, ties to the shorter, then
smaller piece. Here an *epoch* takes many such steps from a few jobs, with the same result:

1. the pairs are counted (``groupBy``, map-side sums), and the best ``K`` reach the driver;
2. words are cut into *runs*, maximal stretches in which every adjacent pair is one of the K, and equal runs are
   summed. K is halved until the runs are few enough for the driver, whatever the size of the corpus;
3. the driver takes plain BPE steps on the runs while the best pair there comes before the first pair that was left out.
   A pair across the end of a run stands for a pair that was left out, so it counts at most as much, and is longer where it
   counts the same: it would not have been taken either;
4. the merges are applied to the words, in order, in one pass.

Steps 2 and 4 and the encoding work on a batch's words at once, as flat arrays (``merges.py``); ``cut_runs``, ``apply_in_order`` and
``bpe_segment`` say for one word what they do.

The argument in 3 fails where a merge spells a symbol that exists already, as the two may add up with a neighbour.
For the pieces that may do so, the largest sum is computed from the pair table, and the epoch ends
before a count that does not exceed it; after any other such merge it ends at once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.tokenizers.arrow import UNK, encode_words
from textlab.operators.tokenizers.lattice import _flat as flat_points
from textlab.operators.tokenizers.merges import Merges, lists_of_strings, numbered
from textlab.operators.tokenizers.merges import runs as cut_all
from textlab.operators.tokenizers.vocab import SPACE, SPECIAL_PIECES, VOCAB_SCHEMA, counted, piece_ids, specials
from textlab.session import conf_override, materialize, partitions_for, release

# --- fixed values -----------------------------------------------------------
MAX_PIECE_LEN = 16
# ----------------------------------------------------------------------------
START_PAIRS = 256               # K of the first epoch
MAX_PAIRS = 8192                # largest K
RUN_SYMBOLS = 1_000_000         # symbols of the different runs that reach the driver
WORDS_AT_ONCE = 10_000          # words that are segmented as flat arrays


def order_key(a: str, b: str, c: int):
    """Plain BPE's order of pairs: count, then the shorter, then the smaller piece, then the shorter first part."""
    return -c, len(a) + len(b), a + b, len(a)


def pair_counts(state: DataFrame, max_piece_len: int = MAX_PIECE_LEN) -> DataFrame:
    """(a, b, c) of all adjacent symbols that make a piece of at most ``max_piece_len``."""
    sym = F.col("sym")
    m = F.greatest(F.size(sym) - 1, F.lit(0))
    z = F.arrays_zip(F.slice(sym, 1, m).alias("a"), F.slice(sym, 2, m).alias("b"))
    p = state.select(F.explode(z).alias("p"), "n").select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), "n")
    return p.where(F.length("a") + F.length("b") <= max_piece_len).groupBy("a", "b").agg(F.sum("n").alias("c"))


def cut_runs(sym: list, pairs) -> list[tuple]:
    """Maximal stretches of ``sym`` in which every adjacent pair is in ``pairs``."""
    out, first = [], 0
    for i in range(1, len(sym) + 1):
        if i == len(sym) or (sym[i - 1], sym[i]) not in pairs:
            if i - first > 1:
                out.append(tuple(sym[first:i]))
            first = i
    return out


def _runs(state: DataFrame, pairs: set) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        known = shared.value
        names = sorted({s for p in known for s in p})
        number = {s: i for i, s in enumerate(names)}
        keys = np.array(sorted(number[a] * len(names) + number[b] for a, b in known), np.int64)
        for b in batches:
            found, n = cut_all(b.column(1), b.column(0).to_numpy(zero_copy_only=False), pa.array(names, pa.string()), keys)
            yield pa.record_batch({"run": found, "n": pa.array(n, pa.int64())})

    return state.select("n", "sym").mapInArrow(run, "run array<string>, n long").groupBy("run").agg(F.sum("n").alias("n"))


def merge_all(sym: list, rank_of) -> list:
    """Merge adjacent symbols, lowest rank first, equal ranks from the left. ``rank_of(a, b, now)`` gives the rank of a pair, or None; ``now``
    is the rank of the merge that made the pair (-1 at first)."""
    n = len(sym)
    if n < 2:
        return sym
    sym = list(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i, now):
        j = after[i]
        if j < n:
            r = rank_of(sym[i], sym[j], now)
            if r is not None:
                heap.append((r, i, sym[i], sym[j])) if now < 0 else heapq.heappush(heap, (r, i, sym[i], sym[j]))

    for i in range(n - 1):
        push(i, -1)
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], sym[j] = a + b, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i], r)
        push(i, r)
    return [s for s in sym if s is not None]


def apply_in_order(sym: list, ranks: dict) -> list:
    """Every merge of the list behind ``ranks`` (pair -> its places in it) once, in order, over all of ``sym``."""
    def rank_of(a, b, now):
        return next((r for r in ranks.get((a, b), ()) if r > now), None)
    return merge_all(sym, rank_of)


class _Steps:
    """Plain BPE on runs with counts, kept up to date by the runs that a merge touches."""

    def __init__(self, runs, max_piece_len: int):
        self.runs, self.times, self.max_len = [list(r) for r, _ in runs], [n for _, n in runs], max_piece_len
        self.count, self.where, self.heap = {}, {}, []
        for i in range(len(self.runs)):
            self._add(i, 1)
        self.heap = [(*order_key(a, b, c), a, b) for (a, b), c in self.count.items()]
        heapq.heapify(self.heap)

    def _add(self, i: int, sign: int):
        r, n, changed = self.runs[i], sign * self.times[i], set()
        for p in zip(r, r[1:]):
            if len(p[0]) + len(p[1]) <= self.max_len:
                self.count[p] = self.count.get(p, 0) + n
                changed.add(p)
                if sign > 0:
                    self.where.setdefault(p, set()).add(i)
        return changed

    def best(self):
        """(a, b, count) of the pair that comes first, or None."""
        while self.heap:
            c, *_, a, b = self.heap[0]
            now = self.count.get((a, b), 0)
            if now == -c and now > 0:
                return a, b, now
            heapq.heappop(self.heap)
            if 0 < now < -c:
                heapq.heappush(self.heap, (*order_key(a, b, now), a, b))
        return None

    def merge(self, a: str, b: str):
        changed = set()
        for i in self.where.pop((a, b), ()):
            changed |= self._add(i, -1)
            out, r, k = [], self.runs[i], 0
            while k < len(r):
                if k + 1 < len(r) and r[k] == a and r[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(r[k])
                    k += 1
            self.runs[i] = out
            changed |= self._add(i, 1)
        for p in changed:
            c = self.count[p]
            if c > 0:
                heapq.heappush(self.heap, (*order_key(*p, c), *p))
            else:
                del self.count[p]
                self.where.pop(p, None)


def take_steps(runs, first_out, symbols: set, limits: dict, wanted: int, max_piece_len: int = MAX_PIECE_LEN) -> list[tuple[str, str]]:
    """The merges of one epoch (step 3). ``first_out`` is the best pair that was left out; ``symbols`` are all that exist, and grow;
    ``limits`` gives, for pieces that may be spelled twice, the number of ways and the largest sum with a neighbour; ``wanted`` is the
    number of new pieces at which to stop."""
    steps, merges, bound, ways, new = _Steps(runs, max_piece_len), [], 0, 0, 0
    last = order_key(*first_out) if first_out else None
    while new < wanted:
        top = steps.best()
        if top is None:
            break
        a, b, c = top
        if merges and ((last is not None and order_key(a, b, c) >= last) or (bound and c <= bound * (1 + ways))):
            break
        merges.append((a, b))
        if a + b in symbols:
            if a + b not in limits:
                break
            ways, bound = max(ways, limits[a + b][0]), max(bound, limits[a + b][1])
        else:
            symbols.add(a + b)
            new += 1
        steps.merge(a, b)
    return merges


def _limits(pairs: DataFrame, chosen, symbols: set) -> dict:
    """Pieces of the ``chosen`` pairs that exist already, or that two of them spell: (ways, largest sum of the counts that their
    parts and they have with one neighbour)."""
    spelled: dict[str, list] = {}
    for a, b, _ in chosen:
        spelled.setdefault(a + b, []).append((a, b))
    twice = {s: w for s, w in spelled.items() if len(w) > 1 or s in symbols}
    if not twice:
        return {}
    spark = pairs.sparkSession
    found: dict[str, int] = {}
    for own, other, part in (("a", "b", 1), ("b", "a", 0)):
        rows = sorted({(s, s) for s in twice} | {(w[part], s) for s, ways in twice.items() for w in ways})
        names = spark.createDataFrame(rows, "part string, piece string")           # at most three for a chosen pair
        sums = pairs.join(F.broadcast(names), pairs[own] == names["part"]).groupBy("piece", other).agg(F.sum("c").alias("c"))
        for r in sums.groupBy("piece").agg(F.max("c").alias("c")).collect():
            found[r["piece"]] = max(found.get(r["piece"], 0), int(r["c"]))
    return {s: (len(w), found.get(s, 0)) for s, w in twice.items()}


def train_bpe(words: DataFrame, vocab_size: int, max_piece_len: int = MAX_PIECE_LEN, start_pairs: int = START_PAIRS,
              max_pairs: int = MAX_PAIRS, run_symbols: int = RUN_SYMBOLS, rows_per_partition: int = 50_000, history: list | None = None) -> DataFrame:
    """K3: vocabulary of at most ``vocab_size`` rows: 4 specials, merged pieces in merge order (score = -rank), then characters.
    ``history`` receives (merges, words left) of every epoch."""
    spark = words.sparkSession
    counts = materialize(counted(words).select(F.concat(F.lit(SPACE), F.col("word")).alias("w"), "n"), "bpe_words")
    n_parts = partitions_for(spark, counts.count(), rows_per_partition)      # by distinct words, not by the shuffle default
    sym = F.filter(F.split("w", ""), lambda c: c != "")
    chars = (counts.select(F.explode(sym).alias("ch"), "n").groupBy("ch").agg(F.sum("n").alias("c"))
             .orderBy(F.desc("c"), "ch").collect())                          # the alphabet
    state = materialize(counts.select("n", sym.alias("sym")).where(F.size("sym") > 1).repartition(n_parts), "bpe")
    release(counts)
    char_list = [r["ch"] for r in chars]
    target = max(0, vocab_size - len(SPECIAL_PIECES) - len(char_list))
    # epochs are a few small jobs each: static plans, no adaptive re-planning
    with conf_override(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(n_parts)}):
        pieces = _epochs(state, set(char_list), target, max_piece_len, start_pairs, max_pairs, run_symbols, history)
    rows = [(i + len(SPECIAL_PIECES), p, float(-i)) for i, p in enumerate(pieces + char_list)]
    return specials(spark).unionByName(spark.createDataFrame(rows, VOCAB_SCHEMA))


def _epochs(state, symbols, target, max_piece_len, k, max_pairs, run_symbols, history) -> list[str]:
    pieces: list[str] = []
    while len(pieces) < target:
        pairs = materialize(pair_counts(state, max_piece_len), "bpe_pairs")
        order = [F.desc("c"), F.length("a") + F.length("b"), F.concat("a", "b"), F.length("a")]
        top = [(r["a"], r["b"], int(r["c"])) for r in pairs.orderBy(*order).limit(k + 1).collect()]
        if not top:
            release(pairs)
            break
        while True:
            chosen, first_out = top[:k], top[k] if len(top) > k else None
            if k == 1:
                runs, few = [(chosen[0][:2], chosen[0][2])], True
                break
            table = materialize(_runs(state, {p[:2] for p in chosen}), "bpe_runs")
            size = table.agg(F.sum(F.size("run"))).first()[0] or 0
            if size <= run_symbols:
                runs, few = [(r["run"], int(r["n"])) for r in table.collect()], size * 8 <= run_symbols
                release(table)
                break
            release(table)
            k //= 2
        limits = _limits(pairs, chosen, symbols) if k > 1 else {}
        release(pairs)
        if k == 1:                  # one pair: take it, and count again
            merges = [chosen[0][:2]]
            new = chosen[0][0] + chosen[0][1] not in symbols
            symbols.add(chosen[0][0] + chosen[0][1])
            pieces += [chosen[0][0] + chosen[0][1]] if new else []
        else:
            known = set(symbols)
            merges = take_steps(runs, first_out, symbols, limits, target - len(pieces), max_piece_len)
            for a, b in merges:
                if a + b not in known:
                    known.add(a + b)
                    pieces.append(a + b)
        before, state = state, materialize(_applied(state, merges), "bpe")
        release(before)
        if history is not None:
            history.append((len(merges), state.count()))
        if few:
            k = min(4 * k, max_pairs)
    release(state)
    return pieces


def _applied(state: DataFrame, merges) -> DataFrame:
    ranks: dict[tuple, list[int]] = {}
    for i, p in enumerate(merges):
        ranks.setdefault(p, []).append(i)
    shared = state.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        known = shared.value
        merges = Merges(sorted({s for a, b in known for s in (a, b, a + b)}), [(*p, r) for p, r in known.items()], True)
        names = pa.array(merges.names, pa.string())
        for b in batches:
            sym, size, strings = numbered(b.column(1), names)
            yield pa.record_batch({"n": b.column(0), "sym": lists_of_strings(strings, *merges.merged(sym, size))})

    return state.select("n", "sym").mapInArrow(run, "n long, sym array<string>").where(F.size("sym") > 1)


def bpe_segment(word: str, ranks: dict[str, int]) -> list[str]:
    """The standard BPE encoding: adjacent symbols whose piece has the lowest rank, from the left."""
    return merge_all(list(word), lambda a, b, _: ranks.get(a + b))


def segmenter(ids: dict):
    """Words -> ids of the pieces of ``bpe_segment``, thousands of words at once."""
    ranks = {p: i for p, i in ids.items() if len(p) > 1 and i >= len(SPECIAL_PIECES)}
    chars = sorted({c for p in ids for c in p})
    names = [*chars, *ranks]
    known = set(names)
    merges = Merges(names, [(p[:k], p[k:], [i]) for p, i in ranks.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known], False)
    points = np.array([ord(c) for c in chars] or [-1], np.int64)
    numbers = np.array([*(ids.get(p, UNK) for p in names), UNK], np.int32)            # the last stands for other characters

    def segment(words):
        out = []
        for i in range(0, len(words), WORDS_AT_ONCE):
            codes, size, _ = flat_points([SPACE + w for w in words[i:i + WORDS_AT_ONCE]])
            place = np.minimum(np.searchsorted(points, codes), len(points) - 1)
            found, n = merges.merged(np.where(points[place] == codes, place, len(names)), size)
            flat, end = numbers[found].tolist(), np.cumsum(n).tolist()
            out += [tuple(flat[a:z]) for a, z in zip([0, *end], end)]
        return out
    return segment


def encode_bpe(df: DataFrame, col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """K7: whitespace words -> BPE pieces by merge rank -> ids; map-only, a task segments every distinct word once."""
    return df.withColumn(out, encode_words(piece_ids(vocab), segmenter)(F.coalesce(F.col(col), F.lit(""))))
