"""BPE merges of many words at once (K3's epochs, K7): flat arrays of symbol numbers, one merge of every word a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.iinfo(np.int64).max   # rank of a pair that is not merged


class Merges:
    """Pairs of ``names`` with the places of their merges: rows (left, right, ranks). Symbols that are no name, numbered from ``len(names)``
    on, are in no pair. ``in_order``: a pair that a merge makes is only merged at a later rank."""

    def __init__(self, names: list, rows, in_order: bool):
        self.names, self.in_order = names, in_order
        number = {s: i for i, s in enumerate(names)}
        rows = sorted((number[a] * len(names) + number[b], number[a + b], list(r)) for a, b, r in rows)
        ways = max((len(r) for _, _, r in rows), default=1)
        self.keys = np.array([k for k, _, _ in rows] or [-2], np.int64)
        self.made = np.array([m for _, m, _ in rows] or [0], np.int64)
        self.ranks = np.array([r + [NONE] * (ways - len(r)) for _, _, r in rows] or [[NONE]], np.int64)

    def _pairs(self, a, b, now):
        """(rank, symbol that it makes) of every pair; ``now`` is the rank of the merge that made it, or -1."""
        place = _place(self.keys, a, b, len(self.names))
        ranks = self.ranks[place]
        if self.in_order:
            ranks = np.where(ranks > np.reshape(now, (-1, 1)), ranks, NONE)
        return np.where(place < 0, NONE, ranks.min(axis=1)), self.made[place]

    def merged(self, sym, size):
        """(symbols after all merges, lowest rank first, equal ranks from the left; how many each word has)."""
        sym, word = np.array(sym, np.int64), np.repeat(np.arange(len(size)), size)
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at], made[at] = self._pairs(sym[at], sym[at + 1], -1)
        done = [(word[:0], sym[:0])]
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low, length = np.minimum.reduceat(rank, first), np.diff(first, append=len(sym))
            open_ = low < NONE
            if not open_.all():
                live = np.repeat(open_, length)
                done.append((word[~live], sym[~live]))
                sym, word, rank, made = (x[live] for x in (sym, word, rank, made))
                low, length = low[open_], length[open_]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, length))
            at = at[np.flatnonzero(np.diff(word[at], prepend=-1))]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank, made = (x[keep] for x in (sym, word, rank, made))
            at -= np.arange(len(at))
            rank[at] = NONE
            for i in (at - 1, at):
                ok = (i >= 0) & (i < len(sym) - 1)
                ok[ok] = word[i[ok]] == word[i[ok] + 1]
                j = i[ok]
                rank[j], made[j] = self._pairs(sym[j], sym[j + 1], low[ok])
        word, sym = (np.concatenate(x) for x in zip(*done))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(size))


def _place(keys, a, b, n):
    """Place of every pair in the sorted ``keys``, -1 where it is not there."""
    key = np.where((a < n) & (b < n), a * n + b, -1)
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[place] == key, place, -1)


def numbered(lists: pa.Array, names: pa.Array):
    """Lists of strings -> (numbers of the symbols, lengths, strings by number): ``names`` first, then what else there is."""
    flat = lists.flatten().cast(pa.string()).dictionary_encode()
    found = pc.fill_null(pc.index_in(flat.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.where(found < 0, len(names) + np.arange(len(found)), found)
    which = flat.indices.to_numpy(zero_copy_only=False)
    return own[which] if len(which) else np.empty(0, np.int64), lists.value_lengths().to_numpy(zero_copy_only=False), pa.concat_arrays([names, flat.dictionary])


def lists_of_strings(strings: pa.Array, sym, size) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), strings.take(pa.array(sym)))


def runs(lists: pa.Array, times: np.ndarray, names: pa.Array, keys: np.ndarray):
    """(run, n): the maximal stretches of the ``lists`` in which every adjacent pair is one of ``keys``, equal ones summed by ``times``."""
    sym, size, _ = numbered(lists, names)
    word = np.repeat(np.arange(len(size)), size)
    inside = np.zeros(len(sym) + 1, bool)                   # of a symbol and the next; the last stands for the one before the first
    at = np.flatnonzero(word[1:] == word[:-1])
    inside[at] = _place(keys, sym[at], sym[at + 1], len(names)) >= 0
    first = np.flatnonzero(inside[:-1] & ~inside[np.arange(len(sym)) - 1])
    length = np.flatnonzero(inside[:-1] & ~inside[1:]) + 2 - first
    end = np.cumsum(length)
    flat = np.arange(end[-1] if len(end) else 0) - np.repeat(end - length - first, length)
    found, n = lists_of_strings(names, sym[flat], length), times[word[first]]
    if pc.any(pc.match_substring(names, "\n")).as_py():     # then the next step sums them
        return found, n
    coded = pc.binary_join(found, "\n").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    which, one = np.unique(coded, return_index=True)
    total = np.zeros(len(which), np.int64)
    np.add.at(total, coded, n)
    return found.take(pa.array(one)), total
