"""Segmentation lattices of many words at once (K4's E-step, K8): flat arrays of edges, worked place by place over all words."""

from __future__ import annotations

import numpy as np

POINTS = 0x110000               # code points
SPAN = 1 << 10                  # more than the characters of a piece


def _flat(strings):
    """(code points of all strings, their lengths, where each one begins)."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64), size, np.cumsum(size) - size


class Pieces:
    """The pieces of at most ``max_len`` characters as a trie of sorted arrays, one for a depth, with their log-probabilities. A character
    without a piece is crossed at ``unk_logp``, by an edge without a piece."""

    def __init__(self, logp: dict, max_len: int, unk_logp: float):
        self.names = [p for p in logp if 0 < len(p) <= max_len]
        self.logp = np.array([*(logp[p] for p in self.names), unk_logp], np.float64)         # the last stands for -1
        codes, size, first = _flat(self.names)
        node, self.depths = np.zeros(len(self.names), np.int64), []
        for depth in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > depth)
            keys, at = np.unique(node[live] * POINTS + codes[first[live] + depth], return_inverse=True)
            node[live] = at
            ends = np.full(len(keys), -1, np.int64)
            done = size[live] == depth + 1
            ends[at[done]] = live[done]
            self.depths.append((keys, ends))

    def _edges(self, words):
        """(source, target, piece) of every edge, and for every word its first node and its length; a word has a node before every
        character and one at its end."""
        codes, size, first = _flat(words)
        word = np.repeat(np.arange(len(words)), size)
        left = (first + size)[word] - np.arange(len(codes))
        begin, length, piece = [], [], []
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        bare = np.ones(len(codes), bool)
        for depth, (keys, ends) in enumerate(self.depths):
            some = left[at] > depth
            at, node = at[some], node[some]
            key = node * POINTS + codes[at + depth]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[place] == key
            at, node = at[known], place[known]
            p = ends[node]
            full = p >= 0
            begin.append(at[full])
            length.append(np.full(len(begin[-1]), depth + 1))
            piece.append(p[full])
            if not depth:
                bare[begin[0]] = False
        begin.append(np.flatnonzero(bare))
        length.append(np.ones(len(begin[-1]), np.int64))
        piece.append(np.full(len(begin[-1]), -1))
        begin = np.concatenate(begin)
        source = begin + word[begin]
        return source, source + np.concatenate(length), np.concatenate(piece), word[begin], first + np.arange(len(words)), size

    def expected(self, words, times):
        """Forward-backward: (piece, expected count in all occurrences) once for every piece of a word, and the words' log-likelihoods."""
        source, target, piece, word, first, size = self._edges(words)
        gain = self.logp[piece]
        alpha, beta = (np.zeros(len(words) + int(size.sum())) for _ in range(2))
        for e, group, begin, to in _places(target, source, target - first[word], True):
            alpha[to] = _logsumexp(alpha[source[e]] + gain[e], group, begin)
        for e, group, begin, to in _places(source, target, source - first[word], False):
            beta[to] = _logsumexp(gain[e] + beta[target[e]], group, begin)
        z = alpha[first + size]
        own = np.flatnonzero(piece >= 0)
        # a piece that stands twice in a word is added up from its end
        key = word[own] * len(self.logp) + piece[own]
        order = np.argsort(key * len(alpha) + (len(alpha) - 1 - source[own]))
        own, key = own[order], key[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(own):
            return own, np.empty(0), z
        c = np.add.reduceat(np.exp(alpha[source[own]] + gain[own] + beta[target[own]] - z[word[own]]), begin)
        one = own[begin]
        return piece[one], times[word[one]] * c, z

    def best(self, words):
        """Viterbi: (pieces of the best segmentations, -1 for a character without one, how many each word has)."""
        source, target, piece, word, first, size = self._edges(words)
        gain = self.logp[piece]
        score = np.zeros(len(words) + int(size.sum()))
        back = np.zeros(len(score), np.int64)
        for e, group, begin, to in _places(target, source, target - first[word], True):
            v = score[source[e]] + gain[e]
            top = np.maximum.reduceat(v, begin)
            hit = np.flatnonzero(v == top[group])
            hit = hit[np.flatnonzero(np.diff(group[hit], prepend=-1))]            # of equal ones, the earliest source
            score[to], back[to] = top, e[hit]
        whose, node = np.arange(len(words)), first + size
        taken = [(whose[:0], whose[:0])]
        while True:
            open_ = node > first[whose]
            whose, node = whose[open_], node[open_]
            if not len(whose):
                break
            e = back[node]
            taken.append((whose, piece[e]))
            node = source[e]
        whose, pieces = (np.concatenate(x[::-1]) for x in zip(*taken))
        return pieces[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))


def _places(meet, other, local, upwards: bool):
    """The edges by the place of their end ``meet`` in the word: (edges, group of each, first of every group, node of every group);
    a node's edges follow each other by their ``other`` end."""
    nodes = int(max(meet.max(initial=0), other.max(initial=0))) + 1
    order = np.argsort((local * nodes + meet) * SPAN + (other - meet) % SPAN)           # no two are the same
    local, meet = local[order], meet[order]
    cuts = [0, *(np.flatnonzero(np.diff(local)) + 1).tolist(), len(order)] if len(order) else [0]
    spans = list(zip(cuts, cuts[1:]))
    for a, z in spans if upwards else reversed(spans):
        new = np.diff(meet[a:z], prepend=-1) != 0
        begin = np.flatnonzero(new)
        yield order[a:z], np.cumsum(new) - 1, begin, meet[a:z][begin]


def _logsumexp(v, group, begin):
    top = np.maximum.reduceat(v, begin)
    return top + np.log(np.add.reduceat(np.exp(v - top[group]), begin))
