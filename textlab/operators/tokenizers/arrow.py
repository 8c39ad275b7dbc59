"""Encoding and decoding on whole Arrow batches, shared by all tokenizers (K5-K9).

Texts are split, looked up and put together as flat arrays with offsets; Python code runs for a distinct word of a
task at most. The vocabulary, of at most ``vocab_size`` pieces, is a broadcast variable; the token stream is never shuffled.
A batch is worked on ``TEXTS_AT_ONCE`` texts at a time, so that only its input and its result are held whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
PAD, UNK, BOS, EOS = 0, 1, 2, 3
SPACE = "▁"          # word-boundary marker
# ----------------------------------------------------------------------------
MEMO_WORDS = 250_000            # segmented words that a worker remembers
TEXTS_AT_ONCE = 250             # texts whose words or characters are held as flat arrays
TABLES = 4                      # lookup structures that a worker keeps


def in_parts(f):
    """``f`` of an array, part by part; what the parts took goes back to the system."""
    def whole(texts: pa.Array) -> pa.Array:
        out = [f(texts.slice(i, TEXTS_AT_ONCE)) for i in range(0, max(1, len(texts)), TEXTS_AT_ONCE)]
        joined = out[0] if len(out) == 1 else pa.concat_arrays(out)
        pa.default_memory_pool().release_unused()
        return joined
    return whole


def split_words(texts: pa.Array):
    """(words, first word of every text and the end): the whitespace-separated words of a batch; null counts as empty."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = lists.flatten()
    solid = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(solid)])
    offsets = lists.offsets.to_numpy()
    return flat.filter(pa.array(solid)), before[offsets - offsets[0]]


def lists_of(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode_lookup(shared):
    """Words -> the id of the piece ``SPACE + word``, or unk, by one hash lookup of a batch (``shared``: broadcast piece -> id)."""
    def part(texts: pa.Array) -> pa.Array:
        words, ids = _table(shared, "words", lambda d: (
            pa.array([p[1:] for p in d if p.startswith(SPACE)], pa.string()), np.array([i for p, i in d.items() if p.startswith(SPACE)], np.int32)))
        flat, offsets = split_words(texts)
        at = pc.index_in(flat, value_set=words)
        found = np.append(ids, UNK)[pc.fill_null(at, len(ids)).to_numpy(zero_copy_only=False)]
        return lists_of(found, offsets)

    @F.arrow_udf("array<int>")
    def enc(texts: pa.Array) -> pa.Array:
        return in_parts(part)(texts)
    return enc


def _end(strings: pa.Array) -> int:
    """Bytes of all ``strings``, an array that is no slice."""
    return int(np.frombuffer(strings.buffers()[1], np.int32)[len(strings)]) if len(strings) else 0


def encode_points(shared):
    """``SPACE`` before every word, then one id for every code point, by a table of all code points."""
    def part(texts: pa.Array) -> pa.Array:
        def table(d):
            out = np.full(0x110000, UNK, np.int32)
            for p, i in d.items():
                if len(p) == 1:
                    out[ord(p)] = i
            return out
        ids = _table(shared, "points", table)
        words, offsets = split_words(texts)
        marked = pc.binary_join_element_wise(pa.scalar(SPACE), words, "") if len(words) else words
        size = np.concatenate([[0], np.cumsum(pc.utf8_length(marked).to_numpy(zero_copy_only=False))]) if len(words) else np.zeros(1, np.int64)
        data = marked.buffers()[2] if len(words) else None
        points = np.frombuffer((data.to_pybytes() if data is not None else b"")[:_end(marked)].decode().encode("utf-32-le"), np.uint32)
        return lists_of(ids[points], size[offsets])

    @F.arrow_udf("array<int>")
    def enc(texts: pa.Array) -> pa.Array:
        return in_parts(part)(texts)
    return enc


def encode_words(shared, segmenter):
    """Words -> ids by ``segmenter(piece -> id)``, a function from a list of words to a tuple of ids for each, every distinct word of a
    task once."""
    def part(texts: pa.Array) -> pa.Array:
        segment = _table(shared, "segment", segmenter)
        memo = _table(shared, "memo", lambda _: {})
        flat, offsets = split_words(texts)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        pieces = [memo.get(w) for w in words]
        new = [i for i, ids in enumerate(pieces) if ids is None]
        for i, ids in zip(new, segment([words[i] for i in new])):
            pieces[i] = ids
            if len(memo) < MEMO_WORDS:
                memo[words[i]] = ids
        size = np.array([len(p) for p in pieces], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        which = coded.indices.to_numpy(zero_copy_only=False)
        every = np.fromiter(chain.from_iterable(pieces), np.int32, first[-1])
        length = size[which] if which.size else np.empty(0, np.int64)
        end = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(end[-1]) - np.repeat(end[:-1] - (first[which] if which.size else 0), length)
        return lists_of(every[at], end[offsets])

    @F.arrow_udf("array<int>")
    def enc(texts: pa.Array) -> pa.Array:
        return in_parts(part)(texts)
    return enc


def decode_pieces(shared, unk_surface: str):
    """Ids -> text (``shared``: broadcast piece -> id): pad, bos and eos are dropped, unk and unknown ids show as ``unk_surface``, the boundary marker becomes a
    space, and the leading one goes. The pieces of a batch are one buffer, of which a text is a stretch."""
    def part(lists: pa.Array) -> pa.Array:
        def table(d):
            top = max(d.values(), default=EOS) + 1
            shown = [unk_surface] * (top + 1)               # the last stands for ids outside
            for p, i in d.items():
                shown[i] = p
            for i in (PAD, BOS, EOS):
                shown[i] = ""
            shown[UNK] = unk_surface
            return pa.array(shown, pa.large_string())
        shown = _table(shared, "shown", table)
        offsets = lists.offsets.to_numpy()
        ids = pc.fill_null(lists.values, UNK).to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        ids = np.where((ids < 0) | (ids >= len(shown) - 1), len(shown) - 1, ids)
        flat = shown.take(pa.array(ids))
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.combine_chunks()
        _, starts, data = flat.buffers()
        starts = np.frombuffer(starts, np.int64)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        ends = starts[offsets - offsets[0]]
        text = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.tobytes()), data if data is not None else pa.py_buffer(b""))
        text = pc.replace_substring(text, SPACE, " ")
        text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
        return pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.large_string())).cast(pa.string())

    @F.arrow_udf("string")
    def dec(lists: pa.Array) -> pa.Array:
        return in_parts(part)(lists)
    return dec


_tables: dict = {}


def _table(shared, name: str, build):
    """A worker's lookup structure for a broadcast vocabulary, built once."""
    key = (id(shared.value), name)
    if key not in _tables:
        for k in [k for k in _tables if k[0] != key[0]]:
            if len(_tables) >= TABLES:
                del _tables[k]
        _tables[key] = (shared.value, build(shared.value))       # the reference keeps the id from being used again
    return _tables[key][1]
