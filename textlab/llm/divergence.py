"""Source divergence audit: how far the terms of a source stand from those of the other sources of its language.

Terms are counted by length-bucketed packing. A term of up to 8 bytes is one unsigned 64-bit word, one of up to 16
bytes two; the words of some megabytes of text are radix-sorted, 16 bits a pass, and equal neighbours are counted as runs.
Longer terms stand in buckets of doubling width, each sorted by bytes. Spark adds the counts up.

The distances between the sources of a language come from blocks of its terms: a block is a dense matrix of
sources by terms, from which every ordered pair of sources gets one partial sum. Terms that neither source of a
pair has are never listed: they all contribute the same value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.kernels import slices
from textlab.session import materialize, ship_package

FLUSH_BYTES = 1 << 23           # text whose terms are sorted together
BLOCK_TERMS = 4096              # terms of a block of the matrix
TILE_SOURCES = 128              # sources of a tile: a cell holds two tiles at most

_TERM = np.zeros(256, bool)     # a byte of a term: ASCII letters and all bytes of other code points
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_spans(data: np.ndarray, bounds: np.ndarray):
    """(start, end, document) of the terms of consecutive texts."""
    n = data.size
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    inside = _TERM[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    filled = bounds[1:] > bounds[:-1]
    first, last = bounds[:-1][filled], bounds[1:][filled] - 1
    head[first], tail[last] = inside[first], inside[last]
    start = np.flatnonzero(head)
    return start, np.flatnonzero(tail) + 1, np.searchsorted(bounds, start, side="right") - 1


def radix_order(words, digits) -> np.ndarray:
    """Stable order by ``words`` (unsigned 64-bit arrays, the most significant first), then by ``digits`` (non-negative
    integers): 16 bits a pass, passes in which all rows agree left out."""
    order = None
    for key in (digits, *reversed(words)):
        key = key.astype(np.uint64)
        for shift in range(0, 64, 16):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if digit.size and digit.min() != digit.max():
                step = np.argsort(digit if order is None else digit[order], kind="stable")
                order = step if order is None else order[step]
    return np.arange(digits.size) if order is None else order


def _runs(keys, doc):
    """Sorted keys -> first row of every run, rows of the run, different documents of the run."""
    n = doc.size
    change = np.ones(n, bool)
    change[1:] = False
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(change)
    other = change.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return at, np.diff(np.append(at, n)), np.add.reduceat(other, at, dtype=np.int64)


def _strings(rows: np.ndarray, length: np.ndarray) -> pa.Array:
    """Rows of zero-padded bytes as strings."""
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    flat = rows[np.arange(rows.shape[1]) < length[:, None]]
    return pa.StringArray.from_buffers(length.size, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))


class _Counter:
    """Terms of some megabytes of text, then their counts by (group, term)."""

    def __init__(self):
        self.groups: dict = {}
        self.docs: list[np.ndarray] = []        # group of every document
        self.held = 0
        self.short = {1: [], 2: []}
        self.long: dict = {}

    def add(self, data, bounds, groups):
        """Texts that follow each other in ``data``, their (lang, source)."""
        base = sum(x.size for x in self.docs)
        number = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        self.docs.append(number)
        self.held += data.size + 64 * len(groups)
        start, end, doc = term_spans(data, bounds)
        length, group, doc = end - start, number[doc], doc + base
        lower = _LOWER[data]
        wide = np.ndarray((data.size + 8,), ">u8", np.concatenate([lower, np.zeros(16, np.uint8)]).tobytes(), strides=(1,))

        def word(at, size):
            cut = (64 - 8 * np.minimum(size, 8)).astype(np.uint64)
            return (wide[at].astype(np.uint64) >> cut) << cut

        for n, pick in ((1, length <= 8), (2, (length > 8) & (length <= 16))):
            at, size = start[pick], length[pick]
            if at.size:
                words = [word(at, size)] + ([word(at + 8, size - 8)] if n == 2 else [])
                self.short[n].append((*words, group[pick], doc[pick]))
        pick = length > 16
        if pick.any():
            width = 1 << np.ceil(np.log2(length[pick])).astype(np.int64)
            for w in np.unique(width):
                some = np.flatnonzero(pick)[width == w]
                rows = np.zeros((some.size, int(w)), np.uint8)
                cover = np.zeros(data.size + 1, np.int8)
                cover[start[some]] += 1
                np.subtract.at(cover, end[some], 1)
                rows[np.arange(int(w)) < length[some][:, None]] = lower[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)]
                self.long.setdefault(int(w), []).append((rows, length[some], group[some], doc[some]))

    def counts(self):
        """Record batches (lang, source, term, n, docs); a group's row with an empty term counts its documents."""
        names = list(self.groups)
        if not names:
            return
        lang, source = pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string())

        def batch(term, group, n, docs):
            return pa.record_batch({"lang": lang.take(pa.array(group)), "source": source.take(pa.array(group)), "term": term,
                                    "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})

        size = np.bincount(np.concatenate(self.docs), minlength=len(names))
        yield batch(pa.array([""] * len(names)), np.arange(len(names)), size, np.zeros(len(names), np.int64))
        for n, parts in self.short.items():
            if parts:
                *words, group, doc = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                o = radix_order(words, group)
                words, group, doc = [w[o] for w in words], group[o], doc[o]
                at, times, docs = _runs([*words, group], doc)
                rows = np.stack([w[at] for w in words], axis=1).astype(">u8").view(np.uint8).reshape(at.size, 8 * n)
                yield batch(_strings(rows, np.count_nonzero(rows, axis=1)), group[at], times, docs)
        for w, parts in self.long.items():
            rows, length, group, doc = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            keys = np.ascontiguousarray(rows).view(f"S{w}").ravel()
            o = np.argsort(group, kind="stable")
            o = o[np.argsort(keys[o], kind="stable")]
            keys, group, doc = keys[o], group[o], doc[o]
            at, times, docs = _runs([keys, group], doc)
            yield batch(_strings(rows[o[at]], length[o[at]]), group[at], times, docs)


def _count(batches):
    """Rows (lang, source, text) -> counts by (lang, source, term) of every few megabytes of text."""
    held = _Counter()
    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, j, data, bounds in slices(b.column(2), 1 << 20):
            held.add(data, bounds, list(zip(langs[i:j], sources[i:j])))
            if held.held >= FLUSH_BYTES:
                yield from held.counts()
                held = _Counter()
    yield from held.counts()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in a group and its documents with the term; a row with an empty
    term stands for every group, ``n`` being its documents."""
    ship_package(docs.sparkSession)
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)])
    return (base.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(n, total, kept) -> F.Column:
    """1 + floor(10**9 * (n + 1) / (total + kept)) in whole numbers; 1 where there is nothing to share."""
    return F.when(kept > 0, F.lit(1) + F.call_function(
        "div", F.lit(10 ** 9).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kept).cast("decimal(20,0)"))).otherwise(F.lit(1).cast("long"))


def _far(p, q) -> F.Column:
    """floor((p - q) ** 2 / q) in whole numbers; p and q are at most 10**9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


_PARTS = "lang string, source string, item string, value long, seen long, p long, q long, kept long"


def _cell(t: pa.Table) -> pa.Table:
    """One block of terms, two tiles of sources: a partial sum for every ordered pair."""
    names = t.column("source").to_pylist()
    at = t.column("sidx").to_numpy()
    share, mark = t.column("p").to_numpy(), np.array([s is not None for s in names])
    order = np.flatnonzero(mark)[np.argsort(at[mark], kind="stable")]
    sources, tile = at[order], at[order] // TILE_SOURCES
    terms = t.column("term").combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    code = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    matrix = np.repeat(share[order][:, None], len(terms.dictionary), axis=1)
    matrix[np.searchsorted(sources, at[~mark]), code[~mark]] = share[~mark]
    lang, kept = t.column("lang")[0].as_py(), t.column("kept")[int(order[0])].as_py()
    every, left, right, value = np.arange(sources.size), [], [], []
    for a in range(sources.size):
        b = every[(every != a) if tile[0] == tile[-1] else (tile != tile[a])]
        q = matrix[b]
        d = matrix[a] - q
        left.append(np.full(b.size, a))
        right.append(b)
        value.append((d * d // q).sum(axis=1))
    left, right = np.concatenate(left), np.concatenate(right)
    name = pa.array([names[i] for i in order], pa.string())
    return pa.table({"lang": pa.array([lang] * left.size, pa.string()), "source": name.take(pa.array(left)), "item": name.take(pa.array(right)),
                     "value": np.concatenate(value).astype(np.int64), "seen": np.full(left.size, matrix.shape[1], np.int64),
                     "p": share[order][left], "q": share[order][right], "kept": np.full(left.size, kept, np.int64)})


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """Distances between the sources of a language, and the terms that a source has more of than its language.

    Terms are the runs of ASCII letters and code points above 127, A-Z lower-cased. A language keeps the terms in at least
    ``min_docs`` of its documents, V in number. A group (language and source), and a language, gives a kept term with n
    occurrences there the share p = 1 + floor(10**9 * (n + 1) / (N + V)), N the occurrences of all kept terms there.

    Returns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Part ``pair``: item is every other source of
    the language, value the sum over all kept terms of floor((p - q)**2 / q), q that source's share; 0 where nothing is
    kept. Part ``term``: the ``top`` kept terms that the group has, with p above the language's q, value that term's
    floor((p - q)**2 / q). Ranks by value descending, then item by its bytes.

    Null text, language and source count as ''. Whole texts count, terms of any length; repeated rows count each
    time as documents of their own; ids and other columns are not read. A group without a kept term has pair rows and no term
    rows. An empty table gives an empty result.
    """
    counts = materialize(term_counts(docs, lang_col, source_col, text_col), "term_counts")
    whole = Window.partitionBy("lang", "term")             # as many rows as a language has sources
    kept = materialize(counts.filter("term <> ''").select(
        "lang", "source", "term", "n", F.sum("n").over(whole).alias("ln"), F.sum("docs").over(whole).alias("ld"),
        (F.min("source").over(whole) == F.col("source")).cast("long").alias("first")).filter(F.col("ld") >= min_docs).drop("ld"), "kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    lang = Window.partitionBy("lang")
    groups = materialize(counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
        F.sum(F.coalesce("total", F.lit(0))).over(lang).alias("lang_total"), F.sum(F.coalesce("firsts", F.lit(0))).over(lang).alias("kept"),
        (F.row_number().over(lang.orderBy("source")) - 1).alias("sidx"), F.count("*").over(lang).alias("sources")), "groups")

    rows = kept.join(groups, ["lang", "source"])
    entries = rows.select(
        "lang", "source", "term", "sidx", "sources", "kept", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("ln"), F.col("lang_total"), F.col("kept")).alias("q"))
    return _pairs(entries, groups).unionByName(_terms(entries, top))


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / F.lit(BLOCK_TERMS))).cast("int")
    tile = F.floor(F.col("sidx") / F.lit(TILE_SOURCES)).cast("int")
    tiles = F.ceil(F.col("sources") / F.lit(TILE_SOURCES)).cast("int")

    def dealt(df):
        """Every row to the cells of its tile with every other tile."""
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        return df.select("lang", "block", F.least(tile, "other").alias("lo"), F.greatest(tile, "other").alias("hi"),
                         "source", "term", "sidx", "p", "kept")

    body = entries.withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int")).withColumn("source", F.lit(None).cast("string"))
    heads = groups.filter("sources > 1").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn(
        "term", F.lit(None).cast("string")).withColumn("p", _share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    cells = dealt(body.filter("sources > 1")).unionByName(dealt(heads))
    sums = cells.groupBy("lang", "block", "lo", "hi").applyInArrow(_cell, _PARTS).groupBy("lang", "source", "item").agg(
        F.sum("value").alias("some"), F.sum("seen").alias("seen"), F.first("p").alias("p"), F.first("q").alias("q"), F.first("kept").alias("kept"))
    value = F.col("some") + (F.col("kept") - F.col("seen")) * _far(F.col("p"), F.col("q"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(w))


def _terms(entries: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return entries.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value")
    ).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
