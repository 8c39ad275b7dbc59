"""N-gram Jaccard self-join as a blocked sparse matrix product.

Documents with the same shingle set form one class; everything after that is about classes.
The document-by-shingle matrix is cut to the columns that the size bounds leave: of a set of n
shingles, ordered rarest first, two sets can only reach the similarity if they share one of the
first n - ceil(t n) + 1. The order comes from a counting sketch of fixed size; any order gives
the same links, a good one gives short columns.

Columns are dealt to blocks by hash. The product is formed in two rounds, so that a group of
near copies does not emit all its pairs:

* round 1 deals the members of a column to stars, whose centres are the smallest sets that no earlier
  star took, and verifies the pairs of centre and member;
* as one centre may not reach a whole group, every member of a column is then paired with the few of other
  components whose bitmaps are nearest;
* round 2 accumulates the overlap counts of the pairs that share a column and that round 1 has
  left in different components, and drops the pairs whose count, plus all that lies behind
  both prefixes, cannot reach the overlap that their sizes ask for. The others are verified.

In both rounds a pair is dropped on the spot if the parity bitmaps of its sets differ in more bits than the
sets may differ in elements: an element that one of them lacks flips one bit, so no link is lost.

A pair is verified on the two whole sets, in integers. Pairs that round 1 has already connected
need no test, as the result is the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.components import components
from textlab.llm.kernels import U64, Sketch, mix64, shingle_sets, signed, sketch_levels, slices, tidy, tidy_group
from textlab.session import conf_override, materialize, release, ship_package

SKETCH_BITS = 23             # counters of shingles, for the order
WANTED_BITS = 21             # counters of class keys that are candidates
BLOCK_ENTRIES = 1 << 16
BITMAP = 512                 # parity bits of a set
TILE = 256
BRIDGES = 4                  # pairs of a member of a column between the rounds
HELD_PAIRS = 1 << 19         # pairs that a task holds before it adds them up, and sends the sums if there are many
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20      # of an Arrow batch, as a text or a set may be long


def overlap_needed(na, nb, num: int, den: int):
    """Smallest intersection of sets of na and nb elements with den * |A n B| >= num * |A u B|."""
    return -((-num * (na + nb)) // (num + den))


def prefix_length(n, num: int, den: int):
    return n - (-((-num * n) // den)) + 1


def _class_key(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _sets(batches, width: int, text_at: int = 0):
    """(batch, row, sorted shingle hashes, 16-byte signature or None) of every document."""
    for b in batches:
        for i, j, data, bounds in slices(b.column(text_at)):
            for k, s in enumerate(shingle_sets(data, bounds, width)):
                yield b, i + k, s, hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None


def _parity(s: np.ndarray) -> bytes:
    """One bit for each of BITMAP buckets of elements: whether it holds an odd number."""
    return np.packbits(np.bincount((s & U64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).tobytes()


def _profile(width: int, bits: int):
    """Documents -> (doc_id, set size, signature, parity bitmap), and the task's sketch."""
    def run(batches):
        sketch = Sketch(bits)

        def rows(b):
            n, sig, par = [], [], []
            for _, _, s, g in _sets([b], width, 1):
                if s.size:
                    sketch.add(s)
                n.append(s.size)
                sig.append(g)
                par.append(_parity(s) if s.size else None)
            return {"doc_id": b.column(0), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "parity": pa.array(par, pa.binary()),
                    "seg": pa.nulls(len(n), pa.int32()), "counts": pa.nulls(len(n), pa.binary())}

        kind = None
        for b in batches:
            kind = b.column(0).type
            yield pa.record_batch(rows(b))
        if kind is not None:
            for seg, part in sketch.parts():
                yield pa.record_batch({"doc_id": pa.nulls(1, kind), "n": pa.nulls(1, pa.int64()), "sig": pa.nulls(1, pa.binary()),
                                       "parity": pa.nulls(1, pa.binary()), "seg": pa.array([seg], pa.int32()), "counts": pa.array([part], pa.binary())})
    return run


def _entries(width: int, level, bits: int, num: int, den: int):
    """Documents -> matrix entries of their prefixes: shingle, class key, size and position."""
    def run(batches):
        seen, lev = set(), level.value
        for b in batches:
            h, cls, at = [], [], []
            for _, _, s, g in _sets([b], width):
                if g is None or g in seen:
                    continue
                seen.add(g)
                p = prefix_length(s.size, num, den)
                order = np.argsort(lev[(s >> U64(64 - bits)).astype(np.int64)], kind="stable")[:p]
                h.append(s[order])
                cls.append(np.full(p, _class_key(g), np.int64))
                at.append((s.size << 32) | np.arange(p, dtype=np.int64))
            if h:
                yield pa.record_batch({"h": signed(np.concatenate(h)), "cls": np.concatenate(cls), "at": np.concatenate(at)})
    return run


def _columns(table: pa.Table):
    """A block's entries in order of column, size and class, without repeated ones: columns of
    the table by name, and the start and length of every matrix column."""
    t = {c: table.column(c).to_numpy() for c in ("h", "cls", "at")}
    t["n"], t["pos"] = t["at"] >> 32, t["at"] & 0xFFFFFFFF
    o = np.lexsort((t["cls"], t["n"], t["h"]))
    keep = np.ones(o.size, bool)
    keep[1:] = np.any([t[c][o][1:] != t[c][o][:-1] for c in ("h", "cls", "n")], axis=0)
    o = o[keep]
    t = {c: v[o] for c, v in t.items()}
    for c in ("comp",):
        if c in table.column_names:
            t[c] = table.column(c).to_numpy()[o]
    if "parity" in table.column_names:
        p = table.column("parity").combine_chunks()
        t["known"] = p.is_valid().to_numpy(zero_copy_only=False)[o]
        p = p.fill_null(bytes(BITMAP // 8)).cast(pa.binary(BITMAP // 8))
        t["parity"] = np.frombuffer(p.buffers()[1], np.uint64).reshape(-1, BITMAP // 64)[p.offset:p.offset + len(p)][o]
    h = t["h"]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.empty(0, np.int64)
    return t, start, np.diff(np.append(start, h.size))


def _shared(table: pa.Table) -> pa.Table:
    """The entries of a block's columns that have two or more."""
    t, _, length = _columns(table)
    long = np.repeat(length, length) >= 2
    return pa.table({c: t[c][long] for c in ("h", "cls", "at")})


def _may_link(t, i, j, num: int, den: int) -> np.ndarray:
    """Whether sizes and parity bitmaps leave the entries' sets i and j room for a link."""
    need = overlap_needed(t["n"][i], t["n"][j], num, den)
    differ = np.bitwise_count(t["parity"][i] ^ t["parity"][j]).sum(axis=1, dtype=np.int64)
    return ((need <= np.minimum(t["n"][i], t["n"][j])) & (t["cls"][i] != t["cls"][j])
            & ((differ <= t["n"][i] + t["n"][j] - 2 * need) | ~t["known"][i] | ~t["known"][j]))


def _room(t, i, j, num: int, den: int) -> np.ndarray:
    """Whether the positions in the shared column leave room for the overlap that is needed."""
    return np.minimum(t["n"][i] - t["pos"][i], t["n"][j] - t["pos"][j]) >= overlap_needed(t["n"][i], t["n"][j], num, den)


def _star(num: int, den: int):
    """Round 1: pairs (centre, member) of class keys. A column's smallest set is its first centre and takes
    the members that may link with it; the smallest of those left is the next one, and so on.
    A member is taken once, so a column of m sets gives fewer than m pairs however many groups it holds."""
    def run(table: pa.Table) -> pa.Table:
        t, start, length = _columns(table)
        i, j = np.repeat(start, length), np.arange(t["h"].size)
        ok = (i != j) & _room(t, i, j, num, den)
        ok[ok] = _may_link(t, i[ok], j[ok], num, den)
        pairs = [(i[ok], j[ok])]
        left = ~ok
        left[start] = False
        many = np.add.reduceat(left, start, dtype=np.int64) >= 2 if start.size else left
        for s, m in zip(start[many].tolist(), length[many].tolist()):
            rest = s + np.flatnonzero(left[s:s + m])
            while rest.size >= 2:
                c, rest = rest[0], rest[1:]
                near = rest[:np.searchsorted(t["n"][rest], t["n"][c] * den // num, side="right")]
                taken = _room(t, c, near, num, den)
                taken[taken] = _may_link(t, c, near[taken], num, den)
                if taken.any():
                    pairs.append((np.full(int(taken.sum()), c), near[taken]))
                    rest = rest[np.append(~taken, np.ones(rest.size - near.size, bool))]
        return _pairs(t, pairs)
    return run


def _pairs(t, pairs) -> pa.Table:
    """Distinct pairs of class keys, the smaller first, of the entries (i, j)."""
    i, j = (np.concatenate(x) for x in zip(*pairs))
    a, b = t["cls"][i], t["cls"][j]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}).group_by(["a", "b"]).aggregate([])


def _bridges(num: int, den: int):
    """Between the rounds: of every member of a column, the pairs with the BRIDGES members of other components
    that may link with it and whose bitmaps are nearest."""
    def run(table: pa.Table) -> pa.Table:
        t, start, length = _columns(table)
        comp, n = t["comp"], t["n"]
        pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        mixed = length >= 2
        if start.size:
            mixed &= np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
        two = start[mixed & (length == 2)]
        two = two[_room(t, two, two + 1, num, den)]
        two = two[_may_link(t, two, two + 1, num, den)]
        pairs.append((two, two + 1))
        for s, m in zip(start[mixed & (length > 2)].tolist(), length[mixed & (length > 2)].tolist()):
            size = n[s:s + m]
            first = s + np.searchsorted(size, -(-size * num // den), side="left")
            last = s + np.searchsorted(size, size * den // num, side="right")
            for c in range(s, s + m):
                near = first[c - s] + np.flatnonzero(comp[first[c - s]:last[c - s]] != comp[c])
                near = near[_room(t, c, near, num, den)]
                near = near[_may_link(t, c, near, num, den)]
                if near.size > BRIDGES:
                    differ = np.bitwise_count(t["parity"][near] ^ t["parity"][c]).sum(axis=1, dtype=np.int64)
                    near = near[np.argpartition(differ, BRIDGES)[:BRIDGES]]
                if near.size:
                    pairs.append((np.full(near.size, c), near))
        return _pairs(t, pairs)
    return run


def _product(num: int, den: int):
    """Round 2: overlap counts of the pairs of a block's columns whose members lie in
    different components; ``near`` tells that some shared column leaves room for a link. A pair's
    count may come in several parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, start, length = _columns(pa.Table.from_batches(list(batches)))
        cls, n, comp = t["cls"], t["n"], t["comp"]
        parts, held = [], 0
        for s, m in zip(start.tolist(), length.tolist()):
            if m < 2 or (comp[s:s + m] == comp[s]).all():
                continue
            for i0 in range(s, s + m, TILE):
                i1 = min(i0 + TILE, s + m)
                for j0 in range(i0, s + m, TILE):       # sizes ascend: stop where the next tile is too large
                    if n[j0] * num > n[i1 - 1] * den:
                        break
                    j1 = min(j0 + TILE, s + m)
                    i, j = np.nonzero((comp[i0:i1, None] != comp[None, j0:j1]) & (n[i0:i1, None] * den >= num * n[None, j0:j1])
                                      & (np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]))
                    i, j = i + i0, j + j0
                    ok = _may_link(t, i, j, num, den)
                    i, j = i[ok], j[ok]
                    if i.size:
                        near = _room(t, i, j, num, den)
                        flip = cls[i] > cls[j]
                        a, b = np.where(flip, j, i), np.where(flip, i, j)
                        parts.append(pa.table({"a": cls[a], "b": cls[b], "na": n[a], "nb": n[b],
                                               "c": np.ones(i.size, np.int64), "near": near.astype(np.int64)}))
                    held += i.size
                    if held > HELD_PAIRS:
                        sums = _accumulate(parts)
                        if sums.num_rows > HELD_PAIRS // 2:
                            yield from sums.to_batches()
                            sums = sums.slice(0, 0)
                        parts, held = [sums], sums.num_rows
        if parts:
            yield from _accumulate(parts).to_batches()
    return tidy(run)


def _accumulate(parts) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["a", "b", "na", "nb"]).aggregate([("c", "sum"), ("near", "max")])
    return t.rename_columns([x.removesuffix("_sum").removesuffix("_max") for x in t.column_names]).select(["a", "b", "na", "nb", "c", "near"])


def _wanted_sets(width: int, wanted, bits: int):
    """Documents -> whole sets of those classes that the sketch of wanted ones does not rule out."""
    def run(batches):
        seen, has = set(), wanted.value
        for b in batches:
            out = []
            for _, _, s, g in _sets([b], width):
                if g is None or g in seen:
                    continue
                key = np.array([_class_key(g)], np.int64).view(np.uint64)
                if has[int((mix64(key) >> U64(64 - bits))[0])]:
                    seen.add(g)
                    out.append((_class_key(g), g, s.tobytes()))
            if out:
                yield pa.record_batch({"cls": pa.array([x[0] for x in out], pa.int64()), "sig": pa.array([x[1] for x in out], pa.binary()),
                                       "hashes": pa.array([x[2] for x in out], pa.binary())})
    return run


def _key_sketch(bits: int):
    def run(batches):
        sketch = Sketch(bits)
        for b in batches:
            sketch.add(mix64(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        for seg, part in sketch.parts():
            yield pa.record_batch({"seg": pa.array([seg], pa.int32()), "counts": pa.array([part], pa.binary())})
    return run


def _linked(num: int, den: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("xa"), b.column("xb")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                ok.append(both >= overlap_needed(x.size, y.size, num, den))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch({"sa": b.column("sa").filter(ok), "sb": b.column("sb").filter(ok)})
    return run


def _verified(texts: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (signatures sa, sb) among candidate pairs of class keys. The texts are read once more;
    a sketch of the wanted keys, of fixed size, keeps nearly all others from being shuffled."""
    spark = texts.sparkSession
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    has = spark.sparkContext.broadcast(sketch_levels(wanted.mapInArrow(tidy(_key_sketch(WANTED_BITS)), "seg int, counts binary"), WANTED_BITS) > 0)
    sets = texts.mapInArrow(tidy(_wanted_sets(width, has, WANTED_BITS)), "cls long, sig binary, hashes binary")
    sets = sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls", "sig"])        # dealt by cls once, for both sides
    a = sets.select(F.col("cls").alias("a"), F.col("sig").alias("sa"), F.col("hashes").alias("xa"))
    b = sets.select(F.col("cls").alias("b"), F.col("sig").alias("sb"), F.col("hashes").alias("xb"))
    return materialize(pairs.select("a", "b").join(a, "a").join(b, "b").select("sa", "sb", "xa", "xb")
                       .mapInArrow(tidy(_linked(num, den)), "sa binary, sb binary"), "links")


def jaccard_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5),
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents whose ``width``-word shingle sets have a Jaccard similarity of at
    least ``threshold`` (a fraction num, den; words: lower-cased runs without ASCII whitespace).

    Returns one row per input row: ``doc_id``, ``n_shingles`` (set size) and ``component_id``, the
    smallest doc_id reachable over links, its own included. A text of fewer words has its whole word
    sequence as its only shingle. A null text or one without words has an empty set, is linked
    with nothing and is its own component. Repeated rows and equal texts are one class. Null ids stay
    null unless another id is in the component. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    with conf_override(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
                                           "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        return _components(docs, width, *threshold, id_col, text_col)


def _components(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    first = materialize(base.mapInArrow(tidy(_profile(width, SKETCH_BITS)),
                                        f"doc_id {id_type}, n long, sig binary, parity binary, seg int, counts binary"), "shingles")
    level = spark.sparkContext.broadcast(sketch_levels(first.filter("seg is not null").select("seg", "counts"), SKETCH_BITS))
    rows = materialize(first.filter("seg is null").select("doc_id", "n", "sig", "parity"), "sets")
    release(first)               # the tasks' sketches, some megabytes each

    texts = base.select("text")
    entries = texts.mapInArrow(tidy(_entries(width, level, SKETCH_BITS, num, den)), "h long, cls long, at long")
    words_total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, int(words_total * (1 - num / den) * 1.2) // BLOCK_ENTRIES + 1)

    def blocked(df, blocks):
        return df.groupBy(F.pmod(F.col("h"), F.lit(blocks)).alias("block"))

    # a key (8 bytes of the signature) that several classes share has no bitmap, so that none of its pairs is dropped
    keys = (rows.filter("sig is not null").groupBy(_le_long(F.substring("sig", 1, 8)).alias("cls"))
            .agg(F.min("sig").alias("x"), F.max("sig").alias("y"), F.min("parity").alias("parity"))
            .select("cls", F.when(F.col("x") == F.col("y"), F.col("parity")).alias("parity")))
    lists = materialize(blocked(entries, blocks).applyInArrow(tidy_group(_shared), "h long, cls long, at long").join(keys, "cls")
                        .select("h", "cls", "at", "parity"), "columns")
    tested = materialize(blocked(lists, blocks).applyInArrow(tidy_group(_star(num, den)), "a long, b long").distinct(), "pairs")
    links = _verified(texts, tested, width, num, den)
    comps = materialize(components(links, "sa", "sb"), "components")
    # the columns that are left fill fewer blocks, in which the counts of a pair add up before they are sent
    blocks = lists.count() // BLOCK_ENTRIES + 1
    again = materialize(blocked(_named(lists, comps), blocks).applyInArrow(tidy_group(_bridges(num, den)), "a long, b long").distinct()
                        .join(tested, ["a", "b"], "left_anti"), "pairs")
    if again.head(1):
        comps = _joined(comps, _verified(texts, again, width, num, den))
        tested = tested.unionByName(again)
    pairs = (blocked(_named(lists, comps), blocks).applyInArrow(_product(num, den), "a long, b long, na long, nb long, c long, near long")
             .groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"), F.max("near").alias("near")))

    def behind(n):
        return F.col(n) - (F.col(n) - F.ceil(F.col(n) * num / F.lit(den)) + 1)

    need = F.ceil((F.col("na") + F.col("nb")) * num / F.lit(num + den))
    pairs = pairs.filter((F.col("near") == 1) & (F.col("c") + F.greatest(behind("na"), behind("nb")) >= need))
    pairs = materialize(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    if pairs.head(1):
        comps = _joined(comps, _verified(texts, pairs, width, num, den))

    release(lists, pairs)
    classes = rows.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = classes.join(comps, classes["sig"] == comps["node"], "left").select(
        "sig", "least", F.coalesce("root", "sig").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(roots, "root").select("sig", "component")
    return rows.join(labels, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _named(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Matrix entries with the component of their class; a key that several classes share is alone."""
    names = comps.select(_le_long(F.substring("node", 1, 8)).alias("cls"), F.xxhash64("root").alias("named")).groupBy("cls").agg(
        F.min("named").alias("named"))
    return lists.join(names, "cls", "left").select("h", "cls", "at", "parity", F.when(
        F.col("named").isNull() | F.col("parity").isNull(), F.xxhash64(F.lit("alone"), "cls")).otherwise(F.col("named")).alias("comp"))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, root) after more ``links`` (sa, sb): the components of the links between roots."""
    a = comps.select(F.col("node").alias("sa"), F.col("root").alias("ra"))
    b = comps.select(F.col("node").alias("sb"), F.col("root").alias("rb"))
    between = links.join(a, "sa", "left").join(b, "sb", "left").select(
        F.coalesce("ra", "sa").alias("ra"), F.coalesce("rb", "sb").alias("rb")).distinct()
    higher = components(between, "ra", "rb").select(F.col("node").alias("low"), F.col("root").alias("high"))
    old = comps.join(higher, comps["root"] == higher["low"], "left").select("node", F.coalesce("high", "root").alias("root"))
    return materialize(old.unionByName(higher.select(F.col("low").alias("node"), F.col("high").alias("root"))).distinct(), "components")


def _le_long(col) -> F.Column:
    """The long whose little-endian bytes are the 8 bytes of a binary column."""
    h = F.hex(col)
    big = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    high, low = F.conv(F.substring(big, 1, 8), 16, 10).cast("long"), F.conv(F.substring(big, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)
