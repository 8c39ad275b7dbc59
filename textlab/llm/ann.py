"""Approximate nearest neighbours by inner product: balanced posting lists.

A bounded sample is split into balanced clusters, whose centroids number the posting lists. A
vector goes to the list of its nearest centroid and, if it lies near a boundary, to a few more. The centroids
are joined to a proximity graph that every task holds; a best-first walk over it finds the lists of a vector or a query.
A query visits the lists whose centroid is at most a ratio farther than the nearest one; the ratio comes from the
sample's own neighbours. Lists are grouped into blocks, and a block is cut into cells of bounded size, in which
queries and candidates of the same list are multiplied.

Inner products become distances by one more component, which lifts all vectors to the largest norm.
Equal vectors are one class with its first members, so that a common vector is one candidate and one query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.session import materialize, ship_package

SAMPLE_CELLS = 1 << 22          # components of the sample that the lists are fitted on
SAMPLE_QUERIES = 512            # vectors of the sample whose neighbours give the ratio
SAMPLE_PER_LIST = 8
MAX_MODELS = 64                 # vector lengths with lists of their own; rarer ones have one list each, searched whole
BRANCHES = 16
DEGREE = 32                     # edges of a centroid
WALK = 48                       # beam of the walk that places a vector
BATCH = 256                     # vectors that walk together
BLOCK_ROWS = 1 << 15            # candidates of a block, as planned from the sample
ROUNDING = 1e-3                 # error of a distance near 0, in parts of the largest norm: distances are single precision
CELL_COMPONENTS = 1 << 22       # components of a cell's candidates, and of its queries
CELL_QUERIES = 1 << 14          # queries of a cell
ASKED_AT_ONCE = 1 << 10         # queries of a cell whose hits are held together
HITS = 1 << 18                  # hits that are held before all but the best go

_MEMBERS = pa.list_(pa.struct([("vec_id", pa.int64()), ("rid", pa.int64())]))


# ---- vectors -------------------------------------------------------------------------

def _valid(kind: str, wide: bool):
    """Rows (id, vector) -> the rows that take part: id, length, key of the vector and, if ``wide``, norm and vector."""
    def run(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            offsets = lists.offsets.to_numpy()
            values = lists.values
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            live = np.concatenate([[0], np.cumsum(np.nan_to_num(x) != 0)])
            a, z = offsets[:-1], offsets[1:]
            take = lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            take = np.flatnonzero(take & (bad[z] == bad[a]) & (live[z] > live[a]))
            x = x.astype(kind)
            raw = [x[a[i]:z[i]].tobytes() for i in take]
            out = {"vec_id": ids.take(pa.array(take)).cast(pa.int64()), "dim": (z - a)[take].astype(np.int32),
                   "key": pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())}
            if wide:
                with np.errstate(over="ignore"):
                    out["norm"] = np.array([np.sqrt(np.square(np.frombuffer(r, kind).astype(np.float64)).sum()) for r in raw])
                out["vec"] = pa.array(raw, pa.binary())
            yield pa.record_batch(out)
    return run


def _classes(vectors: DataFrame, kind: str, every: int, k: int):
    """(rows, classes): every row that takes part, narrow; every different vector with its first k + 1 rows and its queries."""
    rows = materialize(vectors.mapInArrow(_valid(kind, False), "vec_id long, dim int, key binary")
                       .withColumn("rid", F.monotonically_increasing_id()), "vector_rows")
    first = Window.partitionBy("key").orderBy("vec_id", "rid")
    members = (rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)
               .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("vec_id", "rid"))).alias("members")))
    classes = (vectors.mapInArrow(_valid(kind, True), "vec_id long, dim int, key binary, norm double, vec binary")
               .groupBy("key").agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.first("vec").alias("vec"),
                                   F.max((F.col("vec_id") % every == 0)).alias("asks")))
    return rows, materialize(classes.join(members, "key"), "vector_classes")


# ---- lists, fitted on the sample -----------------------------------------------------

def _lift(x: np.ndarray, norms: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, all of norm ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, top * top - norms * norms))[:, None]]).astype(np.float32)


def _aim(x: np.ndarray, norms: np.ndarray, top: float) -> np.ndarray:
    """Queries, scaled to norm ``top``: their nearest lifted vectors have the largest inner products."""
    return np.hstack([x * (top / norms)[:, None], np.zeros((x.shape[0], 1))]).astype(np.float32)


def _split(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Number of the part of every row: k-means into ``k`` parts, none above 1.25 of its even share."""
    c = x[rng.choice(x.shape[0], k, replace=False)].copy()
    cap = -(-5 * x.shape[0] // (4 * k))
    for _ in range(8):
        far = np.square(c).sum(axis=1) - 2 * (x @ c.T)
        order = np.argsort(far, axis=1)
        part, room = np.full(x.shape[0], -1), np.full(k, cap)
        for turn in range(k):                 # a part that is full keeps its nearest; the others try their next choice
            left = np.flatnonzero(part < 0)
            if not left.size:
                break
            want = order[left, turn]
            o = np.lexsort((far[left, want], want))
            left, want = left[o], want[o]
            nth = np.arange(want.size) - np.searchsorted(want, want)
            ok = nth < room[want]
            part[left[ok]] = want[ok]
            room -= np.bincount(want[ok], minlength=k)
        for j in range(k):
            if (part == j).any():
                c[j] = x[part == j].mean(axis=0)
    return part


def balanced_lists(x: np.ndarray, lists: int, seed: int = 0) -> list[np.ndarray]:
    """Rows of ``x`` in about ``lists`` balanced parts; parts that follow each other are near each other."""
    rng, leaf = np.random.default_rng(seed), max(1, -(-x.shape[0] // max(1, lists)))
    out, stack = [], [np.arange(x.shape[0])]
    while stack:
        rows = stack.pop()
        k = min(BRANCHES, -(-rows.size // leaf))
        if k < 2:
            out.append(rows)
            continue
        part = _split(x[rows], k, rng)
        stack += [rows[part == j] for j in range(k) if (part == j).any()]
    return out


def proximity_graph(c: np.ndarray) -> np.ndarray:
    """Neighbours of every centroid: near ones of which none is nearer to one chosen before, edges both ways, and a ring that
    joins all. Rows are filled up with the centroid itself."""
    n = c.shape[0]
    edges: list[set] = [{(i + 1) % n, (i - 1) % n} for i in range(n)]
    norm = np.square(c).sum(axis=1)
    for a in range(0, n, 128):
        far = norm - 2 * (c[a:a + 128] @ c.T)
        near = np.argsort(far, axis=1)[:, 1:DEGREE + 1] if n <= DEGREE + 1 else None
        if near is None:
            near = np.argpartition(far, DEGREE, axis=1)[:, :DEGREE + 1]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1), 1)
        for i, cand in enumerate(near, a):
            cand = cand[cand != i]
            between = norm[cand][:, None] + norm[cand] - 2 * (c[cand] @ c[cand].T)
            own = norm[i] + norm[cand] - 2 * (c[cand] @ c[i])
            kept: list[int] = []
            for j in range(cand.size):
                if len(kept) < DEGREE // 2 and all(between[j, t] >= own[j] for t in kept):
                    kept.append(j)
            for j in cand[kept].tolist():
                edges[i].add(j)
                edges[j].add(i)
    out = np.tile(np.arange(n, dtype=np.int32)[:, None], (1, DEGREE))
    for i, e in enumerate(edges):
        e.discard(i)
        e = np.array(sorted(e), np.int64)
        if e.size > DEGREE:                    # the ring and the nearest
            keep = np.isin(e, [(i + 1) % n, (i - 1) % n])
            rest = e[~keep]
            rest = rest[np.argsort(norm[rest] - 2 * (c[rest] @ c[i]))][:DEGREE - int(keep.sum())]
            e = np.concatenate([e[keep], rest])
        out[i, :e.size] = e
    return out


def walk(model: dict, q: np.ndarray, width: int):
    """Best-first search of the centroid graph with a beam of ``width``: lists and distances, nearest first; an empty place
    has distance infinity."""
    c, norm, graph = model["c"], model["norm"], model["graph"]
    n, rows = c.shape[0], np.arange(q.shape[0])[:, None]
    width = min(width, n)
    own = np.square(q).sum(axis=1)[:, None]
    seen = np.zeros((q.shape[0], n), bool)

    def far(ids):
        return own + norm[ids] - 2 * np.einsum("bd,bkd->bk", q, c[ids])

    at = np.broadcast_to(np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64)), (q.shape[0], min(n, 16)))
    seen[rows, at] = True
    d, done = far(at), np.zeros(at.shape, bool)
    while True:
        keep = np.argsort(d, axis=1)[:, :width]
        at, d, done = (np.take_along_axis(a, keep, 1) for a in (at, d, done))
        open_ = np.where(done, np.inf, d)
        step = np.argsort(open_, axis=1)[:, :4]
        live = np.isfinite(np.take_along_axis(open_, step, 1))
        if not live.any():
            return at, np.sqrt(np.maximum(0.0, d))
        np.put_along_axis(done, step, True, 1)
        more = graph[np.take_along_axis(at, step, 1)].reshape(q.shape[0], -1).astype(np.int64)
        more.sort(axis=1)
        new = ~seen[rows, more] & np.repeat(live, graph.shape[1], axis=1)[:, :more.shape[1]].any(axis=1, keepdims=True)
        new[:, 1:] &= more[:, 1:] != more[:, :-1]
        seen[rows, more] = True
        size = new.sum(axis=1)
        if size.max(initial=0) == 0:
            continue
        pick = np.argsort(~new, axis=1, kind="stable")[:, :size.max()]
        more, new = np.take_along_axis(more, pick, 1), np.take_along_axis(new, pick, 1)
        at, d = np.hstack([at, more]), np.hstack([d, np.where(new, far(more), np.inf)])
        done = np.hstack([done, ~new])


def postings(model: dict, x: np.ndarray, replicas: int, edge: float):
    """Lists of lifted vectors (-1: none): the nearest, and others up to ``1 + edge`` times as far, each nearer
    to the vector than to the lists chosen before it."""
    at, d = walk(model, x, WALK)
    out, size = np.full((x.shape[0], replicas), -1), np.zeros(x.shape[0], np.int64)
    c, norm, rows = model["c"], model["norm"], np.arange(x.shape[0])
    for j in range(min(at.shape[1], 4 * replicas)):
        ok = (size < replicas) & np.isfinite(d[:, j]) & (d[:, j] <= (1 + edge) * d[:, 0])
        for t in range(replicas):
            other = out[:, t]
            gap = norm[at[:, j]] + norm[other] - 2 * np.einsum("bd,bd->b", c[at[:, j]], c[other])
            ok &= (other < 0) | (gap > np.square(d[:, j]))
        out[rows[ok], size[ok]] = at[ok, j]
        size[ok] += 1
    return out


def reach(model: dict, near: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Up to which distance a query visits lists: the ratio times the distance of the nearest, or times that list's radius."""
    return model["ratio"] * np.maximum(d[:, 0], model["radius"][near[:, 0]]) + ROUNDING * model["top"]


def _best_of(x: np.ndarray, ask: np.ndarray, m: int) -> np.ndarray:
    """Per row of ``ask`` the ``m`` other rows of largest inner product."""
    score = x @ x[ask].T
    score[ask, np.arange(ask.size)] = -np.inf
    return np.argpartition(score, x.shape[0] - m, axis=0)[x.shape[0] - m:].T


def fit(x: np.ndarray, top: float, n: int, k: int, recall: float, replicas: int, edge: float, cores: int) -> dict:
    """Lists, graph and ratio from a sample ``x`` of ``n`` different vectors of the largest norm ``top``."""
    norms = np.sqrt(np.square(x).sum(axis=1))
    up = _lift(x, norms, top)
    parts = balanced_lists(up, min(max(1, x.shape[0] // SAMPLE_PER_LIST), max(1, round(2 * n ** 0.5))))
    c = np.stack([up[p].mean(axis=0) for p in parts])
    radius = np.array([np.sqrt(np.square(up[p] - m).sum(axis=1).mean()) for p, m in zip(parts, c)])
    radius = np.maximum(radius, max(np.median(radius), ROUNDING * top))          # a list of one vector has no radius of its own
    lists = len(parts)
    blocks = min(lists, max(cores, -(-2 * n // BLOCK_ROWS)))
    model = {"top": top, "c": c, "norm": np.square(c).sum(axis=1), "graph": proximity_graph(c), "radius": radius,
             "block": (np.arange(lists) * blocks // lists).astype(np.int32), "ratio": np.inf, "beam": lists}
    # the ratio that reaches the neighbours of some vectors of the sample, in the sample
    ask = np.unique(np.linspace(0, x.shape[0] - 1, min(x.shape[0], SAMPLE_QUERIES)).astype(np.int64))
    m = min(k, x.shape[0] - 1)
    if m < 1:
        return model
    best = np.concatenate([_best_of(x, ask[a:a + 16], m) for a in range(0, ask.size, 16)])
    members = np.unique(best)
    where = np.concatenate([postings(model, up[members[a:a + BATCH]], replicas, edge) for a in range(0, members.size, BATCH)])
    held = where[np.searchsorted(members, best)]                       # query x neighbour x replica
    aim = _aim(x[ask], norms[ask], top)
    d = np.sqrt(np.maximum(0.0, np.square(aim).sum(axis=1)[:, None] + model["norm"] - 2 * aim @ c.T))
    near = np.argmin(d, axis=1)
    base = np.maximum(d[np.arange(ask.size), near], radius[near])
    far = np.where(held < 0, np.inf, np.take_along_axis(d, np.maximum(held, 0).reshape(ask.size, -1), 1).reshape(held.shape)).min(axis=2)
    model["ratio"] = float(np.quantile(far / base[:, None], recall))
    visits = (d <= model["ratio"] * base[:, None] + ROUNDING * top).sum(axis=1)
    model["beam"] = int(min(lists, 1.25 * np.quantile(visits, 0.98) + 16))
    return model


# ---- lists and queries on the executors ----------------------------------------------

def _place(models, kind: str, replicas: int, edge: float):
    """Classes -> classes with the lists that hold them (``posts``) and, for queries, the lists to visit (``visits``), by block."""
    by_block = pa.list_(pa.struct([("block", pa.int32()), ("lists", pa.list_(pa.int32()))]))

    def grouped(model, lists):
        found: dict[int, list[int]] = {}
        for i in lists:
            found.setdefault(int(model["block"][i]) if model else 0, []).append(int(i))
        return [{"block": b, "lists": i} for b, i in found.items()]

    def run(batches):
        known = models.value
        for b in batches:
            dims, norms = b.column("dim").to_numpy(), b.column("norm").to_numpy()
            asks, raw = b.column("asks").to_pylist(), b.column("vec").to_pylist()
            posts, visits = [[{"block": 0, "lists": [0]}]] * len(raw), [[{"block": 0, "lists": [0]}] if a else [] for a in asks]
            for dim in np.unique(dims):
                model = known.get(int(dim))
                if model is None:
                    continue
                same = np.flatnonzero(dims == dim)
                for a in range(0, same.size, BATCH):
                    some = same[a:a + BATCH]
                    x = np.stack([np.frombuffer(raw[i], kind).astype(np.float64) for i in some])
                    for i, lists in zip(some, postings(model, _lift(x, norms[some], model["top"]), replicas, edge)):
                        posts[i] = grouped(model, lists[lists >= 0])
                some = same[[bool(asks[i]) for i in same]]
                for a in range(0, some.size, BATCH):
                    part = some[a:a + BATCH]
                    x = np.stack([np.frombuffer(raw[i], kind).astype(np.float64) for i in part])
                    at, d = walk(model, _aim(x, norms[part], model["top"]), model["beam"])
                    for i, row, far, end in zip(part, at, d, reach(model, at, d)):
                        visits[i] = grouped(model, row[np.isfinite(far) & ((far <= end) | (far <= far[0]))])
            yield pa.record_batch({"key": b.column("key"), "dim": b.column("dim"), "vec": b.column("vec"), "members": b.column("members"),
                                   "posts": pa.array(posts, by_block), "visits": pa.array(visits, by_block)})
    return run


_HIT = {"key": pa.binary(), "near": pa.binary(), "score": pa.float64(), "least": pa.int64(), "members": _MEMBERS}


def _cell(kind: str, k: int):
    """Candidates and queries of one block -> the k + 1 best classes of every query in the lists that it visits."""
    def matrix(t):
        return np.stack([np.frombuffer(v, kind) for v in t.column("vec").to_pylist()]).astype(np.float64)

    def by_list(t):
        lists = t.column("lists").combine_chunks()
        row = np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy())
        number = lists.flatten().to_numpy()
        o = np.argsort(number, kind="stable")
        number, row = number[o], row[o]
        names = np.unique(number)
        return {int(i): r for i, r in zip(names, np.split(row, np.searchsorted(number, names[1:])))}

    def hits_of(q, x, mine, theirs, least):
        """(query, candidate, score) of the k + 1 best of every query; a hit below those that the query has so far is not kept."""
        floor, slack = np.full(len(q), -np.inf), 1e-9 * np.sqrt(np.square(q).sum(axis=1) * np.square(x).sum(axis=1).max())
        held, size = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
        for number, ask in theirs.items():
            rows = mine.get(number)
            for a in range(0, ask.size if rows is not None else 0, 512):
                some = ask[a:a + 512]
                score = q[some] @ x[rows].T
                m = min(k + 1, rows.size)
                kth = np.partition(score, rows.size - m, axis=1)[:, rows.size - m]
                low = floor[some] - slack[some]
                i, j = np.nonzero((score >= kth[:, None]) & (score >= np.where(np.isfinite(low), low, -np.inf)[:, None]))
                i, j = some[i], rows[j]
                held.append(_cut(i, j, (q[i] * x[j]).sum(axis=1), least, k))      # a score that no product's shape changes
                size += len(held[-1][0])
            if size > HITS:
                held = [_cut(*(np.concatenate(h) for h in zip(*held)), least, k)]
                size = 0
                i, last = np.unique(held[0][0][::-1], return_index=True)
                full = np.bincount(held[0][0], minlength=len(q))[i] > k
                floor[i[full]] = held[0][2][::-1][last[full]]
        return _cut(*(np.concatenate(h) for h in zip(*held)), least, k)

    def run(cand: pa.Table, asked: pa.Table) -> pa.Table:
        none, out = pa.table({c: pa.array([], t) for c, t in _HIT.items()}), []
        if cand.num_rows == 0 or asked.num_rows == 0:
            return none
        x = matrix(cand)
        members = cand.column("members").combine_chunks()
        least = members.field(0) if not isinstance(members, pa.ListArray) else members.values.field(0)
        least = least.to_numpy()[members.offsets.to_numpy()[:-1]]
        mine = by_list(cand)
        for a in range(0, asked.num_rows, ASKED_AT_ONCE):            # a part of the result at a time, each a batch of its own
            part = asked.slice(a, ASKED_AT_ONCE)
            i, j, s = hits_of(matrix(part), x, mine, by_list(part), least)
            if i.size:
                out.append(pa.table({"key": part.column("key").take(pa.array(i)), "near": cand.column("key").take(pa.array(j)), "score": s,
                                     "least": least[j], "members": members.take(pa.array(j))}))
        return pa.concat_tables(out) if out else none
    return run


def _cut(i, j, s, least, k):
    """Of (query, candidate, score) the first k + 1 different candidates of every query, by score, then smallest id."""
    o = np.lexsort((j, least[j], -s, i))
    i, j, s = i[o], j[o], s[o]
    new = np.ones(i.size, bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, s = i[new], j[new], s[new]
    keep = np.arange(i.size) - np.searchsorted(i, i) < k + 1
    return i[keep], j[keep], s[keep]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.96, replicas: int = 4, edge: float = 0.15,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product found for every query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own (another row
    with the same id, or an equal vector, is one). Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the inner product of the
    vectors in double precision, largest first, ties to the smaller id. A vector is in at most ``replicas`` lists, none more than
    ``1 + edge`` times as far as the nearest. ``recall`` is the share of the sample's neighbours that the visited lists hold;
    a table of at most ``SAMPLE_CELLS`` components is its own sample.

    Rows with a null id, and vectors that are null, zero, empty or hold null or non-finite components, take no part. Vectors of different
    lengths are not compared. Repeated query rows each give their list. Other columns are dropped. Fewer rows where
    fewer candidates are found; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    element = "float" if kind == "<f4" else "double"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{element}>").alias("v"))
    rows, classes = _classes(base, kind, every, k)
    cores = spark.sparkContext.defaultParallelism
    models = {}
    for s in classes.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), "dim").limit(MAX_MODELS).collect():
        size = max(SAMPLE_PER_LIST, SAMPLE_CELLS // s["dim"])
        part = int(min(1.0, size / s["n"]) * (1 << 30))
        sample = classes.filter((F.col("dim") == s["dim"]) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < part)).limit(2 * size)
        x = [np.frombuffer(r["vec"], kind) for r in sample.select("key", "vec").orderBy("key").select("vec").collect()]
        if x and np.isfinite(s["top"]):
            models[s["dim"]] = fit(np.stack(x).astype(np.float64), s["top"], s["n"], k, recall, replicas, edge, cores)
    shared = spark.sparkContext.broadcast(models)
    struct = "array<struct<vec_id:long,rid:long>>"
    blocks = "array<struct<block:int,lists:array<int>>>"
    placed = materialize(classes.select("key", "dim", "norm", "vec", "asks", "members").mapInArrow(
        _place(shared, kind, replicas, edge), f"key binary, dim int, vec binary, members {struct}, posts {blocks}, visits {blocks}"), "placed")
    cand = placed.select("dim", "key", "vec", "members", F.inline("posts"))
    found = materialize(_best(cand, placed.select("dim", "key", "vec", F.inline("visits")), kind, k), "found")

    # queries whose lists hold fewer than k candidates, where there are more, search every block whole
    size = rows.groupBy("dim").agg(F.count("*").alias("n"))
    short = (placed.filter(F.size("visits") > 0).select("key", "dim").join(size, "dim").join(found, "key", "left")
             .filter(F.coalesce(F.size("found"), F.lit(0)) < F.least(F.lit(k + 1), F.col("n"))).select("key"))
    short = materialize(short, "short")
    if short.head(1):
        every_block = cand.select("dim", "block").distinct()
        wide = placed.join(short, "key", "left_semi").select("dim", "key", "vec").join(every_block, "dim")
        one = F.array(F.lit(0))
        more = _best(cand.withColumn("lists", one), wide.withColumn("lists", one), kind, k)
        found = found.join(short, "key", "left_anti").unionByName(more)
    asked = rows.filter(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("query_id"), F.col("rid").alias("own"))
    own = F.col("own")
    out = asked.join(found, "key").select("query_id", F.slice(F.filter("found", lambda f: f["rid"] != own), 1, k).alias("found"))
    return out.select("query_id", F.posexplode("found").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _best(cand: DataFrame, asked: DataFrame, kind: str, k: int) -> DataFrame:
    """(key, found): the first k + 1 rows of every query among the candidates that share a block and a list with it. Blocks are cut
    into cells of bounded size."""
    # one row for a block: as many as the models have, and one for every rarer length
    def counted(df, name):
        return df.groupBy("dim", "block").agg(F.count("*").alias(name))

    room = F.greatest(F.lit(1), F.floor(F.lit(CELL_COMPONENTS) / F.col("dim")))
    seats = F.least(room, F.lit(CELL_QUERIES))
    grid = materialize(counted(cand, "c").join(counted(asked, "q"), ["dim", "block"]).select(
        "dim", "block", F.ceil(F.col("c") / room).cast("int").alias("cs"), F.ceil(F.col("q") / seats).cast("int").alias("qs")), "grid")
    part = F.xxhash64("key")
    left = cand.join(grid, ["dim", "block"]).select(
        "dim", "block", F.pmod(part, F.col("cs")).cast("int").alias("ci"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qi"),
        "key", "lists", "vec", "members")
    right = asked.join(grid, ["dim", "block"]).select(
        F.col("dim").alias("dim"), F.col("block").alias("block"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("ci"),
        F.pmod(part, F.col("qs")).cast("int").alias("qi"), F.col("key").alias("key"), F.col("lists").alias("lists"), F.col("vec").alias("vec"))
    by = ["dim", "block", "ci", "qi"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _cell(kind, k), "key binary, near binary, score double, least long, members array<struct<vec_id:long,rid:long>>")

    best = Window.partitionBy("key").orderBy(F.desc("score"), "least", "near")
    hits = hits.withColumn("at", F.dense_rank().over(best)).filter(F.col("at") <= k + 1)     # a class found in two blocks counts once
    hits = hits.groupBy("key", "near").agg(F.first("score").alias("score"), F.first("members").alias("members"))
    score = F.col("score")
    found = F.transform("members", lambda m: F.struct((-score).alias("back"), m["vec_id"].alias("vec_id"), m["rid"].alias("rid"), score.alias("score")))
    return hits.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list(found))), 1, k + 1).alias("found"))
