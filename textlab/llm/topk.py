"""Exact top-k search by tiled matrix products.

Vectors are packed into tiles of bounded size, written once. Groups of candidate tiles and groups
of query tiles form a grid; a cell multiplies tile by tile, keeps the k best of every query in
each product, and merges them into one list per query. The lists of a query are merged in a tree
with a fixed fan-in. Scores are integer inner products, computed in floating point only where
every product and sum is below 2**53.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import materialize, ship_package

TILE_CELLS = 1 << 18            # components of a tile
GROUP_TILES = 16                # candidate tiles of a grid cell
QUERY_TILES = 16                # query tiles of a grid cell
FAN_IN = 16
_TYPES = ("<i2", "<i4", "<f8")
TILE = "tile string, dim int, n int, kind int, ids binary, data binary"


def _pack(scale: float):
    """Rows (id, vector) -> tiles of floor(scale * x); rows that take no part are left out."""
    def tile(ids, rows):
        x = np.floor(scale * np.stack(rows)) if rows[0].size else np.zeros((len(rows), 0))
        top = np.abs(x).max(initial=0)
        kind = 0 if top < 1 << 15 else 1 if top < 1 << 31 else 2
        return {"tile": uuid.uuid4().hex, "dim": x.shape[1], "n": len(ids), "kind": kind,
                "ids": np.array(ids, "<i8").tobytes(), "data": x.astype(_TYPES[kind]).tobytes()}

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid:
                    continue
                v = v.values
                if v.null_count:
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                ids, rows = held.setdefault(x.size, ([], []))
                ids.append(i)
                rows.append(x)
                if len(ids) * max(1, x.size) >= TILE_CELLS:
                    out.append(tile(*held.pop(x.size)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_TILE_SCHEMA)
        rest = [tile(*x) for x in held.values()]
        if rest:
            yield pa.RecordBatch.from_pylist(rest, schema=_TILE_SCHEMA)
    return run


_TILE_SCHEMA = pa.schema([("tile", pa.string()), ("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.int32()),
                          ("ids", pa.binary()), ("data", pa.binary())])


def _matrix(n, dim, kind, data):
    return np.frombuffer(data, _TYPES[kind]).reshape(n, dim).astype(np.float64)


def _queries(every: int):
    """Tiles -> their query rows: origin (tile, row), id, vector."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                pick = np.flatnonzero(ids % every == 0)
                if pick.size:
                    x = _matrix(r["n"], r["dim"], r["kind"], r["data"])[pick]
                    yield pa.record_batch({"tile": pa.array([r["tile"]] * pick.size), "row": pick.astype(np.int32), "query_id": ids[pick],
                                           "dim": np.full(pick.size, r["dim"], np.int32),
                                           "vec": pa.array([v.tobytes() for v in x], pa.binary())})
    return run


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; what no long holds stops at its ends."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    if bound < 2.0 ** 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    out = whole(q) @ whole(c).T
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, out: np.ndarray, k: int):
    """Per row the k best (score, then smaller id) of the columns not in ``out``; missing ones marked."""
    k = min(k, score.shape[1])
    kth = np.partition(np.where(out, np.iinfo(np.int64).min, score), score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    rows, cols = np.nonzero((score >= kth[:, None]) & ~out)
    s, i = score[rows, cols], ids[rows, cols]
    o = np.lexsort((i, ~s, rows))
    rows, s, i = rows[o], s[o], i[o]
    at = np.arange(rows.size) - np.searchsorted(rows, np.arange(score.shape[0]))[rows]
    keep = at < k
    rows, at = rows[keep], at[keep]
    bs, bi, none = np.zeros((score.shape[0], k), np.int64), np.zeros((score.shape[0], k), np.int64), np.ones((score.shape[0], k), bool)
    bs[rows, at], bi[rows, at], none[rows, at] = s[keep], i[keep], False
    return bs, bi, none


def _cell(k: int):
    """One grid cell: candidate tiles x queries -> a list of the best per query."""
    def run(tiles: pa.Table, queries: pa.Table) -> pa.Table:
        names = {"tile": pa.string(), "row": pa.int32(), "query_id": pa.int64(), "grp": pa.int32(), "top": _TOP}
        if tiles.num_rows == 0 or queries.num_rows == 0:
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        grp, dim = tiles.column("sg")[0].as_py(), queries.column("dim")[0].as_py()
        made = []
        step = max(1, TILE_CELLS // 4 // max(1, dim))
        for a in range(0, queries.num_rows, step):
            part = queries.slice(a, step)
            q = np.frombuffer(b"".join(x.as_py() for x in part.column("vec"))).reshape(part.num_rows, dim)
            own_tile, own_row = np.array(part.column("tile").to_pylist(), object), part.column("row").to_numpy()
            s = i = none = None
            for t in tiles.to_pylist():
                ids = np.broadcast_to(np.frombuffer(t["ids"], "<i8"), (part.num_rows, t["n"]))
                out = np.zeros(ids.shape, bool)
                mine = np.flatnonzero(own_tile == t["tile"])
                out[mine, own_row[mine]] = True
                ts, ti, tn = _best(_scores(q, _matrix(t["n"], dim, t["kind"], t["data"])), ids, out, k)
                if s is not None:
                    ts, ti, tn = _best(np.hstack([s, ts]), np.hstack([i, ti]), np.hstack([none, tn]), k)
                s, i, none = ts, ti, tn
            size = (~none).sum(axis=1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            items = pa.StructArray.from_arrays([pa.array(~s[~none]), pa.array(i[~none])], names=["back", "vec_id"])
            made.append(pa.table({"tile": part.column("tile"), "row": part.column("row"), "query_id": part.column("query_id"),
                                  "grp": np.full(part.num_rows, grp, np.int32), "top": pa.ListArray.from_arrays(offsets, items)}))
        return pa.concat_tables(made)
    return run


_TOP = pa.list_(pa.struct([("back", pa.int64()), ("vec_id", pa.int64())]))


def exact_topk(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0,
               id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product of every query, over floor(``scale`` * x) of all components.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own
    (another row with the same id is one). Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``;
    equal scores go to the smaller id; fewer rows where there are fewer candidates. Rows with a null id, a null
    vector, or one with null or non-finite components take no part. Vectors of different lengths
    are not compared; two empty ones have score 0. Scores that no long holds stop at its ends. Repeated
    query rows each give their list. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    tiles = materialize(vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(_pack(scale), TILE), "tiles")
    queries = materialize(tiles.mapInArrow(_queries(every), "tile string, row int, query_id long, dim int, vec binary"), "queries")
    sizes = tiles.agg(F.count("*"), F.max("dim")).first()
    n_tiles, dim = int(sizes[0]), max(1, int(sizes[1] or 1))
    n_queries = queries.count()
    cores = spark.sparkContext.defaultParallelism
    sg = max(1, -(-n_tiles // GROUP_TILES), min(n_tiles, cores))
    qg = max(1, -(-n_queries * dim // (QUERY_TILES * TILE_CELLS)))

    def group(n, *cols):
        return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")

    grid = (F.explode(F.sequence(F.lit(0), F.lit(qg - 1))).alias("qg"))
    left = tiles.withColumn("sg", group(sg, "tile")).select("*", grid)
    right = queries.withColumn("qg", group(qg, "tile", "row")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(sg - 1))).alias("sg"))
    lists = left.groupBy("dim", "sg", "qg").cogroup(right.groupBy("dim", "sg", "qg")).applyInArrow(
        _cell(k), "tile string, row int, query_id long, grp int, top array<struct<back:long,vec_id:long>>")
    n = sg
    while True:                                  # tree of merges: at most FAN_IN lists meet in a row
        n = -(-n // FAN_IN)
        lists = lists.groupBy("tile", "row", "query_id", F.floor(F.col("grp") / FAN_IN).cast("int").alias("grp")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if n <= 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.bitwise_not("hit.back").alias("score"))
