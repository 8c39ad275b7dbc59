"""Deterministic row selection and batching.

Seeded randomness is a hash order (``md5(seed:key)``), identical in any SQL
engine, instead of ``sample()`` whose result depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators.prefix import global_row_number, running_total

# --- fixed values -----------------------------------------------------------
SEED = 42
ENTROPY_EPS = 1e-12
MIN_TEMPERATURE = 1e-2
# ----------------------------------------------------------------------------


def seeded_key(key, seed: int = SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


HASH_DIGITS = 32
STEP = 3                    # hash digits a pass: 4,096 buckets


def hash_edge(hashes: DataFrame, n: int) -> tuple[str, int]:
    """(edge, rest) for a column ``h`` of hex hashes: all rows with ``h < edge`` and ``rest`` of those with ``h = edge`` are the ``n``
    smallest ones (all rows, if fewer: the edge lies behind the last hash).

    Rows are counted by leading digits; only the bucket in which the n-th row lies is looked at again, some digits
    deeper, until it is taken whole or is a single hash. A pass sends at most 4,096 counts to the driver.
    """
    edge, left = "", int(n)
    for depth in range(STEP, HASH_DIGITS + STEP, STEP):
        here = hashes.where(F.startswith(F.col("h"), F.lit(edge))) if edge else hashes
        counts = sorted((r["b"], int(r["n"])) for r in here.groupBy(F.substring("h", 1, depth).alias("b")).agg(F.count("*").alias("n")).collect())
        for bucket, size in counts:
            if size > left:
                break
            left -= size
        else:
            return edge + "g" if edge else "g", 0         # behind every hex digit: the whole bucket
        if left == 0:
            return bucket, 0
        edge = bucket
        if len(edge) >= HASH_DIGITS:
            return edge, left
    return edge, left


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """The ``n`` rows of smallest seeded hash (all rows, if fewer), by a threshold on hash counts and a filter: nothing is sorted,
    and no task reads more than its share. Rows with equal keys have one hash; where the sample ends among them, any of them are taken. A null
    key is a key."""
    h = F.coalesce(seeded_key(key, seed), F.md5(F.lit(f"{seed}:")))
    edge, rest = hash_edge(df.select(h.alias("h")), n)
    out = df.where(h < F.lit(edge))
    return out.unionByName(df.where(h == F.lit(edge)).limit(rest)) if rest else out


def first_n(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """the first ``n`` rows in ``order_col`` order."""
    return df.orderBy(order_col).limit(n)


def batch_pad(df: DataFrame, order_col: str, ids_col: str, batch_size: int, max_len: int | None = None,
              pad_id: int = 0, target_col: str | None = None) -> DataFrame:
    """Consecutive fixed-size batches in ``order_col`` order. Source ids are truncated to
    ``max_len`` and right-padded with ``pad_id`` to the longest sequence of the batch (``padded``); those of ``target_col``, if
    given, are padded without truncation (``target_padded``).

    The global row number comes from a two-phase prefix sum (no single-task window).
    """
    sides = {"padded": F.col(ids_col) if max_len is None else F.slice(ids_col, 1, max_len)}
    if target_col is not None:
        sides["target_padded"] = F.col(target_col)
    d = global_row_number(df.select("*", *[c.alias(f"__{n}") for n, c in sides.items()]), [order_col], out="__rn")
    d = (d.withColumn("batch_id", F.floor((F.col("__rn") - 1) / batch_size).cast("bigint"))
          .withColumn("row_in_batch", ((F.col("__rn") - 1) % batch_size).cast("int")))
    w = Window.partitionBy("batch_id")
    for n in sides:
        ids = F.col(f"__{n}")
        d = d.withColumn(n, F.concat(ids, F.array_repeat(F.lit(pad_id), (F.max(F.size(ids)).over(w) - F.size(ids)).cast("int"))))
    return d.drop("__rn", *[f"__{n}" for n in sides])


def token_budget(df: DataFrame, key: str, tokens_col: str, budget: int, seed: int = SEED) -> DataFrame:
    """Rows in seeded order until ``budget`` tokens are spent (the row that
    crosses the budget is included); running sum via two-phase prefix sums."""
    d = df.withColumn("__h", seeded_key(key, seed))
    d = running_total(d, ["__h", key], tokens_col, out="cum_tokens")
    return d.where(F.col("cum_tokens") - F.col(tokens_col) < budget).drop("__h")


def shares(df: DataFrame, group: str, score: str, out: str = "p") -> DataFrame:
    w = Window.partitionBy(group)
    return df.withColumn(out, F.col(score) / F.sum(score).over(w))


def top_p_cutoff(df: DataFrame, group: str, item: str, p_col: str, top_p: float) -> DataFrame:
    """Per group, the smallest prefix by descending probability whose mass
    exceeds ``top_p`` (the crossing row included), renormalized."""
    w = Window.partitionBy(group).orderBy(F.desc(p_col), item)
    d = df.withColumn("__before", F.coalesce(
        F.sum(p_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.where(F.col("__before") <= top_p)
    return d.withColumn("p_kept", F.col(p_col) / F.sum(p_col).over(Window.partitionBy(group))).drop("__before")


def softmax_entropy(df: DataFrame, group: str, score: str, temperature: float = 1.0,
                    theta: float = 1.0, masked: Column | None = None) -> DataFrame:
    """Softmax per group, its entropy, and the entropy-scaled temperature
    ``T * N ** (theta / H)`` (floored at 0.01) with the re-tempered softmax. Items for which ``masked`` is true have
    probability 0 before the entropy is taken (the others are not scaled up), and take part in the re-tempered softmax."""
    w = Window.partitionBy(group)
    d = df.withColumn("__z", F.col(score) - F.max(score).over(w))
    d = d.withColumn("p", F.exp("__z") / F.sum(F.exp("__z")).over(w))
    if masked is not None:
        d = d.withColumn("p", F.when(masked, F.lit(0.0)).otherwise(F.col("p")))
    d = d.withColumn("entropy", -F.sum(F.col("p") * F.log(F.col("p") + ENTROPY_EPS)).over(w))
    d = d.withColumn("n_items", F.count("*").over(w))
    t = F.lit(temperature) * F.pow(F.col("n_items").cast("double"), F.lit(theta) / (F.col("entropy") + ENTROPY_EPS))
    d = d.withColumn("temp", F.greatest(t, F.lit(MIN_TEMPERATURE)))
    d = d.withColumn("__zt", (F.col(score) / F.col("temp")) - F.max(F.col(score) / F.col("temp")).over(w))
    d = d.withColumn("p_temp", F.exp("__zt") / F.sum(F.exp("__zt")).over(w))
    return d.drop("__z", "__zt")
