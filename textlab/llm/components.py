"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is one aggregation and one join over the links (no node's neighbours are
gathered into a row), written to the shared folder; the number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import materialize, release


def _relabel(links: DataFrame, small: bool) -> DataFrame:
    """One star step. ``links`` has u > v. Large: every larger neighbour of a node is linked to
    the node's smallest neighbour; small: every smaller-or-equal one is."""
    if small:
        near = links.select(F.col("u").alias("n"), F.col("v").alias("m"))
    else:
        near = links.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
            links.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = near.groupBy("n").agg(F.min("m").alias("l")).select(
        "n", F.least("n", "l").alias("l"))
    out = near.join(least, "n")
    out = (out.select(F.col("m").alias("u"), F.col("l").alias("v")) if small
           else out.filter(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("l").alias("v")))
    if small:
        out = out.unionByName(least.select(F.col("n").alias("u"), F.col("l").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of its component.

    Self-links, repeated links and null ends are ignored."""
    cur = materialize(links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = state(cur)
    for _ in range(max_rounds):
        before, cur = cur, materialize(_relabel(_relabel(cur, False), True), "links")
        release(before)
        now = state(cur)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
