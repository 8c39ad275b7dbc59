"""Chat formatting of reply trees.

Messages point to the message they answer. Iterative self-joins with doubling steps enumerate the
root-to-leaf paths (a chain of n messages takes log2(n) rounds), branches are ranked by the mean
score of their messages, and every chosen path becomes one conversation with a loss mask.
DataFrame functions only.

Format of a turn: ``### <role></role><text></turn>`` and a newline. Role and text have every
backslash doubled and the control strings broken by a backslash, so that none of them stands
inside a text, and dropping the first of every backslash and its follower restores it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import materialize

MARK, ROLE_END, TURN_END = "### ", "</role>", "</turn>"
LEARNT = "assistant"


def escape(c) -> F.Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit(ROLE_END), F.lit("<\\/role>"))
    c = F.replace(c, F.lit(TURN_END), F.lit("<\\/turn>"))
    return F.replace(c, F.lit(MARK), F.lit("#\\## "))


def unescape(c) -> F.Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(leaf, uid, up) of every root-to-leaf path of ``nodes`` (tree, uid, parent uid or null):
    ``up`` counts the steps from the leaf. Messages whose ancestry runs in a circle belong to no path."""
    links = nodes.filter("parent is not null").select("uid", F.col("parent").alias("anc"))
    leaves = nodes.select("uid").join(links.select(F.col("anc").alias("uid")).distinct(), "uid", "left_anti")
    paths = materialize(leaves.select(F.col("uid").alias("leaf"), "uid", F.lit(0).cast("long").alias("up")), "paths")
    jump = materialize(links, "jump")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step <= largest and jump.head(1):
        longer = paths.join(jump, "uid").select("leaf", F.col("anc").alias("uid"), (F.col("up") + step).alias("up"))
        far = jump.select("uid", F.col("anc").alias("mid")).join(
            jump.select(F.col("uid").alias("mid"), "anc"), "mid").select("uid", "anc")
        paths, jump = materialize(paths.unionByName(longer), "paths"), materialize(far, "jump")
        step *= 2
    roots = nodes.filter("parent is null").select("uid")
    return paths.join(paths.join(roots, "uid", "left_semi").select("leaf").distinct(), "leaf", "left_semi")


def conversations(messages: DataFrame, branches: int = 1, tree: str = "tree_id", node: str = "msg_id", parent: str = "parent_id",
                  role: str = "role", text: str = "text", score: str | None = None) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of every tree, each formatted as one conversation.

    Returns ``tree``, ``branch`` (rank from 1, by mean score, null scores counting 0, then by the leaf
    that comes first), ``n_turns``, ``formatted`` and ``loss_spans``: (start, length) in code points of the escaped
    assistant texts in ``formatted``. A null text is empty, a null role too. A message without
    parent, or whose parent is not there, is a root. Of messages with the same id in a tree the answers go to
    the one of the first role and text; repeated rows are branches of their own. Null trees are one
    tree; a null id answers nothing and is answered by none. An empty table gives an empty result. A
    conversation is one row, and so as long as it is.
    """
    rows = materialize(messages.select(
        F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("above"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
        (F.coalesce(F.col(score), F.lit(0)) if score else F.lit(0)).cast("double").alias("score"),
        F.monotonically_increasing_id().alias("uid")), "messages")
    first = rows.filter("node is not null").groupBy("tree", "node").agg(
        F.min(F.struct("role", F.xxhash64("text"), "uid")).alias("f")).select(
        F.col("tree").alias("ptree"), F.col("node").alias("pnode"), F.col("f.uid").alias("parent"))
    nodes = materialize(rows.select("tree", "uid", "above").join(
        first, F.col("tree").eqNullSafe(F.col("ptree")) & (F.col("above") == F.col("pnode")), "left").select(
        "tree", "uid", F.when(F.col("parent") != F.col("uid"), F.col("parent")).alias("parent")), "nodes")
    paths = reply_paths(nodes)
    on_path = paths.join(rows.select("uid", "tree", "node", "score"), "uid")
    ranked = on_path.groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.count("*").alias("n_turns"), F.avg("score").alias("s"),
        F.max(F.when(F.col("up") == 0, F.col("node"))).alias("leaf_node"))
    w = Window.partitionBy("tree").orderBy(F.desc("s"), F.col("leaf_node").asc_nulls_last(), "leaf")
    chosen = ranked.withColumn("branch", F.row_number().over(w)).filter(F.col("branch") <= branches).select("leaf", "branch", "n_turns")

    turns = paths.join(chosen, "leaf").join(rows.select("uid", "tree", "role", "text"), "uid")
    head = F.concat(F.lit(MARK), escape(F.col("role")), F.lit(ROLE_END))
    turns = turns.select("leaf", "tree", "branch", "n_turns", (F.col("n_turns") - F.col("up")).alias("turn"),
                         (F.col("role") == LEARNT).alias("learnt"), head.alias("head"), escape(F.col("text")).alias("body"))
    piece = F.concat("head", "body", F.lit(TURN_END + "\n"))
    order = Window.partitionBy("leaf").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("leaf", "tree", "branch", "n_turns", "turn", "learnt", piece.alias("piece"),
                         F.length("head").alias("lead"), F.length("body").alias("length"))
    turns = turns.withColumn("before", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    packed = turns.groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("branch").alias("branch"), F.first("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), F.struct((F.col("before") + F.col("lead")).alias("start"), F.col("length").cast("long").alias("length"))))).alias("loss_spans"))
    return packed.select(F.col("tree").alias(tree), "branch", "n_turns", F.array_join("pieces.piece", "").alias("formatted"), "loss_spans")


def read_turns(formatted) -> F.Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, TURN_END + "\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substring_index(p, ROLE_END, 1).substr(F.lit(len(MARK) + 1), F.length(p))).alias("role"),
        unescape(p.substr(F.instr(p, F.lit(ROLE_END)) + len(ROLE_END), F.length(p))).alias("text")))


def read_loss(formatted, spans) -> F.Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
