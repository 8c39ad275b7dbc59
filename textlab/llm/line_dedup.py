"""Line deduplication by a template tree of fixed depth.

A line goes down the tree by its number of tokens and its first tokens (tokens with a digit count
as variable) to a leaf. In a leaf, a token that stands at its position in the lines of fewer than
``min_docs`` different texts is a variable field. What remains is the line's template; templates that
recur across documents are boilerplate, and their lines are dropped. DataFrame functions only.

A line whose whole text recurs unchanged needs no template: it is dropped as soon as
it stands in ``same_docs`` texts, by a count of line fingerprints (64-bit hash and length).

Only lines of leaves that enough texts reach are looked at token by token, each different one once. Documents with the same
text count once, so that copies of a document (which exact deduplication removes) do not empty it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\r\x0b\x0c"
VARIABLE = "<*>"


def _generalised(token) -> F.Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def _same_lines(base: DataFrame, key: F.Column, min_tokens: int, min_docs: int, same_docs: int) -> DataFrame:
    """``(key, pos)`` of the lines that stand unchanged in enough different texts."""
    token = SPACE.replace("[", "[^", 1)
    long = F.col("line").rlike(f"^(?:{token}{SPACE}){{{min_tokens - 1}}}{token[:-1]}")          # min_tokens tokens, without a split
    bound = F.when(long, F.lit(same_docs)).otherwise(F.lit(min_docs))
    lines = materialize(
        base.filter("text is not null").select(key.alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("key", "pos", F.trim(F.col("line"), F.lit(BLANKS)).alias("line")).filter("line <> ''")
        .select("key", "pos", F.xxhash64("line").alias("h"), F.length("line").alias("len"), bound.alias("bound")), "same")
    often = (lines.select("h", "len", "bound", "key").distinct().groupBy("h", "len", "bound").count()
             .filter(F.col("count") >= F.col("bound")).select("h", "len"))
    return lines.join(materialize(often, "often"), ["h", "len"], "left_semi").select("key", "pos")


def _repeated(cand: DataFrame) -> DataFrame:
    """(leaf, at, token, again): how often a token stands at its place in further lines of a text that has it there already."""
    lines = cand.select("leaf", "key", "line").distinct()
    several = lines.groupBy("leaf", "key").count().filter("count > 1").select("leaf", "key")
    tokens = lines.join(several, ["leaf", "key"], "left_semi").select("leaf", "key", F.posexplode(F.split("line", SPACE)).alias("at", "raw"))
    return (tokens.groupBy("leaf", "key", "at", _generalised(F.col("raw")).alias("token")).count().filter("count > 1")
            .groupBy("leaf", "at", "token").agg(F.sum(F.col("count") - 1).alias("again")))


def drop_recurring_lines(docs: DataFrame, lead: int = 3, min_tokens: int = 3, min_docs: int = 10, fixed: float = 0.6,
                         same_docs: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the lines whose template recurs in ``min_docs`` different texts or more, and without those that stand
    unchanged (but for blanks around them) in ``same_docs`` different texts or more.

    A template needs at least ``min_tokens`` tokens and a share of ``fixed`` that are no variable fields; a token is
    none if ``min_docs`` different texts have it there. Unchanged lines of fewer than ``min_tokens`` tokens, blank ones
    excepted, go where they stand in ``min_docs`` texts. Without ``same_docs`` only templates count. All copies of a line go, so near
    copies of whole documents should be removed before.
    Returns one row per input row: ``doc_id``, ``text`` (the other lines, unchanged and in order),
    ``n_lines``, ``n_dropped``; other columns are dropped. A null text stays null with 0 lines; an empty one has one empty line,
    which stays. Repeated rows are treated alike, and a line that is repeated in one text counts once. Lines and texts of any length are read
    whole. An empty table gives an empty result.
    """
    key = F.struct(F.xxhash64("text").alias("a"), F.length("text").alias("b"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = (base.filter("text is not null").select(key.alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .select("key", "pos", F.trim(F.col("line"), F.lit(BLANKS)).alias("line"))
             .withColumn("tokens", F.split("line", SPACE)).filter(F.size("tokens") >= min_tokens)
             .select("key", "pos", "line", F.xxhash64(F.size("tokens"), *[
                 _generalised(F.get("tokens", F.lit(i))) for i in range(lead)]).alias("leaf")))
    leaves = materialize(lines.select("leaf", "key").distinct().groupBy("leaf").count()
                         .filter(F.col("count") >= min_docs).select("leaf"), "leaves")
    cand = materialize(lines.join(leaves, "leaf", "left_semi").select("leaf", "line", "key", "pos"), "candidates")
    seen = cand.select("leaf", "line", "key").distinct().groupBy("leaf", "line").agg(F.count("*").alias("n"))
    seen = materialize(seen.withColumn("id", F.monotonically_increasing_id()), "lines")
    tokens = seen.select("leaf", "id", "n", F.posexplode(F.split("line", SPACE)).alias("at", "raw")).select(
        "leaf", "id", "n", "at", _generalised(F.col("raw")).alias("token"))
    support = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("s"))
    support = support.join(_repeated(cand), ["leaf", "at", "token"], "left").select(
        "leaf", "at", "token", (F.col("s") - F.coalesce("again", F.lit(0))).alias("s"))
    constant = (F.col("s") >= min_docs) & (F.col("token") != VARIABLE)
    templates = (tokens.join(support, ["leaf", "at", "token"])
                 .select("leaf", "id", "at", constant.cast("int").alias("c"),
                         F.when(constant, F.col("token")).otherwise(F.lit(VARIABLE)).alias("token"))
                 .groupBy("leaf", "id").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"), F.avg("c").alias("fixed"))
                 .filter(F.col("fixed") >= fixed).select("id", F.xxhash64("leaf", "t.token").alias("template")))
    named = materialize(seen.join(templates, "id").select("leaf", "line", "template"), "named")
    recurring = (cand.join(named, ["leaf", "line"]).select("template", "key").distinct().groupBy("template").count()
                 .filter(F.col("count") >= min_docs).select("template"))
    # decided on the different lines: a hot template's hits never meet in a join
    gone = cand.join(named.join(recurring, "template", "left_semi"), ["leaf", "line"], "left_semi").select("key", "pos")
    if same_docs is not None:
        gone = gone.unionByName(_same_lines(base, key, min_tokens, min_docs, same_docs))
    drops = gone.groupBy("key").agg(F.collect_set("pos").alias("drop")).withColumnRenamed("key", "drop_key")
    joined = base.withColumn("key", F.when(F.col("text").isNotNull(), key)).join(drops, F.col("key") == F.col("drop_key"), "left")
    joined = joined.withColumn("every", F.split("text", "\n"))
    every = F.col("every")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("drop")), lambda i: F.get(every, i))
    return joined.select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                         F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
