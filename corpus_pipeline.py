"""A corpus pipeline over ``documents``: language, exact copies, near copies, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and reread as the next one's ``docs``. All but the last return the columns of ``documents``. Stages decide about
rows, not ids: rows that share an id, or have none, are kept or dropped each for itself.

A stage's result is to be written before the next stage is called: the call deletes the tables that the stage
before it wrote on its way, unless its ``docs`` still read them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.exact_dedup import exact_groups
from textlab.llm.jaccard import jaccard_components
from textlab.llm.langid import UNKNOWN, predicted
from textlab.llm.mixing import mixture as mixed
from textlab.llm.packing import best_fit
from textlab.llm.rows import fresh, numbered, without
from textlab.session import drop_tables, materialize, release, table_scope

MIN_LANGUAGE_SCORE = 0.05      # below, hardly any of a text's n-grams is in a learnt profile

_left: dict = {}               # application -> tables of the stage called last


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _left.pop(app, [])
        folders = {f.split("/")[-2] for f in docs.inputFiles()} if left else set()
        used = [p for p in left if p.split("/")[-1] in folders]
        drop_tables(spark, [p for p in left if p not in used])
        with table_scope() as made:
            out = fn(spark, docs, sf_dir)
        _left[app] = used + made
        return out
    return run_stage


def _keyed(docs: DataFrame):
    """(``docs`` with a row number, its name, narrow docs whose id is (no id, id, row number), so that it is never null and ends every tie)."""
    row = fresh(docs, "__row")
    docs = numbered(docs, row)
    key = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), docs[row].alias("row"))
    return docs, row, docs.select(key.alias("doc_id"), docs["text"].alias("text"))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; texts without letters, and those of which the profiles know
    next to nothing, go."""
    docs, row, _ = _keyed(docs)
    found = predicted(docs.select("doc_id", "text", "lang", F.col(row).alias("row")))
    gone = found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < MIN_LANGUAGE_SCORE))
    return without(docs, gone.select("row"), row).drop(row)


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts (operator 5's keeper)."""
    docs, row, narrow = _keyed(docs)
    return without(docs, exact_groups(narrow).filter("not kept").select("doc_id.row"), row).drop(row)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of near copies (5-word shingles, similarity 0.8 and more): that of the smallest id."""
    docs, row, narrow = _keyed(docs)
    groups = jaccard_components(narrow, width=5, threshold=(4, 5))
    return without(docs, groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id.row"), row).drop(row)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, as often as it takes them (0 to 2 times)."""
    return mixed(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of every piece of every document that is left (last stage)."""
    return best_fit(docs).drop("rid")


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("mix_sources", mixture), ("pack", packed)]

#: SQL cannot express language identification or packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
