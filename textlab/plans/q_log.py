"""Registered queries: training-log analysis and row selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textlab.functions import sequences as SQ
from textlab.operators import selection as SEL
from textlab.operators import trainlog as TL
from textlab.plans import preprocess as P
from textlab.plans import sqlgen as S
from textlab.plans import sqltok as Q
from textlab.plans import tokenize as TK
from textlab.plans.registry import register
from textlab.session import ensure_checkpoint_dir, materialize
from textlab.sources import tables

TLOG = ("SELECT user_id % 5 AS run, event_id % 500 AS step, value AS loss, event_id AS ingest_seq FROM events")
LAST = f"SELECT run, step, arg_max(loss, ingest_seq) AS loss, max(ingest_seq) AS ingest_seq FROM ({TLOG}) GROUP BY run, step"

# --- fixed values -----------------------------------------------------------
SAMPLE_N = 200           # W7 sample size
UNIGRAM_MAX_LINES = 150000  # W8 trainer input cap (the sampling operator's size)
FIRST_N = 1024           # F5 evaluation rows
BATCH_SIZE = 16          # W9
SOURCE_LEN = 256         # W9 source truncation
TOKEN_BUDGET = 50000     # W11
TOP_P = 0.9              # W12
# ----------------------------------------------------------------------------


@register("train_log_read", f"""SELECT run, step, round(loss, 6) AS loss,
  row_number() OVER (PARTITION BY run ORDER BY ingest_seq) AS pos FROM ({TLOG})""")
def train_log_read(spark, sf_dir):
    """The training log written as CSV files, a folder for each run, and read back with the place of every row."""
    from textlab.operators.prefix import global_row_number
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logs/{uuid.uuid4().hex}"
    files = max(2, spark.sparkContext.defaultParallelism)
    TL.write_train_log(tables.train_log(spark, sf_dir), path, "ingest_seq", "run", files)
    log = materialize(TL.read_train_log(spark, path, by_time=False, schema="step BIGINT, loss DOUBLE"), "log")
    placed = global_row_number(log, ["run", "ingest_seq"], ["run"], out="pos")
    return placed.select(F.col("run").cast("bigint").alias("run"), "step", F.round("loss", 6).alias("loss"), F.col("pos").cast("int").alias("pos"))


@register("log_keep_last", f"SELECT run, step, round(loss, 6) AS loss, ingest_seq FROM ({LAST})")
def log_keep_last(spark, sf_dir):
    """Last row per (run, step) by ingest order."""
    d = TL.keep_last(tables.train_log(spark, sf_dir), ["run", "step"])
    return d.withColumn("loss", F.round("loss", 6))


@register("log_sorted", f"SELECT run, step, round(loss, 6) AS loss, "
                        f"row_number() OVER (PARTITION BY run ORDER BY step) AS pos FROM ({LAST})")
def log_sorted(spark, sf_dir):
    """Deduplicated log in step order (position within the run)."""
    d = TL.keep_last(tables.train_log(spark, sf_dir), ["run", "step"])
    d = TL.position_in_run(d, "step", ["run"], "pos")
    return d.select("run", "step", F.round("loss", 6).alias("loss"), F.col("pos").cast("int").alias("pos"))


@register("loss_moving_avg", f"SELECT run, step, round(avg(loss) OVER (PARTITION BY run ORDER BY step "
                             f"ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS loss_avg FROM ({LAST})")
def loss_moving_avg(spark, sf_dir):
    """100-step moving average of the loss per run.

    Rounded to 9 places: means of <= 100 two-decimal values terminate by the
    8th decimal, so no value sits on a rounding tie.
    """
    d = TL.moving_avg(TL.keep_last(tables.train_log(spark, sf_dir), ["run", "step"]), "loss")
    return d.select("run", "step", F.round("loss_avg", 9).alias("loss_avg"))


@register("lr_schedule", f"""SELECT run, step, round(CASE WHEN step < warm THEN step::DOUBLE / warm
  ELSE greatest(0.0, (total - step)::DOUBLE / (total - warm)) END, 6) AS lr_factor FROM (
  SELECT run, step, max(step) OVER (PARTITION BY run) + 1 AS total,
         (max(step) OVER (PARTITION BY run) + 1) // 10 AS warm FROM ({LAST}))""")
def lr_schedule(spark, sf_dir):
    """Warm-up/decay factor for every logged step (total = last step + 1, warm-up = 10 %)."""
    d = TL.keep_last(tables.train_log(spark, sf_dir), ["run", "step"])
    # run totals by aggregation + join (no per-run window)
    tot = d.groupBy("run").agg((F.max("step") + 1).alias("total"))
    d = d.join(tot, "run").withColumn("warm", F.floor(F.col("total") / 10))
    return d.select("run", "step", F.round(TL.lr_factor(F.col("step"), F.col("total"), F.col("warm")), 6)
                    .alias("lr_factor"))


@register("sample_rows", f"SELECT doc_id, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT {SAMPLE_N}")
def sample_rows(spark, sf_dir):
    """Seeded 200-row sample of the documents."""
    return SEL.sample_rows(tables.load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", SAMPLE_N)


@register("sample_train_corpus", f"SELECT doc_id FROM ({Q.CORPUS}) ORDER BY md5('42:' || doc_id), doc_id "
                                 f"LIMIT {UNIGRAM_MAX_LINES}")
def sample_train_corpus(spark, sf_dir):
    """At most 150,000 training lines in seeded order (the Unigram trainer's input cap)."""
    return SEL.sample_rows(TK.corpus(spark, sf_dir).select("doc_id"), "doc_id", UNIGRAM_MAX_LINES)


@register("filter_first_n", f"SELECT doc_id, length(article) AS n FROM ({S.RAW_PAIRS}) WHERE split = 'test' "
                            f"ORDER BY doc_id LIMIT {FIRST_N}")
def filter_first_n(spark, sf_dir):
    """the first 1024 test rows in row order."""
    p = P.raw_pairs(spark, sf_dir).where(F.col("split") == "test")
    return SEL.first_n(p.select("doc_id", F.length("article").cast("bigint").alias("n")), "doc_id", FIRST_N)


_ENC = Q.encoded_text("word", TK.FIXTURE_VOCAB["word"], "cleaned_text")


_ENC_HL = Q.encoded_text("word", TK.FIXTURE_VOCAB["word"], "highlights")


_BATCH_PAD_SQL = f"""WITH e AS (SELECT doc_id, CASE WHEN a.ids = '' THEN []::VARCHAR[] ELSE string_split(a.ids, ' ')[1:{SOURCE_LEN}] END AS xs,
  CASE WHEN h.ids = '' THEN []::VARCHAR[] ELSE string_split(h.ids, ' ') END AS ys,
  row_number() OVER (ORDER BY doc_id) AS rn FROM ({_ENC}) a JOIN ({_ENC_HL}) h USING (doc_id)),
b AS (SELECT doc_id, xs, ys, CAST((rn - 1) // {BATCH_SIZE} AS BIGINT) AS batch_id, CAST((rn - 1) % {BATCH_SIZE} AS INT) AS row_in_batch FROM e),
m AS (SELECT *, max(len(xs)) OVER (PARTITION BY batch_id) AS mx, max(len(ys)) OVER (PARTITION BY batch_id) AS my FROM b)
SELECT doc_id, batch_id, row_in_batch, {', '.join(f"array_to_string(list_concat({c}, list_transform(range({m} - len({c})), lambda x: '0')), ' ') AS {n}"
                                                for c, m, n in (('xs', 'mx', 'padded'), ('ys', 'my', 'target_padded')))} FROM m"""


@register("batch_pad", _BATCH_PAD_SQL)
def batch_pad(spark, sf_dir):
    """Batches of 16 in row order, sources truncated to 256 ids, targets whole, both right-padded with 0."""
    e = TK.encoded(spark, sf_dir, "word").select("doc_id", "article_ids", "highlight_ids")
    b = SEL.batch_pad(e, "doc_id", "article_ids", BATCH_SIZE, SOURCE_LEN, target_col="highlight_ids")
    return b.select("doc_id", "batch_id", "row_in_batch", F.array_join("padded", " ").alias("padded"),
                    F.array_join("target_padded", " ").alias("target_padded"))


@register("token_budget", f"""SELECT doc_id, n, cum_tokens FROM (
  SELECT doc_id, n, sum(n) OVER (ORDER BY md5('42:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS cum_tokens
  FROM (SELECT doc_id, CAST(n_tokens + 2 AS BIGINT) AS n FROM ({_ENC}))) WHERE cum_tokens - n < {TOKEN_BUDGET}""")
def token_budget(spark, sf_dir):
    """Shuffled rows until a 50,000-token budget is spent (wrapped sequence lengths)."""
    e = TK.encoded(spark, sf_dir, "word").select(
        "doc_id", F.size(SQ.ids_wrap("article_ids")).cast("bigint").alias("n"))
    return SEL.token_budget(e, "doc_id", "n", TOKEN_BUDGET).select("doc_id", "n", "cum_tokens")


_ITEMS = ("SELECT user_id AS grp, event_type AS item, sum(value) AS score FROM events GROUP BY user_id, event_type")


@register("top_p_cutoff", f"""SELECT grp, item, round(p / sum(p) OVER (PARTITION BY grp), 6) AS p_kept FROM (
  SELECT grp, item, p, coalesce(sum(p) OVER (PARTITION BY grp ORDER BY p DESC, item
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT grp, item, score / sum(score) OVER (PARTITION BY grp) AS p FROM ({_ITEMS})))
WHERE before <= {TOP_P}""")
def top_p_cutoff(spark, sf_dir):
    """Nucleus cutoff (mass > 0.9, crossing item kept) per user over event-type shares."""
    d = SEL.shares(tables.weighted_items(spark, sf_dir), "grp", "score")
    return SEL.top_p_cutoff(d, "grp", "item", "p", TOP_P).select("grp", "item", F.round("p_kept", 6).alias("p_kept"))


_SHARES = f"SELECT grp, item, score / sum(score) OVER (PARTITION BY grp) AS score FROM ({_ITEMS})"


# --- fixed values -----------------------------------------------------------
MASKED_ITEM = "purchase"    # W13: the item that may not be chosen
# ----------------------------------------------------------------------------


def _softmax_sql(p):
    return f"""WITH z AS (SELECT grp, item, score, score - max(score) OVER (PARTITION BY grp) AS z FROM ({_SHARES})),
s AS (SELECT grp, item, score, exp(z) / sum(exp(z)) OVER (PARTITION BY grp) AS q FROM z),
p AS (SELECT grp, item, score, {p} AS p FROM s),
h AS (SELECT *, -sum(p * ln(p + 1e-12)) OVER (PARTITION BY grp) AS entropy, count(*) OVER (PARTITION BY grp) AS n_items FROM p),
t AS (SELECT *, greatest(1.0 * pow(n_items::DOUBLE, 1.0 / (entropy + 1e-12)), 0.01) AS temp FROM h),
u AS (SELECT *, score / temp - max(score / temp) OVER (PARTITION BY grp) AS zt FROM t)
SELECT grp, item, round(p, 6) AS p, round(entropy, 6) AS entropy, round(temp, 6) AS temp,
  round(exp(zt) / sum(exp(zt)) OVER (PARTITION BY grp), 6) AS p_temp FROM u"""


def _softmax(spark, sf_dir, masked=None):
    d = SEL.shares(tables.weighted_items(spark, sf_dir), "grp", "score", out="p_share")
    d = SEL.softmax_entropy(d.select("grp", "item", F.col("p_share").alias("score")), "grp", "score", masked=masked)
    return d.select("grp", "item", *[F.round(c, 6).alias(c) for c in ("p", "entropy", "temp", "p_temp")])


@register("softmax_entropy", _softmax_sql("q"))
def softmax_entropy(spark, sf_dir):
    """Softmax, entropy and entropy-scaled temperature per user over event-type shares."""
    return _softmax(spark, sf_dir)


@register("softmax_entropy_masked", _softmax_sql(f"CASE WHEN item = '{MASKED_ITEM}' THEN 0.0 ELSE q END"))
def softmax_entropy_masked(spark, sf_dir):
    """W13 with an item masked before the entropy."""
    return _softmax(spark, sf_dir, F.col("item") == MASKED_ITEM)


@register("log_keep_last_stream", f"SELECT run, step, round(loss, 6) AS loss, ingest_seq FROM ({LAST})")
def log_keep_last_stream(spark, sf_dir):
    """W1 as a stream over the events files: micro-batches merged into a table of last rows."""
    from textlab.streaming.trainlog import keep_last_stream, read_last
    schema = tables.load(spark, sf_dir, "events").schema
    # the table directory holds every table: pick the events file by name
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    s = s.select((F.col("user_id") % 5).alias("run"), (F.col("event_id") % 500).alias("step"),
                 F.col("value").alias("loss"), F.col("event_id").alias("ingest_seq"))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    keep_last_stream(s, f"{base}/last", f"{base}/checkpoint", ["run", "step"])
    return read_last(spark, f"{base}/last").select("run", "step", F.round("loss", 6).alias("loss"), "ingest_seq")


@register("ids_strip_pad", f"""SELECT doc_id, array_to_string(list_filter(string_split(padded, ' '), lambda x: x <> '0'), ' ') AS out
FROM ({_BATCH_PAD_SQL})""")
def ids_strip_pad(spark, sf_dir):
    """T20 variant: drop only the pad id (0) from the padded batch rows of W9."""
    e = TK.encoded(spark, sf_dir, "word").select("doc_id", "article_ids")
    p = SEL.batch_pad(e, "doc_id", "article_ids", BATCH_SIZE, SOURCE_LEN)
    return p.select("doc_id", F.array_join(SQ.ids_strip_special("padded", drop=(SQ.PAD_ID,)), " ").alias("out"))
