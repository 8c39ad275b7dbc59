"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.llm import chat
from textlab.llm.ann import nearest
from textlab.llm.divergence import audit
from textlab.llm.exact_dedup import exact_groups
from textlab.llm.fim import fill_in_middle, restored
from textlab.llm.jaccard import jaccard_components
from textlab.llm.langid import identify
from textlab.llm.line_dedup import drop_recurring_lines
from textlab.llm.lm import score_texts
from textlab.llm.mixing import mix
from textlab.llm.packing import best_fit
from textlab.llm.quality import classify
from textlab.llm.topk import exact_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_exact_dedup", sql="""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
    FROM documents),
g AS (
    SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op5_exact_dedup(spark, sf_dir):
    """Operator 5 over all documents."""
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op8_ngram_jaccard_join", sql="""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [list_aggregate(words, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
    FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_sides AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM both_sides JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
    WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)
""")
def op8_ngram_jaccard_join(spark, sf_dir):
    """Operator 8 over all documents: sets of 3-word shingles, similarity 90 of 100 and more."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, threshold=(90, 100))


@query("op10_mix_sources", sql="""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           md5(coalesce('i' || doc_id::VARCHAR, 't' || coalesce(text, ''))) AS h FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
    FROM d GROUP BY source),
-- a source is capped while the rate that the sources of a larger cap for their weight leave is above its own
r AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k,
           coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
           sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
    FROM s),
rate AS (SELECT coalesce(arg_min((total - capped_before) / weight_left, k) FILTER (WHERE (total - capped_before) / weight_left * weight <= cap), 0) AS rate FROM r),
t AS (SELECT source, source_size, least(cap, weight * rate) AS target FROM s, rate),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
u AS (SELECT source, h, sum(size)::BIGINT AS unit FROM d GROUP BY source, h),
c AS (
    SELECT u.source, u.h, u.unit, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS rest,
           sum(u.unit) OVER (PARTITION BY u.source ORDER BY u.h) - u.unit AS before
    FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.source, d.size, c.source_size, c.target,
       c.base + (c.base < 2 AND (c.before + c.unit <= c.rest OR (c.before <= c.rest AND c.unit <= 2 * (c.rest - c.before))))::BIGINT AS copies,
       d.size * copies AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
""")
def op10_mix_sources(spark, sf_dir):
    """Operator 10 over all documents: weights 3, 1, 2, a share of 150 %, at most two copies."""
    return mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


@query("op1_exact_topk", sql="""
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.rid AS qrid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op1_exact_topk(spark, sf_dir):
    """Operator 1: ten best of every hundredth vector against all."""
    return exact_topk(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024.0)


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    """Operator 2 over all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_chat_formatting", sql=r"""
WITH c AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
    SELECT *, replace(replace(replace(replace(text, '\', '\\'), '</role>', '<\/role>'), '</turn>', '<\/turn>'), '### ', '#\## ') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 7 + length(esc) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op3_chat_formatting(spark, sf_dir):
    """Operator 3: every conversation is a tree of one branch, its rows in order of turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    tree = rows.unionByName(extra).withColumn("msg", F.row_number().over(order)).withColumn("answers", F.col("msg") - 1)
    out = chat.conversations(tree, 1, "conv_id", "msg", "answers", "role", "text")
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    return out.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    """Operator 4 over all documents."""
    return score_texts(table(spark, sf_dir, "documents"))


@query("op6_line_dedup", sql="""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS every FROM documents),
l AS (
    SELECT text, unnest(range(len(every))) AS pos, trim(unnest(every), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
    FROM (SELECT DISTINCT text, every FROM d WHERE text IS NOT NULL)),
t AS (
    SELECT *, string_split_regex(line, '[\x20\x09-\x0D]+') AS raw,
           list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens,
           (len(raw)::VARCHAR || chr(31) || array_to_string(tokens[1:3], chr(31))) AS leaf
    FROM l WHERE len(string_split_regex(line, '[\x20\x09-\x0D]+')) >= 3),
leaves AS (SELECT leaf FROM t GROUP BY leaf HAVING count(DISTINCT text) >= 10),
cand AS (SELECT * FROM t SEMI JOIN leaves USING (leaf)),
seen AS (SELECT leaf, line, any_value(tokens) AS tokens FROM cand GROUP BY leaf, line),
tok AS (SELECT leaf, line, unnest(tokens) AS token, unnest(range(len(tokens))) AS slot FROM seen),
every_tok AS (SELECT leaf, text, unnest(tokens) AS token, unnest(range(len(tokens))) AS slot FROM cand),
texts AS (SELECT leaf, slot, token, count(DISTINCT text) AS n FROM every_tok GROUP BY ALL),
sup AS (SELECT tok.*, n >= 10 AND token <> '<*>' AS fixed FROM tok JOIN texts USING (leaf, slot, token)),
tmpl AS (
    SELECT leaf, line, string_agg(CASE WHEN fixed THEN token ELSE '<*>' END, chr(31) ORDER BY slot) AS template
    FROM sup GROUP BY leaf, line HAVING avg(fixed::INTEGER) >= 0.6),
hits AS (SELECT text, pos, leaf, template FROM cand JOIN tmpl USING (leaf, line)),
rec AS (SELECT leaf, template FROM hits GROUP BY leaf, template HAVING count(DISTINCT text) >= 10),
same AS (
    SELECT line, len(string_split_regex(line, '[\x20\x09-\x0D]+')) AS n_tokens FROM l WHERE line <> ''
    GROUP BY line HAVING count(DISTINCT text) >= CASE WHEN n_tokens >= 3 THEN 2 ELSE 10 END),
every_hit AS (
    SELECT text, pos FROM hits SEMI JOIN rec USING (leaf, template)
    UNION SELECT text, pos FROM l SEMI JOIN same USING (line)),
drops AS (SELECT text, list(pos) AS gone FROM every_hit GROUP BY text)
SELECT doc_id, CASE WHEN gone IS NULL THEN d.text ELSE
           coalesce(array_to_string(list_filter(every, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text,
       coalesce(len(every), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped
FROM d LEFT JOIN drops ON d.text = drops.text
""")
def op6_line_dedup(spark, sf_dir):
    """Operator 6 over all documents: templates in 10 texts and more, unchanged lines in 2."""
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


@query("op6_line_dedup_same", sql=ORACLE["op6_line_dedup"])
def op6_line_dedup_same(spark, sf_dir):
    """The same under the name that it had while unchanged lines were an option."""
    return op6_line_dedup(spark, sf_dir)


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    """Operator 7 over all documents."""
    return best_fit(table(spark, sf_dir, "documents")).drop("rid")


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    """Operator 9 over all documents."""
    return identify(table(spark, sf_dir, "documents"))


@query("op13_fill_in_middle", sql="""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
    SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM k),
o AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
""")
def op13_fill_in_middle(spark, sf_dir):
    """Operator 13 over all documents: code points, seed 1, 90 % of the texts, a fifth of them suffix first."""
    out = fill_in_middle(table(spark, sf_dir, "documents"), seed=1, unit="char", fim_percent=90, spm_percent=20)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op11_source_divergence", sql=r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
l AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
ls AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS n FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN l USING (lang, term) GROUP BY ALL),
gs AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, l.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(gs.n, 0) + ls.v) AS p,
           1 + (1000000000::HUGEINT * (l.ln + 1)) // (ls.n + ls.v) AS q
    FROM g JOIN l USING (lang) JOIN ls USING (lang) LEFT JOIN gs USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
""")
def op11_source_divergence(spark, sf_dir):
    """Operator 11 over all documents: terms of 3 documents and more, 200 terms a group."""
    return audit(table(spark, sf_dir, "documents"), min_docs=3, top=200)


@query("op12_approximate_neighbours")
def op12_approximate_neighbours(spark, sf_dir):
    """Operator 12: twenty nearest found of every twentieth vector against all."""
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)
