"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.catalogue import tables as t
from cardloom.functions import text as tx
from cardloom.functions import vectors as vec
from cardloom.operators import indexed
from cardloom.operators import retrieval as r
from cardloom import fixed_values as fixed
from cardloom.scale import spread
from cardloom.session import shared_table
from cardloom.sources.coarse import MAX_LISTS, CoarseIndex
from cardloom.sources.postings import PostingTable
from cardloom.sources.vectors import VectorTable


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = tx.tokens(F.col("text"))
    return spread(t.table(spark, folder, "documents")).select(
        "doc_id",
        F.size(found).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(found)).cast("bigint").alias("n_distinct"),
    )


def hashed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.table(spark, folder, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("tokens"))
    return vec.sparse_vectors(rows, "item_id", "tokens")


def vector_topk_text(spark: SparkSession, folder: str) -> DataFrame:
    hits = r.vector_topk(t.questions(spark, folder), t.cards(spark, folder), 5)
    return hits.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "card_id", tx.exact_round(F.col("score"), 4).alias("score")
    )


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = r.lexical_topk(t.questions(spark, folder), t.cards(spark, folder), 5)
    return hits.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "card_id", tx.exact_round(F.col("score"), 4).alias("score")
    )


def lexical_topk_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same hits through the stored posting lists."""
    table = PostingTable(spark, shared_table(spark, "postings"))
    table.rebuild(t.cards(spark, folder))
    hits = indexed.lexical_topk_indexed(t.questions(spark, folder), table, 5)
    return hits.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "card_id", tx.exact_round(F.col("score"), 4).alias("score")
    )


def vector_topk_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Vector search over all lists of an index that was first filled with other texts and then brought up to date."""
    cards = t.cards(spark, folder)
    index = CoarseIndex(spark, shared_table(spark, "coarse"))
    index.rebuild(cards.filter("ord % 3 > 0").withColumn("technique", F.lit("old")))
    index.upsert(cards.filter("ord % 2 = 0"))
    index.upsert(cards.filter("ord % 2 = 1"))
    hits = indexed.vector_topk_indexed(t.questions(spark, folder), index, 5, MAX_LISTS)
    return hits.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "card_id", tx.exact_round(F.col("score"), 4).alias("score")
    )


def _hybrid(spark, folder, k, columns=("topic", "kind", "chapter")):
    questions, cards = t.questions(spark, folder), t.cards(spark, folder)
    small = r.questions_fit(questions)
    return r.attach_cards(r.hybrid_topk(questions, cards, k, small=small), cards, list(columns), small, k)


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, 5).select(
        "qid",
        "course",
        F.col("rank").cast("bigint").alias("rank"),
        "card_id",
        "score",
        tx.exact_round(F.col("lexical"), 4).alias("lexical"),
        tx.exact_round(F.col("vector"), 4).alias("vector"),
        "kind",
        "chapter",
        F.md5(F.col("topic").cast("binary")).alias("topic_md5"),
    )


def rerank_bias(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hybrid(spark, folder, 5, ("kind",))
    bias = F.element_at(F.array(F.lit("均衡"), F.lit("概念"), F.lit("方法")), (F.col("qid") % 3 + 1).cast("int"))
    return r.rerank_by_bias(hits, bias).select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "card_id", "kind", "score"
    )


def kind_after_rank(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hybrid(spark, folder, 10, ("kind",))
    return r.kind_after_rank(hits, fixed.METHOD, 5).select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "card_id", "score"
    )


def hard_gate(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hybrid(spark, folder, 5, ("kind",))
    return hits.groupBy("qid").agg(
        F.max("score").alias("top_score"), (F.max("score") >= fixed.RELEVANCE_GATE).alias("relevant")
    )


def memory_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical-only retrieval with k = 2, as used on a student's own memory cards."""
    hits = r.hybrid_topk(t.questions(spark, folder), t.cards(spark, folder), 2, use_vector=False)
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), "card_id", "score")


def vector_topk_dense(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.table(spark, folder, "embeddings")
    centre = (
        rows.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg((F.sum(F.round(F.col("x").cast("double") * 1e6).cast("bigint")) / F.count("*") / 1e6).alias("x"))
    )
    queries = centre.groupBy(F.col("label").cast("bigint").alias("qid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector")
    )
    offered = rows.select(F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vector"))
    return r.dense_topk(queries, offered, 10).select(
        "qid", F.col("rank").cast("bigint").alias("rank"), F.col("ord").alias("vec_id"), tx.exact_round(F.col("score"), 4).alias("score")
    )


def vector_table(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuild of the vector collection: one row per card with its 256 signed counts."""
    rows = r.vector_rows(t.cards(spark, folder))
    return rows.select(
        r.collection_name(F.col("course")).alias("collection"),
        "id",
        "kind",
        "chapter",
        F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, w: a + F.abs(w)).alias("weight_abs"),
        F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, w: a + w.cast("bigint") * w).alias("norm_sq"),
    )


def _vector_store(spark: SparkSession, folder: str) -> VectorTable:
    """A stored table that was first filled with other texts and then brought up to date card by card."""
    cards = t.cards(spark, folder)
    store = VectorTable(spark, shared_table(spark, "vectors"))
    store.rebuild(cards.filter("ord % 3 > 0").withColumn("technique", F.lit("old")))
    store.upsert(cards.filter("ord % 2 = 0"))
    store.upsert(cards.filter("ord % 2 = 1"))
    return store


def vector_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_store(spark, folder).read().select(
        r.collection_name(F.col("course")).alias("collection"),
        F.col("card_id").alias("id"),
        "kind",
        "chapter",
        F.aggregate("document_counts", F.lit(0).cast("bigint"), lambda a, w: a + F.abs(w)).alias("weight_abs"),
        F.aggregate("document_counts", F.lit(0).cast("bigint"), lambda a, w: a + w.cast("bigint") * w).alias("norm_sq"),
    )


def hybrid_topk_stored(spark: SparkSession, folder: str) -> DataFrame:
    questions, rows = t.questions(spark, folder), _vector_store(spark, folder).read()
    small = r.questions_fit(questions)
    hits = r.hybrid_topk(questions, rows, 5, small=small)
    named = r.attach_cards(hits, rows.withColumnRenamed("card_id", "id"), ["topic", "kind", "chapter"], small, 5)
    return named.select(
        "qid",
        "course",
        F.col("rank").cast("bigint").alias("rank"),
        "card_id",
        "score",
        tx.exact_round(F.col("lexical"), 4).alias("lexical"),
        tx.exact_round(F.col("vector"), 4).alias("vector"),
        "kind",
        "chapter",
        F.md5(F.col("topic").cast("binary")).alias("topic_md5"),
    )


CARD_SQL = """
card AS (
  SELECT d.doc_id AS ord, CAST(d.doc_id AS VARCHAR) AS card_id, d.lang AS course, d.source AS chapter,
         string_split(d.text, chr(10)) AS ls,
         ['概念','定理','方法','例题','易错点'][(d.doc_id % 5 + 1)::INT] AS kind,
         l.doc_id IS NOT NULL AS reference_only
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id
),
asked AS (
  SELECT item_id AS qid, ['en','fr','de','es'][(item_id % 4 + 1)::INT] AS course, text AS question FROM benchmark
)
"""

SCORE_SQL = (
    CARD_SQL
    + """,
lex_tok AS (
  SELECT ord, unnest(regexp_extract_all(lower(
    CASE WHEN len(ls) > 1 THEN array_to_string(ls[1:len(ls)-1], ' ') ELSE ls[1] END), '[a-z0-9]+')) AS tok FROM card
),
kw AS (
  SELECT ord, list_distinct(regexp_extract_all(ls[1], '[A-Za-z]{4,}')) AS words FROM card
),
kw_tok AS (SELECT ord, lower(unnest(words)) AS tok FROM kw),
tail_tok AS (
  SELECT ord, unnest(regexp_extract_all(lower(CASE WHEN len(ls) > 1 THEN ls[len(ls)] ELSE '' END), '[a-z0-9]+')) AS tok FROM card
),
q_tok AS (SELECT qid, course, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS tok FROM asked),
lex_all AS (SELECT * FROM lex_tok UNION ALL SELECT * FROM kw_tok),
doc_all AS (SELECT * FROM lex_all UNION ALL SELECT * FROM tail_tok),
code AS (
  SELECT tok, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) AS h
  FROM (SELECT tok FROM doc_all UNION SELECT tok FROM q_tok)
),
signed AS (SELECT tok, h % 256 AS bucket, CASE WHEN (h >> 8) & 1 = 1 THEN 1 ELSE -1 END AS s FROM code),
lex_vec AS (SELECT ord, bucket, CAST(sum(s) AS BIGINT) AS w FROM lex_all JOIN signed USING (tok) GROUP BY ord, bucket),
doc_vec AS (SELECT ord, bucket, CAST(sum(s) AS BIGINT) AS w FROM doc_all JOIN signed USING (tok) GROUP BY ord, bucket),
q_vec AS (SELECT qid, bucket, CAST(sum(s) AS BIGINT) AS w FROM q_tok JOIN signed USING (tok) GROUP BY qid, bucket),
lex_n AS (SELECT ord, CAST(sum(w * w) AS DOUBLE) AS n FROM lex_vec GROUP BY ord),
doc_n AS (SELECT ord, CAST(sum(w * w) AS DOUBLE) AS n FROM doc_vec GROUP BY ord),
q_n AS (SELECT qid, CAST(sum(w * w) AS DOUBLE) AS n FROM q_vec GROUP BY qid),
lex_dot AS (
  SELECT q.qid, v.ord, CAST(sum(q.w * v.w) AS DOUBLE) AS d FROM q_vec q JOIN asked a ON a.qid = q.qid
  JOIN lex_vec v ON v.bucket = q.bucket JOIN card c ON c.ord = v.ord AND c.course = a.course GROUP BY q.qid, v.ord
),
doc_dot AS (
  SELECT q.qid, v.ord, CAST(sum(q.w * v.w) AS DOUBLE) AS d FROM q_vec q JOIN asked a ON a.qid = q.qid
  JOIN doc_vec v ON v.bucket = q.bucket JOIN card c ON c.ord = v.ord AND c.course = a.course GROUP BY q.qid, v.ord
),
q_set AS (SELECT DISTINCT qid, tok FROM q_tok),
q_size AS (SELECT qid, count(*) AS n FROM q_set GROUP BY qid),
kw_hit AS (
  SELECT q.qid, k.ord, count(*) AS hits FROM q_set q JOIN (SELECT DISTINCT ord, tok FROM kw_tok) k USING (tok) GROUP BY q.qid, k.ord
),
pair AS (
  SELECT a.qid, a.course, c.ord, c.card_id, c.chapter, c.kind, c.reference_only, c.ls[1] AS topic,
         CASE WHEN qs.n IS NULL THEN 0 ELSE
         0.6::DOUBLE * (coalesce(h.hits, 0)::DOUBLE / qs.n::DOUBLE)
         + 0.35::DOUBLE * (coalesce(ld.d, 0) / (sqrt(coalesce(ln.n, 1)) * sqrt(coalesce(qn.n, 1))))
         + CASE WHEN c.kind IN ('方法', '例题') THEN 0.15::DOUBLE ELSE 0::DOUBLE END END AS lex,
         coalesce(dd.d, 0) / (sqrt(coalesce(dn.n, 1)) * sqrt(coalesce(qn.n, 1))) AS cosine
  FROM asked a JOIN card c ON a.course = c.course
  LEFT JOIN q_size qs ON qs.qid = a.qid
  LEFT JOIN kw_hit h ON h.qid = a.qid AND h.ord = c.ord
  LEFT JOIN lex_dot ld ON ld.qid = a.qid AND ld.ord = c.ord
  LEFT JOIN doc_dot dd ON dd.qid = a.qid AND dd.ord = c.ord
  LEFT JOIN (SELECT * FROM lex_n WHERE n > 0) ln ON ln.ord = c.ord
  LEFT JOIN (SELECT * FROM doc_n WHERE n > 0) dn ON dn.ord = c.ord
  LEFT JOIN (SELECT * FROM q_n WHERE n > 0) qn ON qn.qid = a.qid
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, ord) AS vrank,
         CASE WHEN lex > 0 AND NOT reference_only THEN lex END AS lexical
  FROM pair
)"""
)


def fused_sql(k: int, n: int) -> str:
    return (
        SCORE_SQL
        + f""",
fused AS (
  SELECT *, CASE WHEN vrank <= {n} THEN greatest(0.0::DOUBLE, cosine) END AS vector,
         coalesce(lexical, 0) + coalesce(CASE WHEN vrank <= {n} THEN greatest(0.0::DOUBLE, cosine) END, 0) AS raw
  FROM ranked WHERE NOT reference_only AND (lexical IS NOT NULL OR vrank <= {n})
),
hit AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, lexical IS NULL,
           CASE WHEN lexical IS NULL THEN vrank ELSE ord END) AS rank FROM fused) WHERE rank <= {k}
)"""
    )


ORACLE = {
    "token_counts": """
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)""",
    "hashed_vectors": """
WITH tok AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
code AS (SELECT item_id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) AS h FROM tok)
SELECT item_id, h % 256 AS bucket, CAST(sum(CASE WHEN (h >> 8) & 1 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS weight
FROM code GROUP BY item_id, h % 256 HAVING sum(CASE WHEN (h >> 8) & 1 = 1 THEN 1 ELSE -1 END) <> 0""",
    "vector_topk_text": "WITH"
    + SCORE_SQL
    + """
SELECT qid, vrank AS rank, card_id, CAST(printf('%.4f', greatest(0.0::DOUBLE, cosine)) AS DOUBLE) AS score FROM ranked WHERE vrank <= 5""",
    "lexical_topk": "WITH"
    + SCORE_SQL
    + """
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, ord) AS rank, card_id,
CAST(printf('%.4f', lexical) AS DOUBLE) AS score FROM ranked WHERE lexical IS NOT NULL) WHERE rank <= 5""",
    "hybrid_topk": "WITH"
    + fused_sql(5, 15)
    + """
SELECT qid, course, rank, card_id, CAST(printf('%.4f', raw) AS DOUBLE) AS score, CAST(printf('%.4f', lexical) AS DOUBLE) AS lexical,
CAST(printf('%.4f', vector) AS DOUBLE) AS vector, kind, chapter, md5(topic) AS topic_md5 FROM hit""",
    "rerank_bias": "WITH"
    + fused_sql(5, 15)
    + """
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY key DESC, rank) AS rank, card_id, kind, score FROM (
  SELECT qid, rank, card_id, kind, CAST(printf('%.4f', raw) AS DOUBLE) AS score,
    CASE WHEN qid % 3 = 0 THEN 0
         WHEN qid % 3 = 1 AND kind IN ('概念', '定理') THEN CAST(printf('%.4f', raw) AS DOUBLE) + 0.25::DOUBLE
         WHEN qid % 3 = 2 AND kind IN ('方法', '例题') THEN CAST(printf('%.4f', raw) AS DOUBLE) + 0.25::DOUBLE
         ELSE CAST(printf('%.4f', raw) AS DOUBLE) END AS key FROM hit)""",
    "kind_after_rank": "WITH"
    + fused_sql(10, 30)
    + """
SELECT qid, new_rank AS rank, card_id, score FROM (
  SELECT qid, card_id, CAST(printf('%.4f', raw) AS DOUBLE) AS score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS new_rank
  FROM hit WHERE kind = '方法') WHERE new_rank <= 5""",
    "hard_gate": "WITH"
    + fused_sql(5, 15)
    + """
SELECT qid, max(CAST(printf('%.4f', raw) AS DOUBLE)) AS top_score, max(CAST(printf('%.4f', raw) AS DOUBLE)) >= 0.40::DOUBLE AS relevant FROM hit GROUP BY qid""",
    "memory_topk": "WITH"
    + SCORE_SQL
    + """
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, ord) AS rank, card_id,
CAST(printf('%.4f', lexical) AS DOUBLE) AS score FROM ranked WHERE lexical IS NOT NULL) WHERE rank <= 2""",
    "vector_topk_dense": """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT label, i, CAST(sum(CAST(round(v * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS c FROM x GROUP BY label, i),
cn AS (SELECT label, sqrt(sum(c * c)) AS n FROM centre GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY vec_id),
dot AS (SELECT c.label, x.vec_id, sum(c.c * x.v) AS d FROM centre c JOIN x ON c.i = x.i GROUP BY c.label, x.vec_id),
s AS (SELECT dot.label, dot.vec_id, d / (cn.n * vn.n) AS cosine FROM dot JOIN cn ON cn.label = dot.label JOIN vn ON vn.vec_id = dot.vec_id)
SELECT CAST(label AS BIGINT) AS qid, rank, vec_id, CAST(printf('%.4f', greatest(0.0::DOUBLE, cosine)) AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "vector_table": "WITH"
    + SCORE_SQL
    + """
SELECT 'cb-' || c.course || '-' || substr(md5(c.course), 1, 8) AS collection, c.card_id AS id, c.kind, c.chapter,
CAST(coalesce(sum(abs(v.w)), 0) AS BIGINT) AS weight_abs, CAST(coalesce(sum(v.w * v.w), 0) AS BIGINT) AS norm_sq
FROM card c LEFT JOIN doc_vec v ON v.ord = c.ord GROUP BY ALL""",
}

QUERIES = {
    f.__name__: f
    for f in (
        token_counts,
        hashed_vectors,
        vector_topk_text,
        vector_topk_lists,
        vector_topk_dense,
        lexical_topk,
        lexical_topk_indexed,
        hybrid_topk,
        rerank_bias,
        kind_after_rank,
        hard_gate,
        memory_topk,
        vector_table,
        vector_upsert,
        hybrid_topk_stored,
    )
}
ORACLE["vector_upsert"] = ORACLE["vector_table"]
ORACLE["hybrid_topk_stored"] = ORACLE["hybrid_topk"]
ORACLE["lexical_topk_indexed"] = ORACLE["lexical_topk"]
ORACLE["vector_topk_lists"] = ORACLE["vector_topk_text"]
