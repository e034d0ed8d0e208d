"""Registered queries of the training-data operators and their SQL twins.

The queries are thin: they read a whole table, call one operator and select
the columns of its result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import audit, chat, html, language, lattice, mixing, packing, quality, resampling, simhash, topk, toxicity, vectors
from cardloom.llm.common import WORD, table
from cardloom.session import ship_package


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    pairs = chat.preference_pairs(chat.from_conversations(table(spark, folder, "conversations")))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        "prompt",
        "chosen",
        "rejected",
        as_text("chosen_spans").alias("chosen_spans"),
        as_text("rejected_spans").alias("rejected_spans"),
    )


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    queue = mixing.fair_queue(table(spark, folder, "documents"), keep=["doc_id"])
    return queue.select("doc.doc_id", "size", "source_size", "target", "taken")


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op6_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.score(table(spark, folder, "documents"))


_OP2 = """
WITH lasts AS (
  SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), said AS (
  SELECT c.conv_id, c.turn, coalesce(c.role, '') AS role, coalesce(c.text, '') AS c_text,
         CASE WHEN c.role = 'assistant' AND c.turn = l.last
              THEN coalesce(array_to_string(list_reverse(string_split(c.text, ' ')), ' '), '') ELSE coalesce(c.text, '') END AS r_text
  FROM conversations c JOIN lasts l USING (conv_id) WHERE c.turn <= l.last
), sides AS (
  SELECT conv_id, list({'role': role, 'text': c_text} ORDER BY turn, role, c_text) AS c,
         list({'role': role, 'text': r_text} ORDER BY turn, role, r_text) AS r
  FROM said GROUP BY conv_id
), cut AS (
  SELECT conv_id, c, r, list_max(list_filter(range(0, len(c) + 1), lambda i: c[1:i] = r[1:i])) AS same FROM sides
), parts AS (
  SELECT conv_id, c[1:same] AS p, c[same + 1:len(c)] AS c, r[same + 1:len(r)] AS r FROM cut
), spans AS (
  SELECT conv_id, side, string_agg(CASE WHEN role = 'assistant' THEN (before + head) || '-' || (before + head + body) END, ',' ORDER BY i) AS spans
  FROM (
    SELECT *, coalesce(sum(head + body) OVER (PARTITION BY conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (
      SELECT conv_id, side, i, turns[i].role AS role, 13 + len(turns[i].role) AS head, len(turns[i].text) + 11 AS body
      FROM (SELECT *, unnest(range(1, len(turns) + 1)) AS i
            FROM (SELECT conv_id, 'c' AS side, c AS turns FROM parts UNION ALL SELECT conv_id, 'r', r FROM parts))
    )
  ) GROUP BY conv_id, side
)
SELECT conv_id,
       coalesce(array_to_string(list_transform(p, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS prompt,
       coalesce(array_to_string(list_transform(c, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS chosen,
       coalesce(array_to_string(list_transform(r, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS rejected,
       coalesce((SELECT s.spans FROM spans s WHERE s.conv_id = parts.conv_id AND s.side = 'c'), '') AS chosen_spans,
       coalesce((SELECT s.spans FROM spans s WHERE s.conv_id = parts.conv_id AND s.side = 'r'), '') AS rejected_spans
FROM parts
"""

_OP4 = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS turn,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sums
), levels AS (
  SELECT 0 AS i, 0.0::DOUBLE AS level
  UNION ALL
  SELECT l.i + 1,
         (sum(w.source_size) - sum(CASE WHEN l.level * w.weight > 3 * w.source_size THEN 3 * w.source_size ELSE 0 END))::DOUBLE
         / nullif(sum(CASE WHEN l.level * w.weight > 3 * w.source_size THEN 0.0 ELSE w.weight END)::DOUBLE, 0)
  FROM levels l, weighted w WHERE l.i < 30 GROUP BY l.i, l.level
), target AS (
  SELECT w.source, w.source_size,
         CASE WHEN l.level * w.weight > 3 * w.source_size THEN (3 * w.source_size)::DOUBLE ELSE l.level * w.weight END AS target
  FROM weighted w, levels l WHERE l.i = 30
), queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - source_size - start))
          + greatest(0, least(size, floor(target) - 2 * source_size - start)) AS BIGINT) AS taken
FROM queued
"""


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


QUERIES = {
    name: _shipped(query)
    for name, query in {
        "op1_language": op1_language,
        "op2_chat": op2_chat,
        "op3_simhash": op3_simhash,
        "op4_mixing": op4_mixing,
        "op5_html": op5_html,
        "op6_vectors": op6_vectors,
        "op7_topk": op7_topk,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_packing": op10_packing,
        "op11_resampling": op11_resampling,
        "op12_audit": op12_audit,
        "op13_lattice": op13_lattice,
    }.items()
}

_OP7 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), terms AS (
  SELECT vec_id, unnest(v) AS w, unnest(range(len(v))) AS i FROM usable
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.w * d.w) AS BIGINT) AS score
  FROM terms q JOIN terms d ON q.i = d.i AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, d.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_OP11 = r"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8
), words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), asked AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), spelled AS (
  SELECT w, hex(w) AS h FROM (SELECT w FROM words UNION SELECT w FROM asked)
), coded AS (
  SELECT w, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM spelled CROSS JOIN crc_table
), raw AS (
  SELECT bucket, count(*) AS s FROM words JOIN coded USING (w) GROUP BY bucket
), aimed AS (
  SELECT bucket, count(*) AS t FROM asked JOIN coded USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE
         / ((s + 1)::DOUBLE * ((SELECT count(*) FROM asked) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM raw LEFT JOIN aimed USING (bucket)
), weights AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
  FROM words JOIN coded USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

_OP12 = f"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), failing AS (
  SELECT d.part, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS f,
         coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS bad
  FROM worded d LEFT JOIN labels l ON d.doc_id = l.doc_id
), counted AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM failing GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), marked AS (
  SELECT part, o, s.s AS step, f = o[s.s] AS alone, contains(f, o[s.s]) AS failed,
         len(list_filter(range(1, s.s), lambda i: contains(f, o[i]))) > 0 AS gone, n, n_good, n_bad
  FROM counted, orders, (SELECT unnest(range(1, 6)) AS s) s
), summed AS (
  SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
         CAST(sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN failed AND NOT gone THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN failed AND NOT gone THEN n_bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM marked GROUP BY part, o, step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM summed
"""

ORACLE = {"op2_chat": _OP2, "op4_mixing": _OP4, "op7_topk": _OP7, "op11_resampling": _OP11, "op12_audit": _OP12}
