"""Registered queries on card records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.catalogue import tables as t
from cardloom.operators import cards as ops
from cardloom.scale import ranked
from cardloom.session import checkpointed, shared_table
from cardloom.sources.cards import CardTable, load_cards, safe_chapter_file, safe_name, write_jsonl

_EMPTY = ("prerequisites", "error_notes")


def _part_cards(spark, folder) -> DataFrame:
    """Parts as extracted cards: type = chapter, name = topic, size decides the kind."""
    texts = F.array().cast("array<string>")
    return t.table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.lit("catalog").alias("course"),
        F.col("p_type").alias("chapter"),
        F.col("p_name").alias("topic"),
        t._pick(fixed.KINDS, F.col("p_size")).alias("kind"),
        F.split("p_name", " ").alias("keywords"),
        texts.alias("prerequisites"),
        F.when(F.col("p_brand") == "Brand#3", F.lit("教材编排建议"))
        .when(F.col("p_brand") == "Brand#7", F.lit("先学第3章"))
        .otherwise(F.col("p_brand"))
        .alias("applicability"),
        F.array(F.when(F.col("p_size") == 7, F.lit("建议先看附录")).otherwise(F.col("p_type"))).alias("steps"),
        F.lit("").alias("core_formula_latex"),
        F.lit("").alias("technique"),
        F.lit("").alias("worked_example"),
        texts.alias("error_notes"),
        F.lit("").alias("source_page"),
        F.lit("").alias("source_url"),
        (F.col("p_size") == 50).alias("reference_only"),
        F.col("p_partkey").alias("ord"),
    )


def _line_cards(spark, folder) -> DataFrame:
    """Order lines as a batch of card updates; many lines rewrite the same card."""
    one = _part_cards(spark, folder)
    lines = t.table(spark, folder, "lineitem").select(
        ((F.col("l_suppkey") * 37 + F.col("l_partkey")) % 3001).cast("string").alias("id"),
        F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string")).alias("topic"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
    )
    fill = {"course": F.lit("catalog"), "chapter": F.lit("lines"), "kind": F.lit(fixed.METHOD), "reference_only": F.lit(False)}
    kinds = dict(one.dtypes)
    return lines.select(
        *[
            F.col(c)
            if c in lines.columns
            else fill.get(c, F.array().cast("array<string>") if kinds[c].startswith("array") else F.lit("")).alias(c)
            for c in one.columns
        ]
    )


def dedup_renumber(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup_and_number(_part_cards(spark, folder)).select(
        "id", "course", "chapter", "topic", "kind", F.col("ord").alias("p_partkey")
    )


def upsert_cards(spark: SparkSession, folder: str) -> DataFrame:
    merged = ops.upsert(_part_cards(spark, folder), _line_cards(spark, folder))
    return merged.select("id", "chapter", "topic", "kind", "ord", "is_new")


def upsert_new_count(spark: SparkSession, folder: str) -> DataFrame:
    return ops.new_counts(_part_cards(spark, folder), _line_cards(spark, folder))


def reference_noise(spark: SparkSession, folder: str) -> DataFrame:
    return ops.flag_reference(_part_cards(spark, folder)).select("id", "reference_only")


def noise_preview(spark: SparkSession, folder: str) -> DataFrame:
    return ops.flag_preview(_part_cards(spark, folder)).select("id", ops.summary_line().alias("summary"))


def kind_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = _part_cards(spark, folder).filter(
        F.col("kind").isin(fixed.METHOD, fixed.EXAMPLE) & ~F.col("reference_only")
    )
    return kept.groupBy("chapter", "kind").agg(F.count("*").alias("n_cards"))


def validate_json(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw model items: some cut off, some without topic, some of an unknown kind, some with a null list item."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.element_at(F.array(*map(F.lit, (*fixed.KINDS, "其他"))), (k % 6 + 1).cast("int"))
    full = F.concat(
        F.lit('{"id":"e'),
        F.col("event_id").cast("string"),
        F.lit('",'),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"topic":"'), F.col("event_type"), F.lit('",'))),
        F.when(k % 5 == 0, F.concat(F.lit('"chapter":"own'), k.cast("string"), F.lit('",'))).otherwise(F.lit("")),
        F.when(k % 13 == 0, F.lit('"steps":["a",null],')).otherwise(F.lit('"steps":["a"],')),
        F.lit('"kind":"'),
        kind,
        F.lit('"}'),
    )
    raw = t.table(spark, folder, "events").select(
        "event_id", "user_id", F.when(k % 11 == 0, F.substring(full, 1, 30)).otherwise(full).alias("raw_json")
    )
    parsed = ops.parse_cards(raw, course=F.lit("log"), chapter=F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return parsed.select(
        "event_id",
        "error",
        F.when(F.col("error").isNull(), F.col("card.topic")).alias("topic"),
        F.when(F.col("error").isNull(), F.col("card.chapter")).alias("chapter"),
        F.when(F.col("error").isNull(), F.col("card.kind")).alias("kind"),
        F.when(F.col("error").isNull(), F.size("card.keywords").cast("bigint")).alias("n_keywords"),
    )


def course_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = t.table(spark, folder, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("course")).distinct()
    listed = names.unionByName(t.cards(spark, folder).select("course").distinct()).distinct()
    return ops.course_counts(t.cards(spark, folder), listed)


def course_list(spark: SparkSession, folder: str) -> DataFrame:
    return t.cards(spark, folder).select("course").distinct().orderBy("course")


def card_lookup(spark: SparkSession, folder: str) -> DataFrame:
    wanted = t.table(spark, folder, "labels").select(
        F.lit("catalog").alias("course"), F.col("doc_id").cast("string").alias("id")
    )
    return ops.find_cards(_part_cards(spark, folder), wanted).select("id", "topic", "kind")


def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "pages").select(
        "page_id", safe_name(F.col("url")).alias("file_name"), safe_chapter_file(F.col("url")).alias("chapter_file")
    )


def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Cards of all courses written as JSON lines, one folder per course, and read back in their order."""
    path = shared_table(spark, "jsonl")
    write_jsonl(t.cards(spark, folder), path)
    # read and parsed once, and without the texts: ranking looks at its rows twice
    back = checkpointed(load_cards(spark, path).select("course", "id", "kind", F.size("steps").cast("bigint").alias("n_steps"), "ord"))
    rows = ranked(back, "ord", "place")
    place = rows.groupBy("course").agg(F.min("place").alias("first"))
    return rows.join(place, "course").select("course", "id", "kind", "n_steps", (F.col("place") - F.col("first")).alias("place"))


def upsert_twice(spark: SparkSession, folder: str) -> DataFrame:
    """A stored card table of three courses after a first batch and a second one that is saved twice."""
    store = CardTable(spark, shared_table(spark, "cards"))
    parts, lines = (
        frame.withColumns(
            {
                "course": F.concat(F.lit("c"), (F.col("id").cast("bigint") % 3).cast("string")),
                "ord": F.col("ord") * 10_000 + F.col("id").cast("bigint"),  # no ties
            }
        )
        for frame in (_part_cards(spark, folder), _line_cards(spark, folder))
    )
    store.save(parts)
    store.save(lines)
    store.save(lines)
    stored = store.read()
    order = F.row_number().over(Window.partitionBy("course", "chapter").orderBy("ord"))  # a look at the order, per chapter
    return stored.select("course", "id", "chapter", "topic", "kind", order.cast("bigint").alias("place"))


_PART = """
pc AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS chapter, p_name AS topic,
    ['概念','定理','方法','例题','易错点'][p_size % 5 + 1] AS kind, p_partkey AS ord, p_size, p_brand, p_size = 50 AS ref,
    p_name || ' ' || CASE p_brand WHEN 'Brand#3' THEN '教材编排建议' WHEN 'Brand#7' THEN '先学第3章' ELSE p_brand END
      || '  ' || CASE WHEN p_size = 7 THEN '建议先看附录' ELSE p_type END AS txt
  FROM part
)"""
_NOISE = "regexp_matches(txt, '编排|建议(先|按|顺便|跳过)|先.{0,4}第?\\d+章')"
_LINE = """
lc AS (
  SELECT CAST((l_suppkey * 37 + l_partkey) % 3001 AS VARCHAR) AS id,
    l_returnflag || '-' || l_linestatus || '-' || l_orderkey AS topic, l_orderkey * 8 + l_linenumber AS ord FROM lineitem
),
nw AS (SELECT id, arg_max(topic, ord) AS topic, min(ord) AS ord FROM lc GROUP BY id)"""

ORACLE = {
    "dedup_renumber": "WITH"
    + _PART
    + """
SELECT 'catalog|' || chapter || '|' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id,
  'catalog' AS course, chapter, topic, kind, ord AS p_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY ord) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY chapter, topic, kind ORDER BY ord) AS r FROM pc) WHERE r = 1)""",
    "upsert_cards": "WITH"
    + _PART
    + ","
    + _LINE
    + """
SELECT coalesce(pc.id, nw.id) AS id, CASE WHEN nw.id IS NOT NULL THEN 'lines' ELSE pc.chapter END AS chapter,
  coalesce(nw.topic, pc.topic) AS topic, CASE WHEN nw.id IS NOT NULL THEN '方法' ELSE pc.kind END AS kind,
  CAST(coalesce(pc.ord, nw.ord + (SELECT max(ord) + 1 FROM pc)) AS BIGINT) AS ord, pc.id IS NULL AS is_new
FROM pc FULL OUTER JOIN nw ON pc.id = nw.id""",
    "jsonl_roundtrip": """
SELECT lang AS course, CAST(doc_id AS VARCHAR) AS id, ['概念','定理','方法','例题','易错点'][(doc_id % 5 + 1)::INT] AS kind,
  greatest(len(string_split(text, chr(10))) - 2, 0) AS n_steps, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents""",
    "upsert_twice": "WITH"
    + _PART
    + ","
    + _LINE
    + """,
mg AS (SELECT coalesce(pc.id, nw.id) AS id, CASE WHEN nw.id IS NOT NULL THEN 'lines' ELSE pc.chapter END AS chapter,
  coalesce(nw.topic, pc.topic) AS topic, CASE WHEN nw.id IS NOT NULL THEN '方法' ELSE pc.kind END AS kind, pc.ord AS o, nw.ord AS n
FROM pc FULL OUTER JOIN nw ON pc.id = nw.id)
SELECT 'c' || CAST(id AS BIGINT) % 3 AS course, id, chapter, topic, kind,
  row_number() OVER (PARTITION BY CAST(id AS BIGINT) % 3, chapter ORDER BY o NULLS LAST, n, CAST(id AS BIGINT)) AS place FROM mg""",
    "upsert_new_count": "WITH"
    + _PART
    + ","
    + _LINE
    + """
SELECT 'catalog' AS course, count(*) AS n_new FROM nw WHERE id NOT IN (SELECT id FROM pc) HAVING count(*) > 0""",
    "reference_noise": "WITH" + _PART + f" SELECT id, ref OR {_NOISE} AS reference_only FROM pc",
    "noise_preview": "WITH"
    + _PART
    + f" SELECT id, '[' || kind || '] ' || topic || '（' || chapter || '）' AS summary FROM pc WHERE NOT ref AND {_NOISE}",
    "kind_filter": "WITH"
    + _PART
    + " SELECT chapter, kind, count(*) AS n_cards FROM pc WHERE kind IN ('方法', '例题') AND NOT ref GROUP BY ALL",
    "validate_json": """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
j AS (SELECT *, ['概念','定理','方法','例题','易错点','其他'][(k % 6 + 1)::INT] AS kd,
  CASE WHEN k % 11 = 0 THEN 'malformed' WHEN k % 7 = 0 THEN 'missing topic' WHEN k % 6 = 5 THEN 'unknown kind'
       WHEN k % 13 = 0 THEN 'bad steps' END AS error FROM e)
SELECT event_id, error, CASE WHEN error IS NULL THEN event_type END AS topic,
  CASE WHEN error IS NULL THEN CASE WHEN k % 5 = 0 THEN 'own' || k ELSE 'u' || user_id END END AS chapter,
  CASE WHEN error IS NULL THEN kd END AS kind, CASE WHEN error IS NULL THEN 0::BIGINT END AS n_keywords FROM j""",
    "course_counts": """
WITH names AS (SELECT lower(substr(n_name, 1, 2)) AS course FROM nation UNION SELECT lang FROM documents),
c AS (SELECT lang AS course, count(*) AS n FROM documents GROUP BY lang)
SELECT names.course, coalesce(n, 0) AS n_cards FROM names LEFT JOIN c USING (course)""",
    "course_list": "SELECT DISTINCT lang AS course FROM documents",
    "card_lookup": "WITH" + _PART + " SELECT id, topic, kind FROM pc WHERE ord IN (SELECT doc_id FROM labels)",
    "safe_names": """
SELECT page_id, regexp_replace(trim(regexp_replace(url, '[^\\w.\\- ]', '_', 'g')), '\\.+$', '') AS file_name,
  substr(regexp_replace(url, '[\\\\/:*?"<>|]', '_', 'g'), 1, 60) AS chapter_file FROM pages""",
}

QUERIES = {
    f.__name__: f
    for f in (
        dedup_renumber,
        upsert_cards,
        upsert_new_count,
        jsonl_roundtrip,
        upsert_twice,
        reference_noise,
        noise_preview,
        kind_filter,
        validate_json,
        course_counts,
        course_list,
        card_lookup,
        safe_names,
    )
}
