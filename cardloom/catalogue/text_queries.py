"""Registered queries on text cleaning, chapters, chunks and slices, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.catalogue import tables as t
from cardloom.operators import chapters as ch
from cardloom.operators import denoise as dn
from cardloom.scale import spread
from cardloom.sources import documents as src


def _documents(spark, folder, *columns):
    return spread(t.table(spark, folder, "documents").select(*columns))


def denoise_stats(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = dn.denoise(_documents(spark, folder, "doc_id", "text"))
    return cleaned.select(
        "doc_id",
        "removed_lines",
        "story_removed",
        "chrome_removed",
        "kept_chars",
        "removed_chars",
        F.bround("removed_ratio", 6).alias("removed_ratio"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def denoise_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return dn.line_totals(_documents(spark, folder, "text"))


def min_size_chapters(spark: SparkSession, folder: str) -> DataFrame:
    kept = dn.large_enough(dn.denoise(_documents(spark, folder, "doc_id", "source", "text")))
    return kept.groupBy("source").agg(
        F.count("*").alias("n_chapters"), F.sum(F.length("text")).cast("bigint").alias("n_chars")
    )


def chapter_filter(spark: SparkSession, folder: str) -> DataFrame:
    named = _documents(spark, folder, "doc_id", F.col("source").alias("chapter"))
    return ch.filter_chapters(named, "rc1")


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    cut = ch.chunks(_documents(spark, folder, "doc_id", "text"), size=2000, overlap=600)
    return cut.select(
        "doc_id",
        "chunk_no",
        F.length("chunk").cast("bigint").alias("n_chars"),
        F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"),
    )


def page_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose line breaks become page markers, split back into pages."""
    marked = _documents(spark, folder, "doc_id", "text").withColumn(
        "text",
        F.array_join(
            F.transform(
                F.split("text", "\n"), lambda line, i: F.concat(F.lit("<!-- page "), (i + 5).cast("string"), F.lit(" -->"), line)
            ),
            "\n",
        ),
    )
    pages = ch.split_pages(marked, ["doc_id"])
    return pages.select(
        "doc_id",
        "page_ord",
        F.col("page_no").cast("bigint").alias("page_no"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def _book_pages(spark, folder):
    """Each source is a book, its documents are pages; every seventh page opens a chapter,
    every eleventh starts with a table-of-contents line."""
    number = F.col("doc_id")
    head = (
        F.when(number % 77 == 0, F.lit("CHAPTER 3 \n"))
        .when(number % 11 == 0, F.concat(F.lit("# Chapter 2 Overview "), (number % 90).cast("string"), F.lit("\n")))
        .when(number % 7 == 0, F.concat(F.lit("## 第"), (number % 9 + 1).cast("string"), F.lit("章 Topic "), F.col("lang"), F.lit(" x\n")))
        .otherwise(F.lit(""))
    )
    return _documents(spark, folder, "doc_id", "lang", "source", "text").select(
        "source",
        number.alias("page_ord"),
        (number % 1000 + 1).cast("int").alias("page_no"),
        F.concat(head, "text").alias("text"),
    )


def chapter_split(spark: SparkSession, folder: str) -> DataFrame:
    found = ch.split_chapters(_book_pages(spark, folder))
    return found.select(
        "source",
        "chapter_no",
        "part",
        "chapter",
        ch.pages_text(F.col("pages")).alias("pages"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def slice_plan(spark: SparkSession, folder: str) -> DataFrame:
    files = t.table(spark, folder, "documents").select("doc_id", F.ceil(F.col("n_chars") / 300).alias("total_pages"))
    return src.batches(src.slice_plan(files, "total_pages", 3), 8)


def slice_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Slices still to convert when those of labelled documents are done."""
    plan = slice_plan(spark, folder)
    left = src.remaining(plan, t.table(spark, folder, "labels"), ["doc_id"])
    return left.groupBy("batch_no").agg(F.count("*").alias("n_slices"), F.countDistinct("doc_id").alias("n_files"))


# Line rules for the comparison text; the tables hold no CJK or exotic white space.
_LINES = """
ln AS (
  SELECT doc_id, text, i, line, trim(line, ' ' || chr(9)) AS bare FROM (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS i,
           len(string_split(text, chr(10))) AS n FROM documents)
  WHERE NOT (i = n AND line = '')
),
judged AS (
  SELECT doc_id, i, line, CASE
    WHEN regexp_matches(line, '[\\\\$=^]') OR regexp_matches(line, '^\\s*<!--\\s*page\\s+\\d+\\s*-->\\s*$')
      OR regexp_matches(line, '^\\s*(#{1,6}\\b|[-=*_]{3,}\\s*$)') OR regexp_matches(line, '^\\s*\\d{1,3}\\s*[、．.)]') THEN ''
    WHEN bare = '' OR regexp_matches(bare, '^[·•\\-—=_*~]{1,4}$') THEN 'noise'
    WHEN regexp_matches(bare, '(?i)^(thank\\s*you(\\s*very\\s*much)?|thanks|the\\s*end|that''?s\\s*all)$')
      OR regexp_matches(bare, '(?i)^(contents|table\\s*of\\s*contents|index|outline|next|previous)$')
      OR regexp_matches(bare, '(?i)all rights reserved|permission of the publisher|without .*written permission|access code|scratch off|student access|premium content|redeem|pearson|published by|printed in|isbn\\s*[:0-9xX-]|^(copyright|©|\\(c\\))\\b')
      OR regexp_matches(bare, '(?i)^(https?://|www\\.|[\\w.\\-]+@[\\w.\\-]+\\.(com|cn|edu|org))')
      OR regexp_matches(bare, '^[-–—]?\\s*[0-9]{1,4}\\s*[-–—]?$')
      OR (length(bare) <= 2 AND NOT regexp_matches(bare, '[A-Za-z0-9]')) THEN 'chrome'
    ELSE '' END AS category
  FROM ln
)"""

_CLEAN = (
    _LINES
    + """,
agg AS (
  SELECT doc_id, count(*) FILTER (category <> '') AS removed_lines, 0::BIGINT AS story_removed,
    count(*) FILTER (category = 'chrome') AS chrome_removed,
    CAST(coalesce(sum(length(line)) FILTER (category = ''), 0) AS BIGINT) AS kept_chars,
    CAST(coalesce(sum(length(line)) FILTER (category <> ''), 0) AS BIGINT) AS removed_chars,
    trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (category = ''), ''), ' ' || chr(9) || chr(10)) AS clean
  FROM judged GROUP BY doc_id
),
cleaned AS (
  SELECT d.doc_id, d.source, CASE WHEN coalesce(clean, '') = '' THEN 0 ELSE removed_lines END AS removed_lines,
    CASE WHEN coalesce(clean, '') = '' THEN 0 ELSE story_removed END AS story_removed,
    CASE WHEN coalesce(clean, '') = '' THEN 0 ELSE chrome_removed END AS chrome_removed,
    CASE WHEN coalesce(clean, '') = '' THEN length(d.text) ELSE kept_chars END AS kept_chars,
    CASE WHEN coalesce(clean, '') = '' THEN 0 ELSE removed_chars END AS removed_chars,
    CASE WHEN coalesce(clean, '') = '' THEN d.text ELSE clean END AS text
  FROM documents d LEFT JOIN agg USING (doc_id)
)"""
)

CLEAN_SQL = _CLEAN

_BOOK = """
page AS (
  SELECT source, doc_id AS page_ord, CAST(doc_id % 1000 + 1 AS INT) AS page_no,
    CASE WHEN doc_id % 77 = 0 THEN 'CHAPTER 3 ' || chr(10)
         WHEN doc_id % 11 = 0 THEN '# Chapter 2 Overview ' || (doc_id % 90) || chr(10)
         WHEN doc_id % 7 = 0 THEN '## 第' || (doc_id % 9 + 1) || '章 Topic ' || lang || ' x' || chr(10)
         ELSE '' END || text AS text FROM documents
),
ln AS (
  SELECT * FROM (
    SELECT source, page_ord, page_no, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM page)
  WHERE NOT (i = n AND line = '')
),
head AS (
  SELECT *, regexp_matches(line, '(?i)^\\s*(#{1,6}\\s*)?(第\\s*[0-9一二三四五六七八九十百零]+(章|篇|讲|节)\\s*[:\\s]*|(CHAPTER|CH\\.|UNIT|MODULE)\\s+[A-Z0-9]+\\s*[:\\s]*)')
     AND NOT regexp_matches(line, '\\s[0-9]{1,4}\\s*$') AS is_head,
    trim(regexp_extract(line, '(?i)^\\s*(?:#{1,6}\\s*)?(?:第\\s*[0-9一二三四五六七八九十百零]+(?:章|篇|讲|节)\\s*[:\\s]*|(?:CHAPTER|CH\\.|UNIT|MODULE)\\s+[A-Z0-9]+\\s*[:\\s]*)(.*)$', 1)) AS name
  FROM ln
),
num AS (
  SELECT *, CAST(sum(is_head::INT) OVER (PARTITION BY source ORDER BY page_ord, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chapter_no FROM head
),
chap AS (
  SELECT source, chapter_no,
    coalesce(max(CASE WHEN is_head THEN CASE WHEN name = '' THEN '第' || page_no || '页章节' ELSE name END END), '(未分章)') AS name,
    string_agg(CASE WHEN is_head THEN '<!-- page ' || page_no || ' -->' ELSE line END, chr(10) ORDER BY page_ord, i) AS text
  FROM num GROUP BY source, chapter_no
),
page_end AS (SELECT source, page_ord, page_no, max(chapter_no) AS chapter_no FROM num GROUP BY ALL),
listed AS (
  SELECT source, chapter_no, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_ord) AS pages FROM (
    SELECT * FROM page_end UNION SELECT source, page_ord, page_no, chapter_no FROM num WHERE is_head) GROUP BY ALL
),
sized AS (SELECT *, greatest(CAST(ceil(length(text) / 50000.0) AS BIGINT), 1) AS parts FROM chap),
part AS (SELECT *, CAST(ceil(length(text) / parts::DOUBLE) AS BIGINT) AS each, unnest(range(1, parts + 1)) AS part FROM sized)
"""

ORACLE = {
    "denoise_stats": "WITH"
    + _CLEAN
    + """
SELECT doc_id, CAST(removed_lines AS BIGINT) AS removed_lines, CAST(story_removed AS BIGINT) AS story_removed,
  CAST(chrome_removed AS BIGINT) AS chrome_removed, CAST(kept_chars AS BIGINT) AS kept_chars,
  CAST(removed_chars AS BIGINT) AS removed_chars,
  CASE WHEN kept_chars + removed_chars = 0 THEN 0 ELSE round_even(removed_chars::DOUBLE / (kept_chars + removed_chars), 6) END AS removed_ratio,
  md5(text) AS text_md5 FROM cleaned""",
    "denoise_by_category": "WITH"
    + _LINES
    + """
SELECT category, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM judged GROUP BY category""",
    "min_size_chapters": "WITH"
    + _CLEAN
    + """
SELECT source, count(*) AS n_chapters, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM cleaned
WHERE length(text) >= 400 GROUP BY source""",
    "chapter_filter": "SELECT doc_id, source AS chapter FROM documents WHERE contains(source, 'rc1')",
    "chunk_documents": """
WITH n AS (SELECT doc_id, text, greatest(CAST(ceil((length(text) - 2000) / 1400.0) AS BIGINT), 0) AS m FROM documents),
c AS (SELECT doc_id, text, unnest(range(0, m + 1)) AS i FROM n)
SELECT doc_id, i + 1 AS chunk_no, length(substr(text, i * 1400 + 1, 2000)) AS n_chars,
  md5(substr(text, i * 1400 + 1, 2000)) AS chunk_md5 FROM c""",
    "page_marks": """
WITH p AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT doc_id, i + 4 AS page_no, trim(line, ' ' || chr(9)) AS body, i FROM p),
k AS (SELECT doc_id, page_no, body, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS page_ord FROM b WHERE body <> '')
SELECT doc_id, page_ord, CAST(page_no AS BIGINT) AS page_no, md5(body) AS text_md5 FROM k""",
    "chapter_split": "WITH"
    + _BOOK
    + """
SELECT p.source, p.chapter_no, p.part, CASE WHEN parts > 1 THEN name || '·' || part ELSE name END AS chapter,
  CASE WHEN parts > 1 THEN '' ELSE coalesce(l.pages, '') END AS pages,
  length(substr(text, (part - 1) * each + 1, each)) AS n_chars,
  md5(substr(text, (part - 1) * each + 1, each)) AS text_md5
FROM part p LEFT JOIN listed l ON l.source = p.source AND l.chapter_no = p.chapter_no""",
    "slice_plan": """
WITH f AS (SELECT doc_id, CAST(ceil(n_chars / 300.0) AS BIGINT) AS total_pages FROM documents),
s AS (SELECT doc_id, total_pages, unnest(range(0, total_pages, 3)) AS first_page FROM f WHERE total_pages > 0)
SELECT doc_id, total_pages, CAST(first_page // 3 + 1 AS BIGINT) AS slice_no, first_page,
  least(first_page + 3, total_pages) - 1 AS last_page, CAST(first_page // 3 // 8 + 1 AS BIGINT) AS batch_no FROM s""",
    "slice_resume": """
WITH f AS (SELECT doc_id, CAST(ceil(n_chars / 300.0) AS BIGINT) AS total_pages FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
s AS (SELECT doc_id, unnest(range(0, total_pages, 3)) AS first_page FROM f WHERE total_pages > 0)
SELECT CAST(first_page // 3 // 8 + 1 AS BIGINT) AS batch_no, count(*) AS n_slices, count(DISTINCT doc_id) AS n_files FROM s GROUP BY 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        denoise_stats,
        denoise_by_category,
        min_size_chapters,
        chapter_filter,
        chunk_documents,
        page_marks,
        chapter_split,
        slice_plan,
        slice_resume,
    )
}
