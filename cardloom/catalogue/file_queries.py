"""Registered round trips through files: hits, evaluation results, chapter texts and question sets are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.catalogue import answer_queries as aq
from cardloom.catalogue import retrieval_queries as rq
from cardloom.catalogue import tables as t
from cardloom.functions.text import exact_round
from cardloom.operators import evaluation as ev
from cardloom.operators import retrieval as r
from cardloom.plans import ask
from cardloom.session import shared_table
from cardloom.sources import cards as cs
from cardloom.sources import documents as src


def hits_json(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_table(spark, "hits")
    ask.write_hits(r.lexical_topk(t.questions(spark, folder), t.cards(spark, folder), 5), path)
    hits = spark.read.schema("qid bigint, course string, rank bigint, card_id string, ord bigint, score double").json(path)
    return hits.select("qid", "rank", "card_id", exact_round(F.col("score"), 4).alias("score"))


def results_json(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_table(spark, "results")
    ev.write_results(aq.recall_eval(spark, folder), path)
    return spark.read.schema("qid bigint, tag string, n_expected bigint, n_hits bigint, recall double").json(path)


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "benchmark").select(
        F.concat(F.lit("course "), (F.col("item_id") % 4).cast("string")).alias("course"),
        F.concat(F.lit("part: "), (F.col("item_id") % 7).cast("string"), F.lit("/item?"), F.col("item_id").cast("string")).alias("chapter"),
        "text",
    )


def chapter_files(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as one file per chapter, under names that a file system takes."""
    path = shared_table(spark, "chapters")
    src.write_chapters(_named(spark, folder), path)
    back = spark.read.schema("value string, course string, file string").text(path, wholetext=True)
    text = F.regexp_replace("value", r"\n\z", "")
    return back.select("course", "file", F.length(text).cast("bigint").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


def question_file(spark: SparkSession, folder: str) -> DataFrame:
    """Question set as JSON lines; every fifth line has no question and is left out."""
    path = shared_table(spark, "questions")
    item = F.col("item_id")
    t.table(spark, folder, "benchmark").select(
        F.concat(F.lit("c"), (item % 4).cast("string")).alias("course"),
        F.when(item % 2 == 0, "direct").otherwise("two-hop").alias("tag"),
        F.when(item % 5 != 0, F.col("text")).alias("question"),
        F.array(F.concat(F.lit("topic "), item.cast("string")), F.lit("rest")).alias("expect_topics"),
    ).write.json(path)
    return cs.read_questions(spark, path).select(
        "course", "tag", F.md5(F.col("question").cast("binary")).alias("question_md5"), F.array_join("expect_topics", "|").alias("topics")
    )


ORACLE = {
    "hits_json": rq.ORACLE["lexical_topk"],
    "results_json": aq.ORACLE["recall_eval"],
    "chapter_files": """
SELECT 'course ' || item_id % 4 AS course, 'part_ ' || item_id % 7 || '_item_' || item_id AS file,
  CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM benchmark""",
    "question_file": """
SELECT 'c' || item_id % 4 AS course, CASE WHEN item_id % 2 = 0 THEN 'direct' ELSE 'two-hop' END AS tag, md5(text) AS question_md5,
  'topic ' || item_id || '|rest' AS topics FROM benchmark WHERE item_id % 5 <> 0 AND text IS NOT NULL""",
}

QUERIES = {f.__name__: f for f in (hits_json, results_json, chapter_files, question_file)}
