"""Retrieval evaluation: recall of expected topics and quiz coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import bind, exact_round


def covered_topics(topics: Column, expected: Column) -> Column:
    """Expected topics that occur, ignoring case, as substrings of the joined topics."""
    sides = F.struct(F.lower(F.array_join(topics, " ")).alias("text"), expected.alias("wanted"))
    return bind(sides, lambda s: F.filter(s["wanted"], lambda e: F.contains(s["text"], F.lower(e))))


def topics_in_rank_order(hits: DataFrame) -> DataFrame:
    """``hits``: qid, rank, topic with at most k rows per question."""
    return hits.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]).alias("topics")
    )


def recall(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """``questions``: qid, tag, expect_topics.  ``topics``: qid and the array of retrieved or seen topics."""
    none = F.array().cast("array<string>")
    joined = questions.join(topics, "qid", "left").withColumn("topics", F.coalesce("topics", none))
    hits = covered_topics(F.col("topics"), F.col("expect_topics"))
    return joined.withColumn("hits", hits).withColumn(
        "recall", exact_round(F.size("hits") / F.greatest(F.size("expect_topics"), F.lit(1)), 3)
    )


def recall_by_tag(results: DataFrame) -> DataFrame:
    """Mean recall per tag; the row with a null tag is the total."""
    return results.rollup("tag").agg(F.count("*").alias("questions"), F.avg("recall").alias("recall"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def quiz_coverage(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions in all and those whose best hit scores above 0."""
    best = hits.filter("rank = 1").select("qid", "score")
    return questions.select("qid").join(best, "qid", "left").agg(
        F.count("*").alias("questions"), F.count_if(F.col("score") > 0).alias("covered")
    )


def best_chapters(hits: DataFrame) -> DataFrame:
    return hits.filter("rank = 1").groupBy("chapter").agg(F.count("*").alias("questions"))
