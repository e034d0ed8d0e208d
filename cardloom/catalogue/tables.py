"""Views of the given tables as cards, questions, study logs and chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.scale import spread

COURSES = ("en", "fr", "de", "es")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as cards: language = course, source = chapter, first line = topic,
    inner lines = steps, last line = worked example, toxic label = reference only."""
    flagged = table(spark, folder, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("flag"))
    parts = F.split("text", "\n")
    return (
        spread(table(spark, folder, "documents"))
        .join(flagged, "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("lang").alias("course"),
            F.col("source").alias("chapter"),
            parts[0].alias("topic"),
            _pick(fixed.KINDS, F.col("doc_id")).alias("kind"),
            F.array_distinct(F.regexp_extract_all(parts[0], F.lit("([A-Za-z]{4,})"), F.lit(1))).alias("keywords"),
            F.array().cast("array<string>").alias("prerequisites"),
            F.lit("").alias("applicability"),
            F.when(F.size(parts) > 2, F.slice(parts, 2, F.size(parts) - 2))
            .otherwise(F.array().cast("array<string>"))
            .alias("steps"),
            F.lit("").alias("core_formula_latex"),
            F.lit("").alias("technique"),
            F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("worked_example"),
            F.array().cast("array<string>").alias("error_notes"),
            F.lit("").alias("source_page"),
            F.lit("").alias("source_url"),
            F.coalesce("flag", F.lit(False)).alias("reference_only"),
            F.col("doc_id").alias("ord"),
        )
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"),
        _pick(COURSES, F.col("item_id")).alias("course"),
        F.col("text").alias("question"),
    )


def study_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as answered course questions; depth in 1e-4 steps so that sums stay exact."""
    return table(spark, folder, "events").select(
        "user_id",
        F.lit("course").alias("course"),
        F.col("event_type").alias("chapter"),
        F.least(F.lit(10000), F.round(F.col("value") * 100)).cast("bigint").alias("depth_units"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Events as review answers: event type = card, 'ok' unless the value is below 20."""
    return table(spark, folder, "events").select(
        "user_id",
        F.col("event_type").alias("card_id"),
        (F.col("value") >= 20).alias("ok"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each user message with the assistant message right after it; ten students share the conversations."""
    said = table(spark, folder, "conversations")
    asked = said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = said.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(replies, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") % 10).alias("user_id"),
        F.col("conv_id").cast("string").alias("sid"),
        "turn",
        "question",
        "answer",
        F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn")).alias("ts"),
    )
