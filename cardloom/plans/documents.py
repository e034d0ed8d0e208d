"""Per-student documents: study progress and profile, with JSON files as a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import fixed_values as fixed
from cardloom.functions.text import exact_round
from cardloom.operators import profiles as pf
from cardloom.operators import progress as pg
from cardloom.scale import top_per_key
from cardloom.session import checkpointed

_STUDENT = ["user_id", "course"]


def _in_order(order: str, *fields: str | Column) -> Column:
    """Array of structs sorted by the first field, which stays in them."""
    return F.array_sort(F.collect_list(F.struct(order, *fields)))


def _chapters(log: DataFrame, units: int) -> DataFrame:
    depth = exact_round(F.col("depth_max_units") / F.lit(float(units)), 2)
    entry = F.struct("chapter", F.struct("questions", depth.alias("depth_max")).alias("value"))
    return (
        pg.chapter_progress(log)
        .groupBy(*_STUDENT)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("chapters"))
    )


def progress_documents(
    log: DataFrame, today: str, block: Column | None = None, units: int = pg.DEPTH_UNITS
) -> DataFrame:
    """Percentage, chapters, newest curve points, newest days and today's questions per student and course.

    Counts are over the whole log; only the newest curve points of a student are collected.
    """
    whole = checkpointed(pg.progress_curve(log, block, units))
    shown = top_per_key(whole, _STUDENT, [F.desc("q")], fixed.CURVE_API_CAP, rank="_r", salt=F.col("q"))
    curve = shown.groupBy(*_STUDENT).agg(
        _in_order("q", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "pct").alias("curve")
    )
    days = pg.daily_rollup(whole).groupBy(*_STUDENT).agg(_in_order("day", "questions", "pct").alias("daily"))
    return (
        pg.course_percent(log, units)
        .drop("chapters")
        .join(_chapters(log, units), _STUDENT)
        .join(curve, _STUDENT)
        .join(days, _STUDENT)
        .join(pg.today_questions(whole, today), _STUDENT)
    )


def profile_documents(
    profiles: DataFrame, log: DataFrame, reviews: DataFrame, memory: DataFrame, units: int = pg.DEPTH_UNITS
) -> DataFrame:
    """Profiles with preamble, memory counts, course progress and review statistics."""
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n_cards"))))
    buckets = pf.memory_counts(profiles, memory).groupBy("user_id").agg(counts.alias("memory_buckets"))
    courses = (
        pg.course_percent(log, units)
        .drop("chapters")
        .join(_chapters(log, units), _STUDENT)
        .groupBy("user_id")
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("course", F.struct("percent", "questions"))))
            ).alias("course_progress")
        )
    )
    stats = pg.review_stats(reviews).select(
        "user_id", F.struct("total", "correct", "wrong", "accuracy", "boxes").alias("reviews_stats")
    )
    return (
        profiles.withColumn("preamble", pf.preamble())
        .join(buckets, "user_id", "left")
        .join(courses, "user_id", "left")
        .join(stats, "user_id", "left")
    )


PROFILE = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("kind_bias", T.StringType()),
        T.StructField("style_flags", T.MapType(T.StringType(), T.BooleanType())),
        *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("weak_topics", "common_mistakes", "general_notes")],
        T.StructField("expression_notes", T.StringType()),
        T.StructField("turn_count", T.LongType()),
    ]
)


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.select(*PROFILE.fieldNames()).write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str, users: DataFrame) -> DataFrame:
    """Stored profiles of ``users``; a missing or broken record becomes an empty profile."""
    stored = spark.read.text(path).select(F.from_json("value", PROFILE).alias("p")).select("p.*").filter("user_id IS NOT NULL")
    empty = pf.default_profiles(users)
    known = stored.join(users.select("user_id"), "user_id", "left_semi")
    return known.unionByName(empty.join(known.select("user_id"), "user_id", "left_anti").select(*PROFILE.fieldNames()))
