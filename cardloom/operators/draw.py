"""Daily card draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.scale import top_per_key


def draw_pool(courses: DataFrame, memory: DataFrame | None = None, chapter: str | None = None) -> DataFrame:
    """Course cards that are not reference-only, memory cards, and an optional chapter filter."""
    pool = courses.filter(~F.coalesce("reference_only", F.lit(False)))
    if memory is not None:
        pool = pool.unionByName(memory.select(*courses.columns))
    return pool.filter(F.col("chapter") == chapter) if chapter else pool


def daily_draw(pool: DataFrame, keys: list[str], n: int = 5, seed: str | None = None) -> DataFrame:
    """``n`` cards per key without replacement, uniform; the same seed draws the same cards.

    Without a seed the order is random.  Only n rows per key and input partition are shuffled.
    """
    order = F.rand() if seed is None else F.md5(F.concat(F.lit(seed), F.col("id")).cast("binary"))
    mixed = pool.withColumn("_draw", order)
    return top_per_key(mixed, keys, [F.asc("_draw"), F.asc("id")], n, salt=F.col("id")).drop("_draw")


def student_draw(
    studies: DataFrame, courses: DataFrame, memory: DataFrame, n: int = 5, seed: str | None = None
) -> DataFrame:
    """``n`` cards for each student out of one pool: the cards of all courses studied, and the student's own memory.

    ``studies``: user_id, course.  ``courses``: course, id, ...  ``memory``: the
    same columns and user_id.  All students of a day share the order of cards,
    so each course and each memory is cut to its first ``n`` before they meet,
    and no course is copied per student.
    """
    columns = courses.columns
    order = F.rand(7) if seed is None else F.md5(F.concat(F.lit(seed), F.col("id")).cast("binary"))
    by_draw = [F.asc("_draw"), F.asc("id")]
    first = top_per_key(courses.withColumn("_draw", order), ["course"], by_draw, n, salt=F.col("id")).drop("rank")
    own = top_per_key(memory.withColumn("_draw", order), ["user_id"], by_draw, n, salt=F.col("id")).drop("rank")
    pool = studies.select("user_id", "course").distinct().join(first, "course").unionByName(
        own.join(studies.select("user_id").distinct(), "user_id", "left_semi")
    )
    return top_per_key(pool, ["user_id"], by_draw, n).select("user_id", "rank", *columns)
