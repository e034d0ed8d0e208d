"""Study progress and spaced review over append-only event tables.

Study log: user_id, course, chapter, depth_units (bigint, ``units`` = depth 1), ts, seq.
Review log: user_id, card_id, ok, ts, seq.  ``(ts, seq)`` orders a user's events.

``block`` arguments take the column of ``scale.time_block``; None means that
every key is known to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions.text import cut, exact_round
from cardloom.scale import running, top_per_key

DEPTH_UNITS = 1_000_000
_ORDER = ["ts", "seq"]
_STUDENT = ["user_id", "course"]


def _percent(total: Column, chapters: Column, units: int) -> Column:
    return F.bround(F.least(total / chapters / F.lit(float(units)), F.lit(1.0)) * 100).cast("bigint")


def named_chapter() -> Column:
    return F.when(F.coalesce("chapter", F.lit("")) == "", F.lit(fixed.UNTITLED_CHAPTER)).otherwise(F.col("chapter"))


def chapter_progress(log: DataFrame) -> DataFrame:
    return (
        log.withColumn("chapter", named_chapter())
        .groupBy(*_STUDENT, "chapter")
        .agg(
            F.count("*").alias("questions"),
            F.sum("depth_units").alias("depth_sum_units"),
            F.max("depth_units").alias("depth_max_units"),
            F.max("ts").alias("last_ts"),
        )
    )


def course_percent(log: DataFrame, units: int = DEPTH_UNITS) -> DataFrame:
    """Mean over chapters of the deepest question, as a percentage."""
    return (
        chapter_progress(log)
        .groupBy(*_STUDENT)
        .agg(
            F.sum("questions").alias("questions"),
            F.count("*").alias("chapters"),
            _percent(F.sum("depth_max_units"), F.count("*"), units).alias("percent"),
        )
    )


def progress_curve(log: DataFrame, block: Column | None = None, units: int = DEPTH_UNITS) -> DataFrame:
    """Per question the running question count ``q`` and the running percentage ``pct``.

    The chapter maxima sum is carried as increments over the earlier maximum
    of the question's chapter, so two running passes replace a per-user fold.
    """
    named = log.withColumn("chapter", named_chapter())
    if block is None:
        named = named.repartition("user_id")  # serves both passes with one shuffle
    earlier = running(named, [*_STUDENT, "chapter"], _ORDER, {"_before": ("max_before", F.col("depth_units"))}, block)
    rise = F.greatest(F.col("depth_units") - F.coalesce("_before", F.lit(0)), F.lit(0))
    totals = running(
        earlier,
        _STUDENT,
        _ORDER,
        {
            "q": ("sum", F.lit(1).cast("bigint")),
            "_total": ("sum", rise),
            "_chapters": ("sum", F.col("_before").isNull().cast("bigint")),
        },
        block,
    )
    return totals.select(
        *_STUDENT, "chapter", "ts", "seq", "q", _percent(F.col("_total"), F.col("_chapters"), units).alias("pct")
    )


def curve_tail(curve: DataFrame, cap: int = fixed.CURVE_CAP) -> DataFrame:
    return top_per_key(curve, _STUDENT, [F.desc("q")], cap, rank="_r", salt=F.col("q")).drop("_r")


def daily_rollup(curve: DataFrame, days: int = fixed.DAILY_DAYS, cap: int | None = None) -> DataFrame:
    """Questions and last non-zero percentage per day, newest ``days`` days.

    ``cap`` looks at the last so many questions of a student only, as a store
    that keeps no more would; by default all count.
    """
    per_day = (curve if cap is None else curve_tail(curve, cap)).groupBy(*_STUDENT, F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("questions"),
        F.coalesce(
            F.max_by(F.when(F.col("pct") != 0, F.col("pct")), F.when(F.col("pct") != 0, F.col("q"))),
            F.lit(0).cast("bigint"),
        ).alias("pct"),
    )
    return top_per_key(per_day, _STUDENT, [F.desc("day")], days, rank="_r").drop("_r")


def today_questions(curve: DataFrame, today: str, cap: int | None = None) -> DataFrame:
    """Questions of one day; ``cap`` as in ``daily_rollup``."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return (curve if cap is None else curve_tail(curve, cap)).groupBy(*_STUDENT).agg(F.count_if(day == today).alias("today_questions"))


def radar_chapters(progress: DataFrame, top: int = fixed.RADAR_CHAPTERS) -> DataFrame:
    """Deepest chapters per student; parts ``name·i`` count as one chapter."""
    base = F.regexp_replace("chapter", fixed.PART_SEPARATOR + r"\d+$", "")
    deepest = progress.groupBy(*_STUDENT, base.alias("name")).agg(F.max("depth_max_units").alias("depth_units"))
    best = top_per_key(deepest, _STUDENT, [F.desc("depth_units"), F.asc("name")], top)
    return best.withColumn("label", cut(F.col("name"), fixed.RADAR_LABEL_CHARS, "…"))


# ---- spaced review ----------------------------------------------------------


def review_boxes(reviews: DataFrame, block: Column | None = None) -> DataFrame:
    """Box after each answer: right answers since the last wrong one, plus 1, at most 5."""
    key = ["user_id", "card_id"]
    if block is None:
        reviews = reviews.repartition(*key)
    right = running(reviews, key, _ORDER, {"_right": ("sum", F.col("ok").cast("bigint"))}, block)
    marked = running(right, key, _ORDER, {"_mark": ("max", F.when(~F.col("ok"), F.col("_right")))}, block)
    box = F.least(F.lit(fixed.TOP_BOX).cast("bigint"), F.col("_right") - F.coalesce("_mark", F.lit(0)) + 1)
    return marked.withColumn("box", box).drop("_right", "_mark")


def current_boxes(boxed: DataFrame) -> DataFrame:
    return boxed.groupBy("user_id", "card_id").agg(F.max_by("box", F.struct("ts", "seq")).alias("box"))


def review_stats(reviews: DataFrame, cap: int | None = None) -> DataFrame:
    """Totals over all answers of a user, or over the last ``cap``; boxed cards always count over all."""
    newest = [F.desc("ts"), F.desc("seq")]
    log = reviews if cap is None else top_per_key(reviews, ["user_id"], newest, cap, rank="_r", salt=F.col("seq"))
    totals = log.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("correct"),
        F.count_if(~F.col("ok")).alias("wrong"),
        exact_round(F.count_if("ok") / F.count("*"), 2).alias("accuracy"),
    )
    boxes = (
        reviews.select("user_id", "card_id").distinct().groupBy("user_id").agg(F.count("*").alias("boxes"))
    )
    return totals.join(boxes, "user_id")
