"""Line cleaning of chapter texts.

A chapter is one row, so its lines are classified inside the row with
higher-order functions: no shuffle, and the cleaned text never has to be
reassembled from exploded lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions.text import bind, lines, strip

NOISE, CHROME, STORY, KEPT = "noise", "chrome", "story", ""


def _publisher(line: Column, low: Column) -> Column:
    """The publisher rule behind a cheap look for the words it needs (``low`` is the lower-case line)."""
    hinted = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in fixed.PUBLISHER_HINTS])
    return hinted & line.rlike(fixed.PUBLISHER)


def line_category(line: Column) -> Column:
    """'' keeps the line; otherwise why it goes: noise, chrome or story.  First matching rule decides.

    Rules written in Chinese are tried only on lines that hold a CJK character.
    """

    def judged(pair: Column) -> Column:
        raw, bare = pair["raw"], pair["bare"]
        protected = (
            raw.rlike(fixed.KEEP_MATH)
            | raw.rlike(fixed.KEEP_ANCHOR)
            | raw.rlike(fixed.KEEP_HEADING)
            | raw.rlike(fixed.KEEP_LIST)
        )
        form = (
            bare.rlike(fixed.CLOSING_LINE)
            | bare.rlike(fixed.NAVIGATION_LINE)
            | bare.rlike(fixed.ADDRESS_START)
            | bare.rlike(fixed.PAGE_NUMBER)
            | ((F.length(bare) <= fixed.SYMBOL_MAX_CHARS) & ~bare.rlike(fixed.READABLE))
            | _publisher(bare, pair["low"])
        )
        chinese_form = (
            bare.rlike(fixed.CLOSING_WORDS) | bare.rlike(fixed.PLACEHOLDER) | bare.rlike(fixed.PAGE_NUMBER_ZH)
        )
        biography = (
            (F.length(bare) <= fixed.STORY_MAX_CHARS)
            & (bare.rlike(fixed.BIOGRAPHY) | bare.rlike(fixed.BIOGRAPHY_YEAR))
            & ~bare.rlike(fixed.TECH_WORDS)
        )
        return (
            F.when(protected, F.lit(KEPT))
            .when((bare == "") | bare.rlike(fixed.DECORATION), F.lit(NOISE))
            .when(form, F.lit(CHROME))
            .when(~bare.rlike(fixed.CJK), F.lit(KEPT))
            .when(chinese_form, F.lit(CHROME))
            .when(biography, F.lit(STORY))
            .otherwise(F.lit(KEPT))
        )

    # binds the trimmed and the lower-case line once for all rules
    bound = F.struct(line.alias("raw"), strip(line).alias("bare"), F.lower(line).alias("low"))
    return bind(bound, judged)


def classified(text: Column) -> Column:
    """Array of ``(line, category)`` of a text."""
    return F.transform(lines(text), lambda line: F.struct(line.alias("line"), line_category(line).alias("category")))


def _counted(found: Column, keep) -> Column:
    return F.size(F.filter(found, keep)).cast("bigint")


def _chars(found: Column, keep) -> Column:
    return F.aggregate(
        F.filter(found, keep), F.lit(0).cast("bigint"), lambda total, x: total + F.length(x["line"])
    )


def denoise(df: DataFrame, text: str = "text", fall_back: bool = True) -> DataFrame:
    """Cleaned text and the five counters, plus the removed ratio.

    ``fall_back`` is the chapter rule: a chapter that would end up empty keeps
    its text and reports nothing removed.
    """
    # a generator output is computed once however often it is used, also by filters on the result
    marked = df.select("*", F.explode(F.array(classified(F.col(text)))).alias("_lines"))
    removed = lambda x: x["category"] != KEPT
    stats = marked.withColumns(
        {
            "_clean": strip(
                F.array_join(F.transform(F.filter("_lines", lambda x: x["category"] == KEPT), lambda x: x["line"]), "\n")
            ),
            "removed_lines": _counted(F.col("_lines"), removed),
            "story_removed": _counted(F.col("_lines"), lambda x: x["category"] == STORY),
            "chrome_removed": _counted(F.col("_lines"), lambda x: x["category"] == CHROME),
            "kept_chars": _chars(F.col("_lines"), lambda x: x["category"] == KEPT),
            "removed_chars": _chars(F.col("_lines"), removed),
        }
    ).drop("_lines")
    if fall_back:
        emptied = F.col("_clean") == ""
        zero = F.lit(0).cast("bigint")
        stats = stats.withColumns(
            {
                "_clean": F.when(emptied, F.col(text)).otherwise(F.col("_clean")),
                "kept_chars": F.when(emptied, F.length(text).cast("bigint")).otherwise(F.col("kept_chars")),
                **{
                    c: F.when(emptied, zero).otherwise(F.col(c))
                    for c in ("removed_lines", "story_removed", "chrome_removed", "removed_chars")
                },
            }
        )
    total = F.col("kept_chars") + F.col("removed_chars")
    return (
        stats.withColumn("removed_ratio", F.coalesce(F.try_divide(F.col("removed_chars"), total), F.lit(0.0)))
        .drop(text)
        .withColumnRenamed("_clean", text)
    )


def line_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines and characters per category over all texts; counted map-side."""
    return (
        df.select(F.explode(classified(F.col(text))).alias("x"))
        .groupBy(F.col("x.category").alias("category"))
        .agg(F.count("*").alias("n_lines"), F.sum(F.length("x.line")).cast("bigint").alias("n_chars"))
    )


def large_enough(df: DataFrame, text: str = "text", minimum: int = fixed.MIN_CHAPTER_CHARS) -> DataFrame:
    return df.filter(F.length(text) >= minimum)
