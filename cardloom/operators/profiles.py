"""Student profiles: capped lists, wording notes, preamble text, memory cards and counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions.text import strip
from cardloom.scale import clustered, top_per_key


def capped_list(items: DataFrame, cap: int, trim: bool = True) -> DataFrame:
    """``items``: user_id, seq, pos, item  ->  user_id, place, item.

    Items join the list when absent from it; after each ``seq`` (one turn)
    only the newest ``cap`` stay, so a dropped item may come back later.

    Users with at most ``cap`` distinct items never drop any and are settled
    by an aggregate.  The rule is sequential for the others: their rows
    stream in order through a task that holds ``cap`` items per user.
    """
    item = strip(F.col("item")) if trim else F.col("item")
    clean = items.withColumn("item", item).filter(F.coalesce("item", F.lit("")) != "")
    first_seen = clean.groupBy("user_id", "item").agg(F.min(F.struct("seq", "pos")).alias("_first"))
    sizes = first_seen.groupBy("user_id").agg(F.count("*").alias("_n"))
    short = first_seen.join(sizes.filter(F.col("_n") <= cap), "user_id")
    settled = top_per_key(short, ["user_id"], [F.asc("_first")], cap, rank="place").select(
        "user_id", F.col("place").cast("bigint").alias("place"), "item"
    )
    long_rows = clean.join(sizes.filter(F.col("_n") > cap).select("user_id"), "user_id", "left_semi")
    ordered = clustered(long_rows.select("user_id", "seq", "pos", "item"), ["user_id"], ["seq", "pos"])
    user_type = items.schema["user_id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, turn, held = None, None, []

        def finished() -> pd.DataFrame:
            kept = held[-cap:]
            return pd.DataFrame({"user_id": [user] * len(kept), "place": range(1, len(kept) + 1), "item": kept})

        for pdf in batches:
            for next_user, next_turn, item in zip(pdf["user_id"], pdf["seq"], pdf["item"]):
                if next_user != user:
                    if held:
                        yield finished()
                    user, turn, held = next_user, next_turn, []
                elif next_turn != turn:
                    turn, held = next_turn, held[-cap:]
                if item not in held:
                    held.append(item)
        if held:
            yield finished()

    return settled.unionByName(ordered.mapInPandas(fold, f"user_id {user_type}, place bigint, item string"))


def as_list(placed: DataFrame, name: str) -> DataFrame:
    """Capped lists as one array per user."""
    return placed.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias(name)
    )


def general_notes(items: DataFrame) -> DataFrame:
    """Everyday topics, 30 characters each, newest 20."""
    short = items.withColumn("item", F.substring(strip(F.col("item")), 1, fixed.GENERAL_NOTE_CHARS))
    return capped_list(short, fixed.GENERAL_NOTES_CAP, trim=False)


def expression_notes(notes: DataFrame, limit: int = fixed.EXPRESSION_CHARS) -> DataFrame:
    """``notes``: user_id, seq, note  ->  user_id, expression_notes.

    A note is appended in ``seq`` order unless the text contains it; separators
    at the ends are dropped, and the text is cut to ``limit`` characters.
    Notes stream sorted through tasks that hold one user's text at a time, so
    neither their number nor copies among them matter.
    """
    given = notes.filter(F.coalesce("note", F.lit("")) != "").select("user_id", "seq", "note")
    ordered = clustered(given, ["user_id"], ["seq", "note"])
    user_type = notes.schema["user_id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, text, begun = None, "", False

        def finished() -> pd.DataFrame:
            return pd.DataFrame({"user_id": [user], "expression_notes": [text]})

        for pdf in batches:
            for next_user, note in zip(pdf["user_id"], pdf["note"]):
                if not begun or next_user != user:
                    if begun:
                        yield finished()
                    user, text, begun = next_user, "", True
                if note not in text:
                    text = f"{text}；{note}".strip("；")[:limit]
        if begun:
            yield finished()

    return ordered.mapInPandas(fold, f"user_id {user_type}, expression_notes string")


def preamble() -> Column:
    """Teaching hints from level, weak_topics, common_mistakes, style_flags and expression_notes."""
    topics = F.array_join(F.slice("weak_topics", 1, fixed.PREAMBLE_TOPICS), "、")
    mistakes = F.array_join(F.slice("common_mistakes", 1, fixed.PREAMBLE_TOPICS), "、")
    past = F.when(
        (F.size("weak_topics") > 0) | (F.size("common_mistakes") > 0),
        F.concat(
            F.lit(fixed.PREAMBLE_PAST),
            F.when(F.size("weak_topics") > 0, F.format_string(fixed.PREAMBLE_TOPIC_TEXT, topics)).otherwise(F.lit("")),
            F.when(F.size("common_mistakes") > 0, F.format_string(fixed.PREAMBLE_MISTAKE_TEXT, mistakes)).otherwise(
                F.lit("")
            ),
            F.lit(fixed.PREAMBLE_QUIET),
        ),
    )
    style = F.array_join(F.map_keys(F.map_filter("style_flags", lambda _, on: on)), "、")
    return F.concat_ws(
        " ",
        F.format_string(fixed.PREAMBLE_LEVEL, "level"),
        past,
        F.when(style != "", F.format_string(fixed.PREAMBLE_STYLE, style)),
        F.when(
            F.coalesce("expression_notes", F.lit("")) != "", F.format_string(fixed.PREAMBLE_WORDING, "expression_notes")
        ),
    )


def default_preamble() -> str:
    """Preamble of an empty profile."""
    style = "、".join(k for k, on in fixed.DEFAULT_STYLE.items() if on)
    return " ".join([fixed.PREAMBLE_LEVEL % fixed.DEFAULT_LEVEL, fixed.PREAMBLE_STYLE % style])


def default_profiles(users: DataFrame) -> DataFrame:
    texts = F.array().cast("array<string>")
    flags = [F.lit(x) for pair in fixed.DEFAULT_STYLE.items() for x in pair]
    return users.select(
        "user_id",
        F.lit(fixed.DEFAULT_LEVEL).alias("level"),
        F.lit(fixed.BIAS_BALANCED).alias("kind_bias"),
        F.create_map(*flags).alias("style_flags"),
        texts.alias("weak_topics"),
        texts.alias("common_mistakes"),
        texts.alias("general_notes"),
        F.lit("").alias("expression_notes"),
        F.lit(0).cast("bigint").alias("turn_count"),
    )


def profiles(users: DataFrame, turns_written: DataFrame, lists: dict[str, DataFrame], notes: DataFrame) -> DataFrame:
    """Profiles from the derived views: turn counts, capped lists (as arrays) and wording notes."""
    texts = F.array().cast("array<string>")
    base = default_profiles(users).drop("turn_count", "expression_notes", *lists)
    base = base.join(turns_written.groupBy("user_id").agg(F.count("*").alias("turn_count")), "user_id", "left")
    for name, placed in lists.items():
        base = base.join(as_list(placed, name), "user_id", "left").withColumn(name, F.coalesce(name, texts))
    return (
        base.join(notes, "user_id", "left")
        .withColumn("expression_notes", F.coalesce("expression_notes", F.lit("")))
        .withColumn("turn_count", F.coalesce("turn_count", F.lit(0).cast("bigint")))
    )


# ---- memory -----------------------------------------------------------------


def bucket_course(user: Column, bucket: Column) -> Column:
    return F.format_string(fixed.BUCKET_COURSE_FORMAT, user.cast("string"), bucket)


def memory_cards(entries: DataFrame) -> DataFrame:
    """``entries``: user_id, bucket, topic, content, examples, keywords, ord  ->  card rows with content-derived ids.

    The same memory written twice gets the same id, so saving it again changes nothing.
    """
    texts = F.array().cast("array<string>")
    topic = F.substring(
        F.when(F.coalesce("topic", F.lit("")) == "", F.lit(fixed.MEMORY_UNNAMED)).otherwise(F.col("topic")),
        1,
        fixed.MEMORY_TOPIC_CHARS,
    )
    content = F.coalesce("content", F.lit(""))
    examples = F.filter(F.coalesce("examples", texts), lambda x: x != "")
    seed = F.concat_ws("|", "bucket", topic, content, F.array_join(examples, "|"))
    wording = F.col("bucket") == fixed.WORDING_BUCKET
    kinds = F.create_map(*[F.lit(x) for pair in fixed.BUCKET_KINDS.items() for x in pair])
    return entries.select(
        F.format_string(
            fixed.MEMORY_ID_FORMAT, "bucket", F.substring(F.sha2(seed.cast("binary"), 256), 1, fixed.MEMORY_HASH_CHARS)
        ).alias("id"),
        bucket_course(F.col("user_id"), F.col("bucket")).alias("course"),
        F.lit(fixed.MEMORY_CHAPTER).alias("chapter"),
        topic.alias("topic"),
        kinds[F.col("bucket")].alias("kind"),
        F.when(wording, examples).otherwise(F.coalesce("keywords", texts)).alias("keywords"),
        texts.alias("prerequisites"),
        F.when(wording, F.lit(fixed.WORDING_APPLICABILITY)).otherwise(F.lit(fixed.MEMORY_APPLICABILITY)).alias("applicability"),
        F.when(content != "", F.array(content)).otherwise(texts).alias("steps"),
        F.lit("").alias("core_formula_latex"),
        F.lit("").alias("technique"),
        F.lit("").alias("worked_example"),
        texts.alias("error_notes"),
        F.lit("").alias("source_page"),
        F.lit("").alias("source_url"),
        F.lit(False).alias("reference_only"),
        "ord",
    )


def wording_tip(entries: DataFrame) -> DataFrame:
    """``entries`` of the wording bucket per (user_id, seq): joined examples, 120 characters."""
    texts = F.array().cast("array<string>")
    one = F.array_join(F.coalesce("examples", texts), "、")
    return (
        entries.filter(F.col("bucket") == fixed.WORDING_BUCKET)
        .groupBy("user_id", "seq")
        .agg(
            F.substring(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), "；"
                ),
                1,
                fixed.EXPRESSION_TIP_CHARS,
            ).alias("note")
        )
    )


def memory_counts(users: DataFrame, memory: DataFrame) -> DataFrame:
    """Cards per user and bucket, empty buckets included."""
    buckets = F.explode(F.array(*[F.lit(b) for b in (*fixed.BUCKETS, fixed.GENERAL_BUCKET)]))
    wanted = users.select("user_id", buckets.alias("bucket")).withColumn(
        "course", bucket_course(F.col("user_id"), F.col("bucket"))
    )
    counted = memory.groupBy("course").agg(F.count("*").alias("n_cards"))
    return wanted.join(counted, "course", "left").select(
        "user_id", "bucket", F.coalesce("n_cards", F.lit(0).cast("bigint")).alias("n_cards")
    )
