"""Batches of teaching turns: intent, retrieval, rerank, memory, prompt, answer and the events they leave.

A batch holds at most one turn per user, because a turn sees the state its
predecessor left.  State is never rewritten in place: every turn appends to
the study log, the chat turns and the memory cards, and profiles are views of
those tables.

Turns: qid, user_id, course, sid, question, seq, ts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.operators import external as ex
from cardloom.operators import intents
from cardloom.operators import profiles as pf
from cardloom.operators import progress as pg
from cardloom.operators import render
from cardloom.operators import retrieval as rt
from cardloom.plans.ask import find
from cardloom.session import checkpointed


def classified(turns: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Intent by rule, or a model's intent from ``hints`` (qid, intent, wants_memory) where there is one."""
    rule = intents.rule_intent(F.col("question"))
    if hints is None:
        return turns.withColumn("intent", rule).withColumn("wants_memory", intents.wants_memory(F.col("intent")))
    given = hints.select("qid", F.col("intent").alias("_intent"), F.col("wants_memory").alias("_wants"))
    joined = turns.join(given, "qid", "left")
    return joined.withColumn(
        "intent", F.when(F.col("_intent").isNull(), rule).otherwise(intents.known_intent(F.col("_intent")))
    ).withColumn(
        "wants_memory", F.coalesce("_wants", intents.wants_memory(F.col("intent")))
    ).drop("_intent", "_wants")


def model_intents(turns: DataFrame, model: Callable[[dict], str]) -> DataFrame:
    """Hints from a model that answers ``{"intent": ..., "wants_memory": ...}``; unreadable answers fall back to the rules."""
    told = ex.call_rows(
        turns.select("qid", "user_id", "seq", "question"), ex.with_retries(model), "_told", error="_failed"
    ).drop("_failed")
    parsed = F.from_json(
        "_told",
        "intent string, wants_memory boolean, stuck_topics array<string>, mistakes array<string>, expression_note string",
    )
    found = told.select("qid", "user_id", "seq", parsed.alias("_p")).filter(F.col("_p.intent").isNotNull())
    return found.select("qid", "user_id", "seq", "_p.*").withColumn("wants_memory", F.coalesce("wants_memory", F.lit(True)))


def list_items(hints: DataFrame, field: str) -> DataFrame:
    """``stuck_topics`` or ``mistakes`` of the hints as rows for ``profiles.capped_list``."""
    return hints.select("user_id", "seq", F.posexplode(field).alias("pos", "item"))


def course_hits(turns: DataFrame, cards: DataFrame, profiles: DataFrame, k: int | None = None) -> DataFrame:
    """Course cards of the course questions, reordered by each student's bias."""
    asked = turns.filter(~intents.is_general(F.col("intent")) & (F.coalesce("course", F.lit("")) != ""))
    hits = find(asked.select("qid", "course", "question"), cards, k)
    bias = asked.select("qid", "user_id").join(profiles.select("user_id", "kind_bias"), "user_id", "left").select(
        "qid", F.coalesce("kind_bias", F.lit(fixed.BIAS_BALANCED)).alias("kind_bias")
    )
    # few rows with several readers; scoring all cards happens once
    return checkpointed(rt.rerank_by_bias(hits.join(bias, "qid"), F.col("kind_bias")))


def memory_hits(turns: DataFrame, memory: DataFrame, profiles: DataFrame, k: int = fixed.MEMORY_METHODS) -> DataFrame:
    """Lexical hits in the student's own knowledge bucket, once the student has earlier turns."""
    known = profiles.filter("turn_count > 0").select("user_id")
    asked = turns.filter("wants_memory").join(known, "user_id", "left_semi")
    bucket = pf.bucket_course(F.col("user_id"), F.lit(fixed.BUCKETS[0]))
    return checkpointed(find(asked.select("qid", bucket.alias("course"), "question"), memory, k, use_vector=False))


def composed(
    turns: DataFrame, hits: DataFrame, remembered: DataFrame, profiles: DataFrame, contexts: DataFrame
) -> DataFrame:
    """Turns with mode, system and user text."""
    all_text = render.render_methods(hits)
    soft = render.render_methods(hits, fixed.SOFT_METHODS).select("qid", F.col("methods_text").alias("soft_text"))
    memory = render.render_methods(remembered, fixed.MEMORY_METHODS).select(
        "qid", F.col("methods_text").alias("memory_text")
    )
    first_chapter = hits.filter("rank = 1").select("qid", F.col("chapter").alias("first_chapter"))
    told = profiles.select("user_id", "turn_count", pf.preamble().alias("preamble"))
    unknown = {"preamble": pf.default_preamble(), "turn_count": 0}  # students without a profile yet
    joined = (
        turns.join(all_text, "qid", "left")
        .join(soft, "qid", "left")
        .join(memory, "qid", "left")
        .join(first_chapter, "qid", "left")
        .join(told, "user_id", "left")
        .na.fill(unknown)
        .join(contexts, ["user_id", "sid"], "left")
    )
    mode = intents.turn_mode(F.col("intent"), F.col("n_methods"), F.col("top_score"))
    system, user = render.teach_prompt()
    # read by the answers, the study log and the event sequence
    return checkpointed(joined.withColumn("mode", mode).withColumns({"system": system, "user": user}))


def answered(prepared: DataFrame, model: Callable[[dict], str] | None = ex.echo_answer) -> DataFrame:
    """Answers; without a model, or where its calls fail, the rendered cards stand in and ``offline`` is set."""
    if model is None:
        return prepared.withColumn("answer", render.offline_answer(F.col("methods_text"))).withColumn(
            "offline", F.lit(True)
        )
    told = ex.call_rows(prepared, ex.with_retries(model), "_answer", error="_failed")
    failed = F.col("_failed").isNotNull()
    return told.select(
        *prepared.columns,
        F.when(failed, render.offline_answer(F.col("methods_text"))).otherwise(F.col("_answer")).alias("answer"),
        failed.alias("offline"),
    )


def study_events(prepared: DataFrame) -> DataFrame:
    """Study log rows: course turns whose best score reaches the gate, credited to the first card's chapter."""
    depth = intents.question_depth(F.col("question"), F.col("intent"), F.col("top_score"))
    return prepared.filter((F.col("mode") != "general") & (F.col("top_score") >= fixed.RELEVANCE_GATE)).select(
        "user_id",
        "course",
        F.col("first_chapter").alias("chapter"),
        F.round(depth * pg.DEPTH_UNITS).cast("bigint").alias("depth_units"),
        "ts",
        "seq",
    )


def chat_turns(answers: DataFrame) -> DataFrame:
    """Rows for the chat table; offline turns leave none."""
    return answers.filter(~F.col("offline")).select(
        "user_id", "sid", F.col("seq").alias("turn"), "question", "answer", "ts"
    )


def memory_entries(answers: DataFrame, extractor: Callable[[dict], str]) -> DataFrame:
    """Memory entries that an extracting model returns as ``{"items": [{bucket, topic, content, examples, keywords}]}``.

    Everyday turns write to the general bucket only, greetings and offline turns write nothing.
    """
    asked = answers.filter(~F.col("offline") & (F.col("intent") != fixed.CHAT)).select(
        "user_id", "seq", "question", "answer", "mode"
    )
    told = ex.call_rows(asked, ex.with_json_repair(ex.with_retries(extractor)), "extracted", error="_failed").drop("_failed")
    entry = F.from_json(
        "raw_json", "bucket string, topic string, content string, examples array<string>, keywords array<string>"
    )
    rows = ex.items(told, "extracted", "items").withColumn("_e", entry)
    general = F.col("mode") == "general"
    return rows.select(
        "user_id",
        "seq",
        F.when(general, F.lit(fixed.GENERAL_BUCKET)).otherwise(F.col("_e.bucket")).alias("bucket"),
        "_e.topic",
        "_e.content",
        F.when(~general, F.col("_e.examples")).alias("examples"),
        F.when(~general, F.col("_e.keywords")).alias("keywords"),
        F.struct("seq", "item_no").alias("ord"),
    ).filter(
        F.when(F.col("bucket") == fixed.GENERAL_BUCKET, F.trim(F.coalesce("topic", F.lit(""))) != "").otherwise(
            F.col("bucket").isin(*fixed.BUCKETS)
        )
    )


def turn_events(prepared: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """The event sequence of every turn: intent, methods (at most five), done."""
    brief = F.struct("rank", render.method_brief().alias("b"))
    shown = hits.filter("rank <= 5").groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(brief)), lambda x: x["b"]).alias("methods")
    )
    intent = prepared.select("qid", F.lit(1).alias("event_no"), F.to_json(F.struct(F.lit("intent").alias("type"), "intent")).alias("event"))
    methods = prepared.select("qid").join(shown, "qid", "left").select(
        "qid", F.lit(2).alias("event_no"), F.to_json(F.struct(F.lit("methods").alias("type"), F.coalesce("methods", F.from_json(F.lit("[]"), shown.schema["methods"].dataType)).alias("methods"))).alias("event")
    )
    done = answers.select("qid", F.lit(3).alias("event_no"), F.to_json(F.struct(F.lit("done").alias("type"), "offline", "answer")).alias("event"))
    return intent.unionByName(methods).unionByName(done)
