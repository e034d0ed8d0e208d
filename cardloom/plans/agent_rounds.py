"""Tool-using retrieval for a batch of questions.

All questions move through the rounds together: one model pass over the open
conversations, then one retrieval job for all search calls and one lookup job
for all read calls of the round.  The number of rounds is fixed, so the
driver loop has a handful of steps whatever the number of questions.
Each round is checkpointed, so a lost executor repeats one round at most.

The model gets the conversation as a JSON array of messages and returns
``{"answer": text}`` or ``{"calls": [{"name": ..., "arguments": {...}}]}``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.operators import external as ex
from cardloom.operators import render
from cardloom.operators import retrieval as rt
from cardloom.plans.ask import find
from cardloom.session import checkpointed

TOOLS = [
    {
        "type": "function",
        "function": {
            "name": fixed.TOOL_SEARCH,
            "description": "Search the course's cards; returns short views with id, topic, kind, chapter and score.",
            "parameters": {
                "type": "object",
                "properties": {
                    "query": {"type": "string", "description": "Words to look for"},
                    "kind": {"type": "string", "enum": list(fixed.KINDS), "description": "Only cards of this kind"},
                },
                "required": ["query"],
            },
        },
    },
    {
        "type": "function",
        "function": {
            "name": fixed.TOOL_READ,
            "description": "Read one whole card.",
            "parameters": {
                "type": "object",
                "properties": {"card_id": {"type": "string", "description": "An id that a search returned"}},
                "required": ["card_id"],
            },
        },
    },
]

_MESSAGE = "array<struct<role: string, content: string>>"
_REPLY = "answer string, calls array<struct<name: string, arguments: struct<query: string, kind: string, card_id: string>>>"


def _message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _error(text) -> Column:
    return F.to_json(F.struct(text.alias("error")))


def run(
    questions: DataFrame,
    cards: DataFrame,
    model: Callable[[dict], str],
    k: int = fixed.DEFAULT_TOP_K,
    max_rounds: int = fixed.MAX_AGENT_ROUNDS,
) -> DataFrame:
    """``questions``: qid, course, question  ->  answer, rounds, tool_calls, seen_topics, read_cards, forced_final, trace, failed.

    ``trace`` lists the calls as ``round:tool:argument``.  A question whose
    model call fails for good gets the cards found first as its plain answer,
    with the reason in ``failed``; the others go on.
    """
    texts = F.array().cast("array<string>")
    pre = checkpointed(find(questions, cards, k))
    offered = (
        questions.join(render.previews(pre, ["qid"]), "qid", "left")
        .join(pre.groupBy("qid").agg(F.collect_set("topic").alias("seen")), "qid", "left")
        .join(render.render_methods(pre).select("qid", "methods_text"), "qid", "left")
    )
    first = F.concat(
        "question",
        F.when(
            F.col("preview").isNotNull(), F.concat(F.lit(fixed.LOOP_PREFETCH), "preview")
        ).otherwise(F.lit(fixed.LOOP_NO_PREFETCH)),
    )
    state = checkpointed(
        offered.select(
            "qid",
            "course",
            F.array(_message("user", first)).cast(_MESSAGE).alias("messages"),
            F.coalesce("seen", texts).alias("seen"),
            texts.alias("read"),
            F.lit(0).alias("tool_calls"),
            F.lit(0).alias("rounds"),
            F.lit(None).cast("string").alias("answer"),
            F.lit(False).alias("forced_final"),
            texts.alias("trace"),
            F.lit(None).cast("string").alias("failed"),
            render.offline_answer(F.col("methods_text")).alias("plain"),
        )
    )
    for number in range(1, max_rounds + 1):
        state = checkpointed(_round(state, cards, model, k, number))
        if state.filter(F.col("answer").isNull()).isEmpty():
            break
    return _finish(state, model)


def _replies(waiting: DataFrame, model: Callable[[dict], str], tools: bool) -> DataFrame:
    asked = waiting.select("qid", "course", F.to_json("messages").alias("messages"), F.lit(tools).alias("tools"))
    told = ex.call_rows(asked, ex.with_json_repair(ex.with_retries(model)), "reply", error="call_error")
    return told.select("qid", F.coalesce("reply", F.lit("{}")).alias("reply"), F.from_json("reply", _REPLY).alias("r"), "call_error")


def _round(state: DataFrame, cards: DataFrame, model: Callable[[dict], str], k: int, number: int) -> DataFrame:
    done = state.filter(F.col("answer").isNotNull())
    waiting = state.filter(F.col("answer").isNull())
    replies = checkpointed(_replies(waiting, model, True))
    calls = checkpointed(
        replies.select("qid", F.posexplode("r.calls").alias("call_no", "call")).join(
            waiting.select("qid", "course"), "qid"
        )
    )
    searches = calls.filter(F.col("call.name") == fixed.TOOL_SEARCH).select(
        F.concat_ws("#", F.col("qid").cast("string"), F.col("call_no").cast("string")).alias("sid"),
        "qid",
        "call_no",
        "course",
        F.coalesce("call.arguments.query", F.lit("")).alias("question"),
        F.nullif(F.col("call.arguments.kind"), F.lit("")).alias("wanted"),
    )
    results = _search(searches, cards, k).unionByName(_read(calls, cards)).unionByName(_unknown(calls))
    tool = F.struct("call_no", _message("tool", F.col("content")).alias("m"))
    gathered = results.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(tool)), lambda x: x["m"]).cast(_MESSAGE).alias("tool_messages"),
        F.array_distinct(F.flatten(F.collect_list("topics"))).alias("new_topics"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("card_id").isNotNull(), F.struct("call_no", "card_id")))),
            lambda x: x["card_id"],
        ).alias("new_read"),
        F.count("*").cast("int").alias("n_calls"),
    )
    argument = lambda c: F.coalesce(c["arguments"]["query"], c["arguments"]["card_id"], F.lit(""))
    steps = F.transform(
        "r.calls", lambda c: F.concat_ws(":", F.lit(str(number)), F.coalesce(c["name"], F.lit("")), argument(c))
    )
    none = F.array().cast("array<string>")
    moved = (
        waiting.join(replies, "qid")
        .join(gathered, "qid", "left")
        .select(
            "qid",
            "course",
            F.concat(
                "messages",
                F.array(_message("assistant", F.col("reply"))).cast(_MESSAGE),
                F.coalesce("tool_messages", F.array().cast(_MESSAGE)),
            ).alias("messages"),
            F.array_distinct(F.concat("seen", F.coalesce("new_topics", none))).alias("seen"),
            F.array_distinct(F.concat("read", F.coalesce("new_read", none))).alias("read"),
            (F.col("tool_calls") + F.coalesce("n_calls", F.lit(0))).alias("tool_calls"),
            F.lit(number).alias("rounds"),
            F.when(F.col("call_error").isNotNull(), F.col("plain"))
            .when(F.coalesce(F.size("r.calls"), F.lit(0)) <= 0, F.trim(F.coalesce("r.answer", F.lit(""))))
            .alias("answer"),
            "forced_final",
            F.concat("trace", F.coalesce(steps, none)).alias("trace"),
            F.col("call_error").alias("failed"),
            "plain",
        )
    )
    return done.unionByName(moved)


def _search(searches: DataFrame, cards: DataFrame, k: int) -> DataFrame:
    """Search calls: the kind filter is applied to the first 2k hits, then cut to k."""
    asked = searches.select(F.col("sid").alias("qid"), "course", "question")
    hits = checkpointed(find(asked, cards, 2 * k))  # scored once, few rows
    wanted = searches.select("sid", "wanted", F.col("qid").alias("asker"), "call_no")
    of_call = hits.withColumnRenamed("qid", "sid").join(wanted, "sid")
    plain = of_call.filter(F.col("wanted").isNull() & (F.col("rank") <= k))
    by_kind = rt.kind_after_rank(
        of_call.filter(F.col("wanted").isNotNull()).withColumnRenamed("sid", "qid"), F.col("wanted"), k
    ).withColumnRenamed("qid", "sid").drop("first_rank")
    kept = plain.unionByName(by_kind.select(*plain.columns))
    shown = render.previews(kept, ["sid"]).join(
        kept.groupBy("sid").agg(F.collect_set("topic").alias("topics")), "sid"
    )
    empty = F.to_json(F.struct(F.array().cast("array<string>").alias("hits"), F.lit(fixed.TOOL_NO_HIT).alias("hint")))
    return searches.join(shown, "sid", "left").select(
        "qid",
        "call_no",
        F.coalesce("preview", empty).alias("content"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.lit(None).cast("string").alias("card_id"),
    )


def _read(calls: DataFrame, cards: DataFrame) -> DataFrame:
    wanted = calls.filter(F.col("call.name") == fixed.TOOL_READ).select(
        "qid", "call_no", "course", F.coalesce("call.arguments.card_id", F.lit("")).alias("wanted")
    )
    # the asked cards first, few as they are; JSON is made of those only
    asked = cards.withColumnRenamed("id", "wanted").join(
        wanted.select("course", "wanted").distinct(), ["course", "wanted"], "left_semi"
    )
    found = asked.withColumnRenamed("wanted", "id").select("course", F.col("id").alias("wanted"), render.card_json().alias("json"))
    joined = wanted.join(found, ["course", "wanted"], "left")
    return joined.select(
        "qid",
        "call_no",
        F.coalesce("json", _error(F.format_string(fixed.TOOL_MISSING_CARD, "wanted"))).alias("content"),
        F.array().cast("array<string>").alias("topics"),
        F.when(F.col("json").isNotNull(), F.col("wanted")).alias("card_id"),
    )


def _unknown(calls: DataFrame) -> DataFrame:
    other = calls.filter(~F.coalesce("call.name", F.lit("")).isin(fixed.TOOL_SEARCH, fixed.TOOL_READ))
    return other.select(
        "qid",
        "call_no",
        _error(F.format_string(fixed.TOOL_UNKNOWN, F.coalesce("call.name", F.lit("")))).alias("content"),
        F.array().cast("array<string>").alias("topics"),
        F.lit(None).cast("string").alias("card_id"),
    )


def _finish(state: DataFrame, model: Callable[[dict], str]) -> DataFrame:
    """Questions still open after the last round get one call without tools."""
    open_ones = state.filter(F.col("answer").isNull())
    pressed = open_ones.withColumn(
        "messages", F.concat("messages", F.array(_message("user", F.lit(fixed.LOOP_FORCE_ANSWER))).cast(_MESSAGE))
    )
    told = _replies(pressed, model, False).select("qid", F.col("r.answer").alias("last"), "call_error")
    text = F.trim(F.coalesce(F.nullif(F.col("last"), F.lit("")), F.lit(fixed.LOOP_NO_TEXT)))
    forced = (
        pressed.join(told, "qid", "left")
        .withColumn("answer", F.when(F.col("call_error").isNotNull(), F.col("plain")).otherwise(text))
        .withColumn("forced_final", F.lit(True))
        .withColumn("failed", F.col("call_error"))
        .drop("last", "call_error")
    )
    whole = state.filter(F.col("answer").isNotNull()).unionByName(forced)
    return whole.select(
        "qid",
        "answer",
        "rounds",
        "tool_calls",
        F.array_sort("seen").alias("seen_topics"),
        F.col("read").alias("read_cards"),
        "forced_final",
        "trace",
        "failed",
    )
