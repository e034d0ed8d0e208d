"""Chat sessions as event tables: capped history, context text, titles, lists and actions.

Turns: user_id, sid, turn, question, answer, ts.  ``turn`` orders a user's turns.
Actions: user_id, seq, action (new, switch, clear, delete), sid, title, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions.text import strip
from cardloom.scale import running, top_per_key

_SESSION = ["user_id", "sid"]


def surviving_turns(turns: DataFrame, actions: DataFrame) -> DataFrame:
    """Turns that actions leave: later than the last clear or delete of their session.

    Turns and actions are compared by ``ts``; at equal times the action comes
    later.  A session that was deleted and used again keeps what was said since.
    """
    ended = F.col("action").isin("clear", "delete") & ~((F.col("action") == "delete") & (F.col("sid") == fixed.DEFAULT_SESSION))
    last = actions.filter(ended).groupBy(*_SESSION).agg(F.max("ts").alias("_ended"))
    return (
        turns.join(last, _SESSION, "left")
        .filter(F.col("_ended").isNull() | (F.col("ts") > F.col("_ended")))
        .select(*turns.columns)
    )


def history(
    turns: DataFrame, cap: int = fixed.HISTORY_CAP, shorten: bool = False, actions: DataFrame | None = None
) -> DataFrame:
    """Last ``cap`` turns per session; ``shorten`` cuts the texts to the stored lengths for display."""
    said = turns if actions is None else surviving_turns(turns, actions)
    kept = top_per_key(said, _SESSION, [F.desc("turn")], cap, rank="age", salt=F.col("turn"))
    if not shorten:
        return kept
    return kept.withColumns(
        {
            "question": F.substring(F.coalesce("question", F.lit("")), 1, fixed.STORED_QUESTION_CHARS),
            "answer": F.substring(F.coalesce("answer", F.lit("")), 1, fixed.STORED_ANSWER_CHARS),
        }
    )


def chat_context(turns: DataFrame, n: int = fixed.CONTEXT_TURNS, actions: DataFrame | None = None) -> DataFrame:
    """Text of the last ``n`` turns per session, oldest first; ``actions`` clear and delete what was said before."""
    said = turns if actions is None else surviving_turns(turns, actions)
    last = top_per_key(said, _SESSION, [F.desc("turn")], n, rank="age", salt=F.col("turn"))
    row = F.concat(
        F.lit(fixed.CONTEXT_QUESTION),
        F.substring(F.coalesce("question", F.lit("")), 1, fixed.CONTEXT_QUESTION_CHARS),
        F.lit(fixed.CONTEXT_ANSWER),
        F.substring(F.coalesce("answer", F.lit("")), 1, fixed.CONTEXT_ANSWER_CHARS),
    )
    return (
        last.withColumn("_row", row)
        .groupBy(*_SESSION)
        .agg(
            F.concat(
                F.lit(fixed.CONTEXT_HEAD),
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_row"))), lambda x: x["_row"]), "\n\n"),
            ).alias("context")
        )
    )


def question_title(question: Column) -> Column:
    flat = F.regexp_replace(strip(F.coalesce(question, F.lit(""))), "\n", " ")
    cut = F.concat(
        F.substring(flat, 1, fixed.TITLE_CHARS),
        F.when(F.length(flat) > fixed.TITLE_CHARS, F.lit("…")).otherwise(F.lit("")),
    )
    return F.when(flat == "", F.lit(fixed.NEW_SESSION_TITLE)).otherwise(cut)


def is_placeholder(title: Column) -> Column:
    bare = F.ltrim(F.coalesce(title, F.lit("")))
    hit = bare == ""
    for start in fixed.PLACEHOLDER_TITLES:
        hit = hit | bare.startswith(start)
    return hit


def session_titles(turns: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Title per session: the given one, unless it is a placeholder; then the first question that names it.

    ``given``: user_id, sid, title.  A blank question keeps the placeholder
    open, so the first question with text decides.
    """
    title = question_title(F.col("question"))
    named = F.when(title != fixed.NEW_SESSION_TITLE, F.struct("turn", title.alias("t")))
    first = turns.groupBy(*_SESSION).agg(F.coalesce(F.min(named)["t"], F.lit(fixed.NEW_SESSION_TITLE)).alias("_auto"))
    if given is None:
        return first.withColumnRenamed("_auto", "title")
    return first.join(given, _SESSION, "full_outer").select(
        *_SESSION,
        F.when(is_placeholder(F.col("title")), F.coalesce("_auto", "title"))
        .otherwise(F.col("title"))
        .alias("title"),
    )


def session_list(turns: DataFrame, cap: int | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Sessions per user with title, number of turns and times.

    With ``actions`` a session is listed if it was opened or used since its
    last delete, sessions without turns included, and so is every user's
    default session; a given title names it unless it is a placeholder.
    ``created`` and ``updated`` are null where nothing has happened yet.
    ``cap`` shows no more turns than a capped history keeps.
    """
    said = turns if actions is None else surviving_turns(turns, actions)
    listed = said.groupBy(*_SESSION).agg(
        F.count("*").alias("count"), F.min("ts").alias("_first"), F.max("ts").alias("_last")
    )
    if actions is None:
        sessions = listed.join(session_titles(said), _SESSION).withColumns({"created": F.col("_first"), "updated": F.col("_last")})
    else:
        state = _states(actions).select(*_SESSION, "title", "_opened", "_alive")
        users = turns.select("user_id").union(actions.select("user_id")).distinct()
        default = users.select("user_id", F.lit(fixed.DEFAULT_SESSION).alias("sid"))
        opened = state.filter("_alive").unionByName(
            default.join(state.filter("_alive"), _SESSION, "left_anti"), allowMissingColumns=True
        )
        unnamed = F.when(F.col("sid") == fixed.DEFAULT_SESSION, fixed.DEFAULT_SESSION_TITLE).otherwise(fixed.NEW_SESSION_TITLE)
        named = opened.select(*_SESSION, F.coalesce("title", unnamed).alias("title"))
        titles = session_titles(said, named.filter(F.col("title") != fixed.NEW_SESSION_TITLE))
        sessions = (
            listed.join(opened.select(*_SESSION, "_opened"), _SESSION, "full_outer")
            .join(titles, _SESSION, "left")
            .withColumns(
                {
                    "title": F.coalesce("title", F.lit(fixed.NEW_SESSION_TITLE)),
                    "count": F.coalesce("count", F.lit(0).cast("bigint")),
                    "created": F.coalesce("_opened", "_first"),
                    "updated": F.coalesce("_last", "_opened"),
                }
            )
        )
    shown = F.col("count") if cap is None else F.least("count", F.lit(cap).cast("bigint"))
    return sessions.select(*_SESSION, shown.alias("count"), "created", "updated", "title")


def new_session_id(title: Column, ts: Column) -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(title, F.lit("")), ts.cast("double").cast("string")).cast("binary")), 1, 8)


def _latest(actions: DataFrame, block: Column | None) -> DataFrame:
    def at(name: str) -> Column:
        return F.when(F.col("action") == name, F.col("seq"))

    return running(
        actions, _SESSION, ["seq"], {"_made": ("max", at("new")), "_gone": ("max", at("delete"))}, block
    )


def _alive(sid: Column, made: Column, gone: Column) -> Column:
    return (sid == fixed.DEFAULT_SESSION) | (F.coalesce(made, F.lit(-1)) > F.coalesce(gone, F.lit(-1)))


def _states(actions: DataFrame) -> DataFrame:
    """Every session that an action names, with ``_alive``, the last clear and what opened it."""
    at = lambda name, value: F.max(F.when(F.col("action") == name, F.col(value)))
    state = actions.groupBy(*_SESSION).agg(
        at("new", "seq").alias("_made"),
        at("delete", "seq").alias("_gone"),
        at("clear", "seq").alias("cleared_seq"),
        *([at("new", "ts").alias("_opened")] if "ts" in actions.columns else []),
        F.max_by("title", F.when(F.col("action") == "new", F.col("seq"))).alias("title"),
    )
    return state.withColumn("_alive", _alive(F.col("sid"), F.col("_made"), F.col("_gone")))


def session_state(actions: DataFrame) -> DataFrame:
    """Sessions that exist after all actions, with the last clear (null = never); every user has the default session."""
    users = actions.select("user_id").distinct().withColumn("sid", F.lit(fixed.DEFAULT_SESSION))
    known = _states(actions).filter("_alive").select(*_SESSION, "cleared_seq", "title")
    return known.unionByName(users.join(known, _SESSION, "left_anti"), allowMissingColumns=True)


def current_sessions(actions: DataFrame, block: Column | None = None) -> DataFrame:
    """Current session per user: the last valid new/switch, or default when it was deleted since.

    Switching to an unknown session changes nothing; the default session cannot be deleted.
    """
    seen = _latest(actions, block)
    valid = seen.filter(
        (F.col("action") == "new")
        | ((F.col("action") == "switch") & _alive(F.col("sid"), F.col("_made"), F.col("_gone")))
    )
    last = valid.groupBy("user_id").agg(F.max_by("sid", "seq").alias("sid"), F.max("seq").alias("_at"))
    gone = actions.filter((F.col("action") == "delete") & (F.col("sid") != fixed.DEFAULT_SESSION)).groupBy(*_SESSION).agg(
        F.max("seq").alias("_gone_at")
    )
    users = actions.select("user_id").distinct()
    picked = last.join(gone, _SESSION, "left").withColumn(
        "sid", F.when(F.col("_gone_at") > F.col("_at"), F.lit(fixed.DEFAULT_SESSION)).otherwise(F.col("sid"))
    )
    return users.join(picked.select("user_id", "sid"), "user_id", "left").select(
        "user_id", F.coalesce("sid", F.lit(fixed.DEFAULT_SESSION)).alias("current_session")
    )
