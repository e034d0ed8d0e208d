"""Replies put together from the fragments that a model streams.

An event is one fragment: a piece of text, or a piece of the tool call with a
given index, whose name and arguments may both come in several pieces.  The
last event of a reply says so.  Pieces are joined in arrival order, which is
the order of ``seq`` and has no gaps within a reply.  A reply with tool calls
is those calls; text that came along with them is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = "reply string, seq bigint, text string, call_index int, call_id string, name string, arguments string, done boolean"
CALLS = "array<struct<call_index:int,call_id:string,name:string,arguments:string>>"
REPLY = f"reply string, kind string, text string, calls {CALLS}"
TEXT, TOOL_CALLS = "text", "tool_calls"
BLOCK = 1000
"""Fragments that are joined at once, before the joined blocks are; a very long reply is spread over its blocks."""


def _joined(piece: str, by: str) -> Column:
    """Pieces in the order of ``by``."""
    pieces = F.array_sort(F.collect_list(F.when(F.col(piece) != "", F.struct(F.col(by).alias("at"), F.col(piece).alias("piece")))))
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")


def _last(value: str, by: str) -> Column:
    return F.max_by(value, F.when(F.col(value) != "", F.col(by)))


def assembled(events: DataFrame) -> DataFrame:
    """(reply, kind, text, calls) of every reply whose last event and all before it are there.

    ``events`` hold a (reply, seq) once.  Null pieces are empty.  A call without an id has the empty one; of several ids the last counts.
    """
    block = F.floor(F.col("seq") / BLOCK)
    held = events.withColumn("block", block).groupBy("reply", "call_index", "block").agg(
        _joined("text", "seq").alias("text"),
        _joined("name", "seq").alias("name"),
        _joined("arguments", "seq").alias("arguments"),
        _last("call_id", "seq").alias("call_id"),
        F.count("*").alias("n"),
        F.max(F.when(F.col("done"), F.col("seq"))).alias("end"),
    )
    parts = held.groupBy("reply", "call_index").agg(
        _joined("text", "block").alias("text"),
        _joined("name", "block").alias("name"),
        _joined("arguments", "block").alias("arguments"),
        F.coalesce(_last("call_id", "block"), F.lit("")).alias("call_id"),
        F.sum("n").alias("n"),
        F.max("end").alias("end"),
    )
    call = F.when(F.col("call_index").isNotNull(), F.struct("call_index", "call_id", "name", "arguments"))
    whole = parts.groupBy("reply").agg(
        F.coalesce(F.max(F.when(F.col("call_index").isNull(), F.col("text"))), F.lit("")).alias("text"),
        F.array_sort(F.collect_list(call)).alias("calls"),
        F.sum("n").alias("n"),
        F.max("end").alias("end"),
    )
    called = F.size("calls") > 0
    return whole.filter(F.col("n") == F.col("end") + 1).select(
        "reply",
        F.when(called, TOOL_CALLS).otherwise(TEXT).alias("kind"),
        F.when(called, "").otherwise(F.col("text")).alias("text"),
        F.col("calls").cast(CALLS).alias("calls"),
    )
