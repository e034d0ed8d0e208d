"""Preference pairs as a prompt and two masked completions.

The turns of the chosen and the rejected conversation are compared from the
start; the longest run of turns with equal role and text is rendered once, as
the prompt.  What follows on either side is rendered as its completion, with
the spans that a loss may look at: the texts and end marks of assistant turns.

Everything is SQL functions on arrays: one shuffle brings the turns of a pair
together, a row never holds more than one pair, and nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def _rendered(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), t["role"], F.lit(BREAK), t["text"], F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def _spans(turns: Column) -> Column:
    """(start, end) character offsets of trained text in the rendered turns, end mark included."""
    head = lambda t: F.length(F.concat(F.lit(START), t["role"], F.lit(BREAK)))
    body = lambda t: F.length(F.concat(t["text"], F.lit(END)))
    empty = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + head(t)
        end = start + body(t)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(t["role"] == TRAINED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, empty, step)["spans"]


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans) from (pair_id, side, turn, role, text).

    ``side`` is ``chosen`` or ``rejected``; other sides are left out.  Turns
    go by ``turn``, null first, then role and text; repeated rows are repeated
    turns.  Null roles and texts count as empty.  A pair without one side has
    an empty completion there and no common prompt; equal sides are all prompt
    and both completions are empty.  Rows with a null pair_id are one pair.
    Texts are taken whole; an empty table gives an empty table.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, turn)), _by_turn)
    pairs = (
        turns.filter(F.col("side").isin("chosen", "rejected"))
        .groupBy("pair_id")
        .agg(side("chosen").alias("c"), side("rejected").alias("r"))
    )
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.zip_with(
        F.slice("c", F.lit(1), shorter),
        F.slice("r", F.lit(1), shorter),
        lambda a, b: ~((a["role"] == b["role"]) & (a["text"] == b["text"])),
    )
    first = F.array_position(differs, True)
    same = F.when(first > 0, first.cast("int") - 1).otherwise(shorter)
    rest = lambda name: F.slice(name, F.col("same") + 1, F.greatest(F.size(name) - F.col("same"), F.lit(0)))
    cut = pairs.withColumn("same", same).select(
        "pair_id", F.slice("c", F.lit(1), F.col("same")).alias("p"), rest("c").alias("c"), rest("r").alias("r")
    )
    return cut.select(
        "pair_id",
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"),
        _spans(F.col("r")).alias("rejected_spans"),
    )


def _by_turn(a: Column, b: Column) -> Column:
    """Order of two turns: turn, null first, then role, then text."""
    less = F.lit(False)
    more = F.lit(False)
    for name in ("text", "role"):
        less = (a[name] < b[name]) | ((a[name] == b[name]) & less)
        more = (a[name] > b[name]) | ((a[name] == b[name]) & more)
    x, y = (F.coalesce(t["turn"].cast("bigint"), F.lit(-(1 << 63))) for t in (a, b))
    less = (x < y) | ((x == y) & less)
    more = (x > y) | ((x == y) & more)
    return F.when(less, -1).when(more, 1).otherwise(0)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs out of plain conversations, as (pair_id, side, turn, role, text).

    Chosen is a conversation up to its last assistant turn; rejected is the
    same with the words of that last reply in reverse order.  Conversations
    without an assistant turn give no pair.
    """
    last = conversations.filter(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max("turn").alias("last"))
    said = conversations.select("conv_id", "turn", "role", "text").join(last, "conv_id").filter(F.col("turn") <= F.col("last"))
    reply = (F.col("role") == TRAINED) & (F.col("turn") == F.col("last"))
    backwards = F.array_join(F.reverse(F.split("text", " ")), " ")
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
        F.struct(F.lit("rejected").alias("side"), F.when(reply, backwards).otherwise(F.col("text")).alias("text")),
    )
    return said.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select(
        "pair_id", "s.side", "turn", "role", "s.text"
    )
