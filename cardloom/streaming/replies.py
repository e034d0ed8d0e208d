"""Streamed fragments as whole replies: each reply comes out once, when its last missing fragment is there."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cardloom.operators import replies

_STATE = "next bigint, end bigint, text array<string>, calls string, early string"
_PIECES = ("text", "call_index", "call_id", "name", "arguments")


def _fold(event: dict, text: list[str], calls: dict[str, list]) -> None:
    index = event["call_index"]
    if index is None:
        if event["text"]:
            text.append(event["text"])
        return
    call = calls.setdefault(str(index), ["", [], []])
    call[0] = event["call_id"] or call[0]
    for kind, at in (("name", 1), ("arguments", 2)):
        if event[kind]:
            call[at].append(event[kind])


def _put_together(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    following, end, text, calls, early = (0, -1, [], {}, {})
    if state.exists:
        following, end, text, *rest = state.get
        text, (calls, early) = list(text), map(json.loads, rest)
    for frame in frames:
        for event in frame.astype(object).where(frame.notna(), None).to_dict("records"):
            if event["seq"] >= following:
                index = event["call_index"]
                early[str(event["seq"])] = {p: event[p] for p in _PIECES} | {"call_index": None if index is None else int(index)}
                end = event["seq"] if event["done"] else end
        while str(following) in early:  # in arrival order, whatever the order of the rows
            _fold(early.pop(str(following)), text, calls)
            following += 1
    if end >= 0 and following > end:
        state.remove()
        joined = [
            {"call_index": i, "call_id": calls[str(i)][0], "name": "".join(calls[str(i)][1]), "arguments": "".join(calls[str(i)][2])}
            for i in sorted(map(int, calls))
        ]
        kind = replies.TOOL_CALLS if joined else replies.TEXT
        yield pd.DataFrame({"reply": [key[0]], "kind": [kind], "text": ["" if joined else "".join(text)], "calls": [joined]})
    else:
        state.update((following, end, text, json.dumps(calls), json.dumps(early)))


def reply_stream(events: DataFrame) -> DataFrame:
    """The rows of ``replies.assembled`` over a stream of its events.

    State per reply is what it has so far and the fragments that came early; it
    goes with the reply.  A fragment that comes twice before its reply is out counts once.
    """
    columns = [c.split()[0] for c in replies.EVENTS.split(", ")]
    keyed = events.select(F.col("reply").cast("string").alias("reply"), *columns[1:])
    return keyed.groupBy("reply").applyInPandasWithState(_put_together, replies.REPLY, _STATE, "append", GroupStateTimeout.NoTimeout)
