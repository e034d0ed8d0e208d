"""Review answers as a stream: every answer moves its card's box at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cardloom import fixed_values as fixed

_OUT = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("box", T.IntegerType()),
    ]
)
_STATE = T.StructType([T.StructField("box", T.IntegerType())])


def _move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    box = state.get[0] if state.exists else 1
    answers = pd.concat(list(batches)).sort_values(["ts", "seq"])
    boxes = []
    for ok in answers["ok"]:
        box = min(box + 1, fixed.TOP_BOX) if ok else 1
        boxes.append(box)
    state.update((box,))
    yield pd.DataFrame(
        {"user_id": key[0], "card_id": key[1], "seq": answers["seq"], "ok": answers["ok"], "box": boxes}
    )


def box_stream(reviews: DataFrame) -> DataFrame:
    """``reviews``: user_id, card_id, ok, ts, seq.  State per (user, card) is one box number.

    Answers of one card are ordered inside each micro-batch; bound its size at
    the source (``maxFilesPerTrigger`` or the like).
    """
    keyed = reviews.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("card_id").cast("string").alias("card_id"), "ok", "ts", "seq"
    )
    return keyed.groupBy("user_id", "card_id").applyInPandasWithState(
        _move, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )
