"""How filters interact: what each removes at every place of every order.

Every document becomes a set of bits, one per filter it fails.  All that any
order of the filters does can be read off the number of documents per set of
bits, so the corpus is read once, and the orders are worked out on at most 32
rows per part.  Whether a text stands elsewhere under a smaller id is found by
``tries``; see there for how the work is dealt out.
"""

from __future__ import annotations

import json
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.tries import with_least_id

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
_SIGNS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_DUPLICATE = 1 << FILTERS.index("E")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, bit i for letter i."""
    words = text.split()  # bytes split at space and 9 to 13
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words),
        100 * capitals > MOST_CAPITALS_PERCENT * points,
        _SIGNS.search(text) is not None,
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def _described(text: bytes) -> tuple[int]:
    return (failures(text),)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails) of every row: the part is its language, and ``fails`` has one bit per filter it fails."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    )
    found = with_least_id(rows, {"fails": pa.int32()}, _described, "fails int")
    copy = F.when(F.col("doc_id") > F.col("least"), _DUPLICATE).otherwise(0)
    return found.select("doc_id", "part", F.col("fails").bitwiseOR(copy).alias("fails"))


def steps() -> list[dict]:
    """Each step of each order: the filter's bit and the bits of the filters before it."""
    bit = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    return [
        {"filter_order": "".join(order), "step": i + 1, "bit": bit[letter], "before": sum(bit[b] for b in order[:i])}
        for order in permutations(FILTERS)
        for i, letter in enumerate(order)
    ]


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, with the counts of documents and ``shapley``.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic.
    A null text is empty, a null language the part of the empty string.  A
    row without an id is nobody's copy and makes no row a copy; rows with
    the same id and text are not copies of each other.  Repeated rows count
    as often as they stand there.  A document with several labels counts as
    good or toxic if one of them says so; without a label it is neither.  An
    empty ``docs`` gives an empty table.  Other columns are not read.
    """
    marked = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    )
    n_if = lambda c: F.count(F.when(F.col(c), 1))
    counts = (
        masks(docs)
        .join(marked, "doc_id", "left")
        .groupBy("part", "fails")
        .agg(F.count("*").alias("n"), n_if("good").alias("n_good"), n_if("bad").alias("n_bad"))
    )
    plan = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order string, step int, bit int, before int>>")
    each = counts.withColumn("s", F.explode(plan)).select("*", "s.*")
    fails, bit, before = F.col("fails"), F.col("bit"), F.col("before")
    failed = fails.bitwiseAND(bit) != 0
    gone = fails.bitwiseAND(before) != 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0))
    return (
        each.groupBy("part", "filter_order", "step", "bit")
        .agg(
            total(~failed & ~gone).alias("kept"),
            total(failed & ~gone).alias("removed"),
            total(failed & gone).alias("redundant"),
            total(fails == bit).alias("unique_fails"),
            total(failed & ~gone, "n_good").alias("good_lost"),
            total(failed & ~gone, "n_bad").alias("toxic_lost"),
        )
        .withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
        .drop("bit")
    )
