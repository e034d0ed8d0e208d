"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a longest run of characters other than space and the ASCII controls 9 to 13."""
ROWS_AT_ONCE = 500
"""Rows of an Arrow batch that are worked on, and passed on, at once."""
ROWS_A_TASK = 100_000
"""Rows of a few numbers that are worth a task of their own."""
TASKS = 16
"""Tasks that any table may have, however small."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into the fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def hash_order(doc_id: Column) -> Column:
    """A shuffle order that any engine can compute: the md5 of the id as text."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of ``ROWS_AT_ONCE``; behind the last one, memory goes back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)
    release()


def release() -> None:
    """Give memory that nothing holds any more back to the system: workers outlive their tasks, and wait through stages without Python."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def fewer(df: DataFrame, rows: int | None, a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` in no more tasks than ``rows`` rows are worth; it never has more than before.

    Each task of a shuffle and each part of a checkpoint leaves files, however
    few rows it has, and rounds over small tables leave little else.  Rows stay
    dealt by their keys as they were, only some parts share a task.  Where the
    number of rows is not known (None), nothing changes.
    """
    return df if rows is None else df.coalesce(max(TASKS, -(-rows // a_task)))


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that stays with the executors.

    In rounds over small tables an adaptive join would fetch this side to the
    driver, which builds a broadcast of it, and then read the other side's
    shuffle, which is written by then, in a task for every part.
    """
    return df.hint("merge")


def renamed_apart(df: DataFrame) -> DataFrame:
    """The same columns as new attributes, for a co-group of two tables that come from one."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
