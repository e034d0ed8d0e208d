"""The stored inverted index of the lexical channel: posting lists with a largest and a smallest weight per block.

Cards that can be lexical hits are ordered by course, boost and length of
their token vector, and cut into ranges of ``RANGE`` and blocks of ``BLOCK``
neighbours.  A term is a keyword token, or ``#i`` for cell i of the hashed
token vector.  A row of the index is the posting list of a term in a range: the
cards that hold it with their counts, and the blocks that hold it with the
largest and smallest normalised weight in each.  Rows are partitioned by
course and by a bucket of the term, so a search opens the buckets of its own
terms, and inside them only their row groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import retrieval as rt
from cardloom.scale import ranked

RANGE = 4096
"""Cards of a range; a task of a search holds the asked posting lists of one range."""
BLOCK = 8
"""Cards of a block, which a search reads or leaves as a whole."""

_POSTINGS = (
    "course string, range bigint, term string, cards array<int>, counts array<int>, "
    "blocks array<int>, high array<double>, low array<double>"
)


def cell_term(cell: int) -> str:
    """Term of a cell of the token vector; tokens hold no such character."""
    return f"#{cell}"


def term_bucket(term: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class PostingTable:
    """Index of a card collection below ``path``, built whole."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def rebuild(self, cards: DataFrame) -> None:
        """Index of ``cards``, as card columns or as rows of a stored vector table.  Cards without a course are left out."""
        rows = cards if rt.is_counted(cards) else rt.counted_cards(cards)
        usable = rows.filter("course IS NOT NULL AND NOT reference_only").select(
            "course",
            "card_id",
            "ord",
            "boosted",
            "keyword_tokens",
            "lexical_counts",
            F.aggregate("lexical_counts", F.lit(0).cast("bigint"), lambda a, w: a + w.cast("bigint") * w).alias("square"),
        )
        order = F.struct("course", ~F.col("boosted"), "square", "ord", "card_id")
        placed = ranked(usable.withColumn("order", order), "order", "place").select(
            "course",
            F.floor(F.col("place") / RANGE).alias("range"),
            F.pmod("place", F.lit(RANGE)).cast("int").alias("at"),
            "card_id",
            "ord",
            "boosted",
            F.when(F.col("square") == 0, 1.0).otherwise(F.sqrt(F.col("square").cast("double"))).alias("norm"),
            "keyword_tokens",
            "lexical_counts",
        )
        held = F.array_sort(F.collect_list(F.struct("at", "ord", "card_id", "boosted", "norm")))
        placed.groupBy("course", "range").agg(held.alias("held")).write.mode("overwrite").partitionBy("course").parquet(f"{self.path}/ranges")
        (
            placed.groupBy("course", "range")
            .applyInPandas(_posting_rows, _POSTINGS)
            .withColumn("bucket", term_bucket(F.col("term"), self.buckets))
            .repartitionByRange("course", "bucket", "term")
            .sortWithinPartitions("course", "bucket", "term")
            .write.mode("overwrite")
            .partitionBy("course", "bucket")
            .parquet(f"{self.path}/postings")
        )

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{self.path}/postings")

    def ranges(self) -> DataFrame:
        held = "held array<struct<at:int,ord:bigint,card_id:string,boosted:boolean,norm:double>>"
        return self.spark.read.schema(f"range bigint, {held}, course string").parquet(f"{self.path}/ranges")


def _posting_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """All posting lists of one range, of at most ``RANGE`` cards."""
    pdf = pdf.sort_values("at", kind="stable")
    at, counts = pdf["at"].to_numpy(np.int64), np.stack(pdf["lexical_counts"].to_list()).astype(np.int64)
    weights = counts / pdf["norm"].to_numpy()[:, None]
    first = np.flatnonzero(np.r_[True, np.diff(at // BLOCK) > 0])
    blocks = at[first] // BLOCK
    high, low = np.maximum.reduceat(weights, first), np.minimum.reduceat(weights, first)
    out = []
    for cell in range(counts.shape[1]):
        here = np.flatnonzero(counts[:, cell])
        if len(here):
            some = np.flatnonzero((high[:, cell] != 0) | (low[:, cell] != 0))
            out.append((cell_term(cell), at[here], counts[here, cell], blocks[some], high[some, cell], low[some, cell]))
    holders: dict[str, list[int]] = {}
    for card, tokens in zip(at, pdf["keyword_tokens"]):
        for token in tokens:
            holders.setdefault(token, []).append(card)
    for token, cards in holders.items():
        some = np.unique(np.array(cards) // BLOCK)
        out.append((token, cards, [1] * len(cards), some, np.ones(len(some)), np.zeros(len(some))))
    frame = pd.DataFrame(out, columns=["term", "cards", "counts", "blocks", "high", "low"])
    frame.insert(0, "range", pdf["range"].iloc[0])
    frame.insert(0, "course", pdf["course"].iloc[0])
    return frame
