"""Exact top-k by inner product with block-at-a-time pruning.

Components are the terms, their integers floor(256 * x) the weights.  Rows are
put in an order that keeps similar rows together and cut into document ranges
of ``RANGE`` rows.  Each range has a forward index (its rows' weights) and, per
term, the largest and the smallest weight; for a query, the sum over its terms
of weight times the better extreme bounds every score in the range.

First each query is scored in the range it lives in, which gives a score that
its k-th best cannot fall below.  Then blocks of queries meet super-ranges of
rows: for each query the ranges are visited by falling bound, a range at a
time through its forward index, until the bounds fall below the k-th best.
Results of the super-ranges are merged by a salted top-k.

Scale: queries are a stated fraction of the rows, so queries against rows is
the work asked for; it is done in tasks of ``QUERIES`` queries by ``SUPER``
rows, whose number, and with it the shuffle, shrinks with both sizes.  No
table is broadcast but ``PIVOTS`` rows that only set the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import renamed_apart
from cardloom.scale import top_per_key
from cardloom.session import checkpointed

K = 5
EVERY = 50
RANGE = 128
SUPER = 8192
QUERIES = 1024
PIVOTS = 64
_NONE = np.iinfo(np.int64).min


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) with v = floor(256 * x) as longs; rows with null vectors or null or non-finite components are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    infinite = F.lit(float("inf"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != infinite))
    return (
        embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
        .filter(F.col("x").isNotNull() & fine)
        .select("vec_id", F.transform("x", lambda e: F.floor(e * 256).cast("bigint")).alias("v"))
    )


def _matrix(rows: list, width: int) -> np.ndarray:
    """Rows as one matrix; shorter rows are filled with zeros, which add nothing to a score."""
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer product; in floating point where no sum can leave its exact integers."""
    high = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if high < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Ranges:
    """Document ranges of one super-range with their forward indexes and term extremes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.cuts = [(a, min(a + RANGE, len(ids))) for a in range(0, len(ids), RANGE)]
        starts = [a for a, _ in self.cuts]
        self.high = np.maximum.reduceat(rows, starts, axis=0)
        self.low = np.minimum.reduceat(rows, starts, axis=0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of every query's scores in every range."""
        return _product(np.maximum(queries, 0), self.high) + _product(np.minimum(queries, 0), self.low)

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        """(query rows, doc ids, scores) of the k best of each query; none that is sure to be below ``floor``.

        ``floor`` is a score that each query's k-th best overall reaches;
        equal scores are still looked at, since the smaller id wins a tie.
        Also returns the number of ranges scored.
        """
        n = len(queries)
        best = np.full((n, k), _NONE)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(n)
        scored = 0
        for step in range(len(self.cuts)):
            at = order[active, step]
            least = np.maximum(floor[active], best[active, k - 1])
            active = active[bounds[active, at] >= least]
            if not len(active):
                break
            at = order[active, step]
            for range_ in np.unique(at):
                rows = active[at == range_]
                a, b = self.cuts[range_]
                scores = _product(queries[rows], self.rows[a:b])
                scored += len(rows)
                own = self.ids[a:b][None, :] == ids[rows][:, None]
                names = np.broadcast_to(self.ids[a:b], scores.shape)
                all_scores = np.concatenate([best[rows], np.where(own, _NONE, scores)], axis=1)
                all_ids = np.concatenate([best_id[rows], np.where(own, np.iinfo(np.int64).max, names)], axis=1)
                rank = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
                best[rows] = np.take_along_axis(all_scores, rank, 1)
                best_id[rows] = np.take_along_axis(all_ids, rank, 1)
        row, col = np.nonzero((best_id != np.iinfo(np.int64).max) & (best >= floor[:, None]))
        return row, best_id[row, col], best[row, col], scored


def _placed(rows: DataFrame) -> DataFrame:
    """(place, vec_id, v): super-range number of every row, in the order of the nearest of a few sampled rows."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toPandas()["v"].tolist()
    width = max(map(len, sample), default=0)
    pivots = spark.sparkContext.broadcast(_matrix(sample, width).astype(np.float64))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        for batch in batches:
            v = [r[:width] for r in batch.column("v").to_pylist()]
            points = _matrix(v, width).astype(np.float64)
            away = (centres * centres).sum(axis=1) - 2 * points @ centres.T if width else np.zeros((len(v), max(1, len(centres))))
            cell = away.argmin(axis=1) if away.shape[1] else np.zeros(len(v), int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32())], ["vec_id", "v", "cell"]
            )

    celled = rows.mapInArrow(near, "vec_id bigint, v array<bigint>, cell int")
    ordered = checkpointed(celled.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"))
    number = F.monotonically_increasing_id()
    part, inside = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("_n", number).select(
        (part * (1 << 20) + F.floor(inside / SUPER)).alias("place"), inside.alias("at"), "vec_id", "v"
    )


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row whose id is divisible by ``every``.

    Ties go to the smaller vec_id.  Rows with vectors that are null or hold
    null or non-finite components take no part, nor do rows with a null id.
    A row is no candidate for a query of the same id.  A repeated row is a
    candidate each time it comes, and as a query it is asked once.  A vector
    that is shorter than another counts as zero where it ends, an empty one as
    all zeros; components beyond the range of a long stop at its ends.  Empty
    tables and lone rows give no rows; other columns are not read.
    """
    rows = _placed(integers(embeddings).filter("vec_id IS NOT NULL"))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)

    def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from (_seeds(own, k, every) for _, own in frame.groupby(frame["at"] // RANGE))

    floors = rows.select("at", "vec_id", "v").mapInPandas(seed, "vec_id bigint, floor bigint")
    queries = (
        asked.groupBy("vec_id")
        .agg(F.first("v").alias("v"), F.min("place").alias("place"))
        .join(floors.groupBy("vec_id").agg(F.max("floor").alias("floor")), "vec_id", "left")
    )
    queries = checkpointed(queries)
    n_groups = max(1, -(-queries.count() // QUERIES))
    places = rows.groupBy("place").agg(F.count("*").alias("n")).select("place")
    grouped = queries.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int"))
    # a block of queries is packed into one row before it is handed to every super-range
    packed = grouped.groupBy("group").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("asked"))
    asking = (
        places.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        .join(packed, "group")
        .select("place", "group", "asked")
    )
    held = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).select("place", "group", "at", "vec_id", "v")

    def search(queries_: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries_) or not len(members):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        members = members.sort_values("at", ignore_index=True)
        own = [q for asked_ in queries_["asked"] for q in asked_]
        width = max(max(map(len, members["v"])), max(len(q["v"]) for q in own))
        ids = np.array([q["vec_id"] for q in own], np.int64)
        floor = np.array([_NONE if q["floor"] is None else q["floor"] for q in own], np.int64)
        ranges = Ranges(members["vec_id"].to_numpy(np.int64), _matrix(members["v"].tolist(), width))
        row, found, score, _ = ranges.search(ids, _matrix([q["v"] for q in own], width), floor, k)
        return pd.DataFrame({"query_id": ids[row], "vec_id": found, "score": score})

    hits = (
        asking.groupBy("place", "group")
        .cogroup(renamed_apart(held).groupBy("place", "group"))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    )
    ranked = top_per_key(hits, ["query_id"], [F.desc("score"), F.col("vec_id")], k, salt=F.col("vec_id"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _seeds(own: pd.DataFrame, k: int, every: int) -> pd.DataFrame:
    """k-th best score of each query among the other rows of its own range; queries with fewer rows there are left out."""
    ids = own["vec_id"].to_numpy(np.int64)
    asked = np.flatnonzero(ids % every == 0)
    if not len(asked) or len(ids) <= k:
        return pd.DataFrame({"vec_id": [], "floor": []}, dtype="int64")
    rows = _matrix(own["v"].tolist(), max(map(len, own["v"])))
    scores = _product(rows[asked], rows)
    same = ids[asked][:, None] == ids[None, :]
    scores[same] = _NONE
    floor = -np.partition(~scores, k - 1, axis=1)[:, k - 1] - 1
    full = (~same).sum(axis=1) >= k
    return pd.DataFrame({"vec_id": ids[asked][full], "floor": floor[full]})
