"""Top-k over stored indexes.

Vectors: the lists nearest to a question are opened, and their cards are
scored exactly; with all lists the rows are those of ``vector_topk``.

Lexical: blocks are visited by falling bound until none can enter.

What a block can score at most follows from its largest and smallest weights:
every asked keyword token it holds counts as a hit, every cell of the question
vector meets the weight of its own sign, and no cosine exceeds one.  The exact
score is worked out for the cards of a visited block only.  The visit ends
before the first block whose bound is below the k-th score so far; blocks at
that score are still read, since equal scores follow the card order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions import text as tx
from cardloom.functions import vectors as vec
from cardloom.operators import retrieval as rt
from cardloom.scale import slices, top_per_key
from cardloom.session import checkpointed
from cardloom.sources.coarse import NO_LIST, CoarseIndex, centroid_lots, unit
from cardloom.sources.postings import BLOCK, PostingTable, cell_term, term_bucket

BLOCKS_AT_ONCE = 4
SLACK = 1e-9
"""Added to bounds, for the rounding of their sums."""
MAX_PRUNED_BUCKETS = 64


class _Range:
    """Asked posting lists of one range, as columns over its cards and blocks."""

    def __init__(self, held: list, postings: pd.DataFrame) -> None:
        self.at = np.array([h["at"] for h in held])
        self.ords = np.array([h["ord"] for h in held])
        self.ids = np.array([h["card_id"] for h in held], dtype=object)
        self.norms = np.array([h["norm"] for h in held])
        self.boost = np.where([h["boosted"] for h in held], fixed.KIND_BOOST, 0.0)
        self.first = np.flatnonzero(np.r_[True, np.diff(self.at // BLOCK) > 0])
        self.stop = np.r_[self.first[1:], len(self.at)]
        self.blocks = self.at[self.first] // BLOCK
        self.block_boost = np.maximum.reduceat(self.boost, self.first)
        cells = [r for r in postings.itertuples() if r.term.startswith("#")]
        self.cells = np.array([int(r.term[1:]) for r in cells], dtype=np.int64)
        self.counts = np.zeros((len(self.at), len(cells)))
        self.high, self.low = np.zeros((len(self.blocks), len(cells))), np.zeros((len(self.blocks), len(cells)))
        for i, r in enumerate(cells):
            self.counts[np.searchsorted(self.at, r.cards), i] = r.counts
            where = np.searchsorted(self.blocks, r.blocks)
            self.high[where, i], self.low[where, i] = r.high, r.low
        self.tokens = {r.term: r for r in postings.itertuples() if not r.term.startswith("#")}

    def bounds(self, vector: np.ndarray, norm: float, found: list, distinct: int) -> np.ndarray:
        """Most that a card of each block can score."""
        near = np.minimum(1.0, (self.high @ np.maximum(vector, 0) + self.low @ np.minimum(vector, 0)) / norm)
        hits = np.zeros(len(self.blocks))
        for r in found:
            hits[np.searchsorted(self.blocks, r.blocks)] += 1
        return fixed.KEYWORD_WEIGHT * hits / distinct + fixed.COSINE_WEIGHT * near + self.block_boost + SLACK

    def best(self, vector: np.ndarray, norm: float, tokens: set[str], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(cards, scores) of the k best, by score and card order, and the number of blocks read."""
        vector, found = vector[self.cells], [self.tokens[t] for t in tokens if t in self.tokens]
        bounds = self.bounds(vector, norm, found, len(tokens))
        hits = np.zeros(len(self.at))
        for r in found:
            hits[np.searchsorted(self.at, r.cards)] += 1
        cards, scores, read = np.array([], dtype=np.int64), np.array([]), 0
        order = np.argsort(-bounds, kind="stable")
        for start in range(0, len(order), BLOCKS_AT_ONCE):
            if len(scores) == k and bounds[order[start]] < scores[-1]:
                break
            lot = order[start : start + BLOCKS_AT_ONCE]
            if len(scores) == k:
                lot = lot[bounds[lot] >= scores[-1]]
            read += len(lot)
            new = np.concatenate([np.arange(self.first[b], self.stop[b]) for b in lot])
            score = (
                fixed.KEYWORD_WEIGHT * (hits[new] / len(tokens))
                + fixed.COSINE_WEIGHT * (self.counts[new] @ vector / (self.norms[new] * norm))
                + self.boost[new]
            )
            cards, scores = np.r_[cards, new[score > 0]], np.r_[scores, score[score > 0]]
            top = np.lexsort((self.ords[cards], -scores))[:k]
            cards, scores = cards[top], scores[top]
        return cards, scores, read


def _asked_terms(questions: DataFrame, buckets: int) -> DataFrame:
    """(course, term, bucket) that the questions need."""
    found = tx.tokens(F.col("question"))
    cell = F.concat(F.lit(cell_term("")), vec.token_bucket(vec.token_hash(F.col("token"))).cast("string"))
    tokens = questions.select("course", F.explode(found).alias("token"))
    both = tokens.select("course", F.explode(F.array(F.col("token"), cell)).alias("term")).distinct()
    return both.withColumn("bucket", term_bucket(F.col("term"), buckets))


def _searched(questions: DataFrame, table: PostingTable, k: int) -> DataFrame:
    """k best rows per question and range, and one row without a card that tells blocks read and held."""
    asked = checkpointed(questions.filter("course IS NOT NULL").select("qid", "course", "question"))
    terms = checkpointed(_asked_terms(asked, table.buckets))
    by_course: dict[str, list] = {}
    for r in asked.collect():  # the caller has measured them
        by_course.setdefault(r["course"], []).append((r["qid"], r["question"] or ""))
    shared = questions.sparkSession.sparkContext.broadcast(by_course)
    postings, ranges = table.postings(), table.ranges()
    if len(by_course) <= rt.MAX_PRUNED_COURSES:
        postings, ranges = (f.filter(F.col("course").isin(*by_course)) for f in (postings, ranges))
    opened = [r["bucket"] for r in terms.select("bucket").distinct().limit(MAX_PRUNED_BUCKETS + 1).collect()]
    if len(opened) <= MAX_PRUNED_BUCKETS:
        postings = postings.filter(F.col("bucket").isin(*opened))
    wanted = postings.join(F.broadcast(terms), ["course", "bucket", "term"], "left_semi").drop("bucket")
    kind = questions.schema["qid"].dataType.simpleString()
    columns = ["qid", "course", "range", "card_id", "ord", "score", "read", "held"]

    def search(lists: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            course, number = held["course"].iloc[0], held["range"].iloc[0]
            own, codes = _Range(held["held"].iloc[0], lists), vec.TokenCodes()
            pairs = shared.value.get(course, [])
            vectors = vec.count_matrix([q for _, q in pairs], codes)
            for (qid, question), vector, norm in zip(pairs, vectors, vec.norms(vectors)):
                tokens = set(vec.token_list(question))
                if tokens:
                    cards, scores, read = own.best(vector, norm, tokens, k)
                    out += [(qid, course, number, own.ids[c], own.ords[c], s, None, None) for c, s in zip(cards, scores)]
                    out.append((qid, course, number, None, None, None, read, len(own.blocks)))
        return pd.DataFrame(out, columns=columns)

    keys = ["course", "range"]
    return (
        wanted.groupBy(*keys)
        .cogroup(ranges.groupBy(*keys))
        .applyInPandas(search, f"qid {kind}, course string, range bigint, card_id string, ord bigint, score double, read bigint, held bigint")
    )


def _lots(questions: DataFrame) -> Iterator[DataFrame]:
    """The questions, in lots that can be broadcast each."""
    size = questions.agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("chars")).first()
    lots = -(-max(size["n"], (size["chars"] or 0) * rt.MAX_BROADCAST_QUESTIONS // rt.MAX_BROADCAST_CHARS) * 2 // rt.MAX_BROADCAST_QUESTIONS)
    if rt.questions_fit(questions):
        lots = 1
    for lot in range(lots):
        yield questions if lots == 1 else questions.filter(F.pmod(F.xxhash64("qid"), F.lit(lots)) == lot)


def lexical_topk_indexed(questions: DataFrame, table: PostingTable, k: int) -> DataFrame:
    """The rows of ``lexical_topk``, from posting lists.

    ``questions``: qid, course, question.  Questions without a token or a
    course find nothing; an empty index gives no rows.  Cards with equal
    scores keep the card order.
    """
    found = None
    for lot in _lots(questions):
        rows = _searched(lot, table, k).filter("card_id IS NOT NULL").drop("read", "held", "range")
        found = rows if found is None else found.unionByName(rows)
    best = top_per_key(found, ["qid"], [F.desc("score"), F.asc("ord")], k, salt=F.col("card_id"))
    return best.select("qid", "course", "rank", "card_id", "ord", "score")


def blocks_read(questions: DataFrame, table: PostingTable, k: int) -> DataFrame:
    """(qid, read, held): blocks whose cards were scored, and blocks of the question's course."""
    rows = None
    for lot in _lots(questions):
        found = _searched(lot, table, k).filter("card_id IS NULL").select("qid", "read", "held")
        rows = found if rows is None else rows.unionByName(found)
    return rows.groupBy("qid").agg(F.sum("read").alias("read"), F.sum("held").alias("held"))


# ---- vectors ----------------------------------------------------------------

MAX_PRUNED_LISTS = 5_000


def _opened(by_course: dict[str, list], index: CoarseIndex, probes: int) -> dict[tuple[str, int], np.ndarray | None]:
    """Places, among the questions of a course, of those that open a (course, list); None for all of them."""
    opened: dict[tuple[str, int], np.ndarray | None] = {(course, NO_LIST): None for course in by_course}
    codes = vec.TokenCodes()
    for lot in centroid_lots(index.centroids().filter(F.col("course").isin(*by_course))):
        for course, centres in lot.items():
            pairs = by_course[course]
            if probes >= len(centres):
                opened |= {(course, number): None for number in range(len(centres))}
                continue
            near = unit(vec.count_matrix([q for _, q in pairs], codes)) @ centres.T
            lists = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            order = np.argsort(lists, axis=None, kind="stable")
            numbers, first = np.unique(lists.ravel()[order], return_index=True)
            places = np.split((order // lists.shape[1]).astype(np.int32), first[1:])
            opened |= {(course, int(number)): own for number, own in zip(numbers, places)}
    return opened


def _list_hits(questions: DataFrame, index: CoarseIndex, n: int, probes: int) -> DataFrame:
    asked = questions.filter("course IS NOT NULL").select("qid", "course", "question").collect()  # the caller has measured them
    pairs_of: dict[str, list] = {}
    for r in asked:
        pairs_of.setdefault(r["course"], []).append((r["qid"], r["question"] or ""))
    opened = _opened(pairs_of, index, probes) if asked else {}
    shared = questions.sparkSession.sparkContext.broadcast((pairs_of, opened))
    where = None
    if len(opened) <= MAX_PRUNED_LISTS:  # reaches the scan as a partition filter
        by_course: dict[str, list[int]] = {}
        for course, number in opened:
            by_course.setdefault(course, []).append(number)
        where = F.lit(False)
        for course, numbers in by_course.items():
            where = where | ((F.col("course") == course) & F.col("list").isin(*numbers))
    limits = rt._Limits(0, n)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a course's questions once, and those of the list at hand: lists may be many more than fit together
        pairs, lists = shared.value
        codes, whole, last, some = vec.TokenCodes(), {}, None, None
        kept: dict[str, dict] = {}
        for pdf in slices(frames):
            for key, part in pdf.groupby(["course", "list"], sort=False):
                if key not in lists:
                    continue
                course, own = key[0], lists[key]
                if course not in whole:
                    whole[course] = rt._Questions(*map(list, zip(*pairs[course])), codes)
                if own is not None and key != last:
                    last, some = key, rt._Questions(*map(list, zip(*[pairs[course][i] for i in own])), codes)
                found = rt._best(whole[course] if own is None else some, rt._card_batch(part, codes), limits, None)
                if own is not None:
                    found["q"] = own[found["q"]]
                if course in kept:
                    found = rt._trim({k: np.concatenate([kept[course][k], found[k]]) for k in found}, limits)
                kept[course] = found
        for course, rows in kept.items():
            yield rt._frame(course, whole[course], rows)

    return index.rows(where).mapInPandas(score, rt._result_schema(questions))


def vector_topk_indexed(questions: DataFrame, index: CoarseIndex, n: int, probes: int) -> DataFrame:
    """Best ``n`` cards per question by cosine among the ``probes`` nearest lists, columns as ``vector_topk``.

    Cards of courses that are newer than the centroids are always looked at.
    ``probes`` of at least the number of lists gives the rows of ``vector_topk``.
    """
    found = None
    for lot in _lots(questions):
        rows = _list_hits(lot, index, n, probes)
        found = rows if found is None else found.unionByName(rows)
    best = top_per_key(found.filter("cosine IS NOT NULL"), ["qid"], [F.desc("cosine"), F.asc("ord")], n, salt=F.col("card_id"))
    return best.select("qid", "course", "rank", "card_id", "ord", F.greatest(F.lit(0.0), F.col("cosine")).alias("score"))
