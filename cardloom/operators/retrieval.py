"""Hybrid top-k retrieval: lexical and vector channels, fusion, rerank and post-rank filter.

Scoring never materialises question x card pairs.  Cards stay in their scan
partitions; each task multiplies its card vectors with the question matrix
and keeps only the best few per question.  Two ways give the question side
to the tasks:

* ``broadcast``: the questions are measured and fit the stated bound;
* ``blocks``: beyond it, cards and questions are cut into hashed blocks and
  every (card block, question block) group of bounded size is scored by one
  task, so neither side nor a single hot course lands in one place.

Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import fixed_values as fixed
from cardloom.functions import vectors as vec
from cardloom.functions.text import exact_round
from cardloom.scale import slices, top_per_key
from cardloom.session import checkpointed

MAX_BROADCAST_QUESTIONS = 10_000
MAX_BROADCAST_CHARS = 8_000_000
MAX_BROADCAST_DOUBLES = 8_000_000
MAX_BROADCAST_HITS = 500_000
QUESTIONS_PER_BLOCK = 2_000
CARDS_PER_BLOCK = 50_000
CHARS_PER_BLOCK = 200_000_000
SCORE_CELLS = 1_000_000
MAX_PRUNED_COURSES = 500

# ---- card texts -------------------------------------------------------------


def lexical_text() -> Column:
    """Text behind the lexical cosine."""
    return F.concat_ws(
        " ",
        F.col("topic"),
        F.col("applicability"),
        F.concat_ws(" ", "steps"),
        F.concat_ws(" ", "keywords"),
        F.col("technique"),
    )


def example_text() -> Column:
    """What the vector document holds beyond the lexical text."""
    return F.concat_ws(" ", F.col("worked_example"), F.concat_ws(" ", "error_notes"))


def vector_document() -> Column:
    return F.concat_ws(" ", lexical_text(), example_text())


COUNTED = ("course", "card_id", "ord", "boosted", "reference_only", "keyword_tokens", "lexical_counts", "document_counts")
"""Columns of cards whose texts have become token counts; see ``counted_cards``."""


def is_counted(cards: DataFrame) -> bool:
    return set(COUNTED) <= set(cards.columns)


def _scoring_columns(cards: DataFrame) -> DataFrame:
    """What scoring needs of a card: its texts, or the counts of a stored vector table."""
    if is_counted(cards):
        return cards.select(*COUNTED)
    return cards.select(
        F.col("course"),
        F.col("id").alias("card_id"),
        F.col("ord").cast("bigint").alias("ord"),
        F.col("kind").isin(*fixed.BOOSTED_KINDS).alias("boosted"),
        F.coalesce("reference_only", F.lit(False)).alias("reference_only"),
        F.concat_ws(" ", "keywords").alias("keywords"),
        lexical_text().alias("lexical_text"),
        example_text().alias("example_text"),
    )


def counted_cards(cards: DataFrame) -> DataFrame:
    """Cards with texts reduced to keyword tokens and 256 signed counts, plus the vector document and its metadata."""
    source = cards.filter("course IS NOT NULL").select(
        "course",
        F.col("id").alias("card_id"),
        F.col("ord").cast("bigint").alias("ord"),
        F.col("kind").isin(*fixed.BOOSTED_KINDS).alias("boosted"),
        F.coalesce("reference_only", F.lit(False)).alias("reference_only"),
        F.concat_ws(" ", "keywords").alias("keywords"),
        lexical_text().alias("lexical_text"),
        example_text().alias("example_text"),
        vector_document().alias("document"),
        "chapter",
        "kind",
        "topic",
    )
    schema = (
        "course string, card_id string, ord bigint, boosted boolean, reference_only boolean, keyword_tokens array<string>, "
        "lexical_counts array<int>, document_counts array<int>, document string, chapter string, kind string, topic string"
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = vec.TokenCodes()
        for pdf in slices(batches):
            lexical = vec.count_matrix(pdf["lexical_text"].tolist(), codes).astype(np.int32)
            extra = vec.count_matrix(pdf["example_text"].tolist(), codes).astype(np.int32)
            yield pdf.drop(columns=["keywords", "lexical_text", "example_text"]).assign(
                keyword_tokens=[sorted(set(vec.token_list(k))) if k else [] for k in pdf["keywords"]],
                lexical_counts=list(lexical),
                document_counts=list(lexical + extra),
            )

    return source.mapInPandas(count, schema)


# ---- scoring inside a task --------------------------------------------------


class _Questions:
    """Question side of one course: ids, vectors and an index from token to questions."""

    def __init__(self, qids: list, texts: list[str], codes: vec.TokenCodes) -> None:
        self.qids = np.array(qids, dtype=object)
        self.matrix = vec.count_matrix(texts, codes).T
        self.norms = vec.norms(self.matrix.T)
        sets = [set(vec.token_list(t or "")) for t in texts]
        self.distinct = np.array([len(s) for s in sets], dtype=np.float64)
        holders: dict[str, list[int]] = {}
        for i, found in enumerate(sets):
            for token in found:
                holders.setdefault(token, []).append(i)
        self.holders = {t: np.array(i) for t, i in holders.items()}
        self.vocabulary = frozenset(holders)

    def __len__(self) -> int:
        return len(self.qids)


@dataclass
class _Cards:
    ids: np.ndarray
    ords: np.ndarray
    boosted: np.ndarray
    reference_only: np.ndarray
    keyword_tokens: list[set]
    lexical: np.ndarray
    document: np.ndarray

    def rows(self, start: int, stop: int) -> "_Cards":
        part = slice(start, stop)
        return _Cards(
            self.ids[part],
            self.ords[part],
            self.boosted[part],
            self.reference_only[part],
            self.keyword_tokens[part],
            self.lexical[part],
            self.document[part],
        )


@dataclass
class _Limits:
    lexical: int
    vector: int


_FIELDS = ("q", "ord", "card_id", "reference_only", "lexical", "cosine")


def _place(q: np.ndarray, score: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """Rank (from 0) of every row within its question by score descending, ordinal ascending."""
    order = np.lexsort((ords, -score, q))
    sorted_q = q[order]
    first = np.r_[True, sorted_q[1:] != sorted_q[:-1]]
    starts = np.flatnonzero(first)
    place = np.empty(len(q), dtype=np.int64)
    place[order] = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return place


def _trim(rows: dict[str, np.ndarray], limits: _Limits) -> dict[str, np.ndarray]:
    if not len(rows["q"]):
        return rows
    keep = np.zeros(len(rows["q"]), dtype=bool)
    for name, limit in (("lexical", limits.lexical), ("cosine", limits.vector)):
        score = rows[name]
        usable = np.flatnonzero(~np.isnan(score))
        if limit and len(usable):
            place = _place(rows["q"][usable], score[usable], rows["ord"][usable])
            keep[usable[place < limit]] = True
    return {k: v[keep] for k, v in rows.items()}


def _at_least_nth(score: np.ndarray, n: int) -> np.ndarray:
    """Per question column, the cells not below its n-th best value (NaN never qualifies)."""
    if n <= 0:
        return np.zeros(score.shape, dtype=bool)
    filled = np.where(np.isnan(score), -np.inf, score)
    if n < len(score):
        bound = np.partition(filled, len(score) - n, axis=0)[len(score) - n]
        return (filled >= bound) & (filled > -np.inf)
    return filled > -np.inf


def _score(questions: _Questions, cards: _Cards, limits: _Limits) -> dict[str, np.ndarray]:
    """Candidates of one card batch: best lexical and best vector cards per question."""
    lex_norm, doc_norm = vec.norms(cards.lexical), vec.norms(cards.document)
    cosine = cards.document @ questions.matrix / np.outer(doc_norm, questions.norms)
    hits = np.zeros(cosine.shape)
    for row, found in enumerate(cards.keyword_tokens):
        for token in found & questions.vocabulary:
            hits[row, questions.holders[token]] += 1
    near = cards.lexical @ questions.matrix / np.outer(lex_norm, questions.norms)
    boost = np.where(cards.boosted, fixed.KIND_BOOST, 0.0)[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        lexical = fixed.KEYWORD_WEIGHT * (hits / questions.distinct) + fixed.COSINE_WEIGHT * near + boost
    gate = (questions.distinct > 0)[None, :] & ~cards.reference_only[:, None] & (lexical > 0)
    lexical = np.where(gate, lexical, np.nan)
    row, q = np.nonzero(_at_least_nth(lexical, limits.lexical) | _at_least_nth(cosine, limits.vector))
    found = {
        "q": q,
        "ord": cards.ords[row],
        "card_id": cards.ids[row],
        "reference_only": cards.reference_only[row],
        "lexical": lexical[row, q],
        "cosine": cosine[row, q],
    }
    return _trim(found, limits)


def _best(questions: _Questions, cards: _Cards, limits: _Limits, kept: dict | None) -> dict:
    step = max(64, SCORE_CELLS // max(len(questions), 1))
    for start in range(0, len(cards.ids), step):
        found = _score(questions, cards.rows(start, start + step), limits)
        if kept is not None:
            found = _trim({k: np.concatenate([kept[k], found[k]]) for k in _FIELDS}, limits)
        kept = found
    return kept


def _frame(course: str, questions: _Questions, kept: dict) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "qid": questions.qids[kept["q"]],
            "course": np.full(len(kept["q"]), course, dtype=object),
            "card_id": kept["card_id"],
            "ord": kept["ord"],
            "reference_only": kept["reference_only"],
            "lexical": np.where(np.isnan(kept["lexical"]), None, kept["lexical"].astype(object)),
            "cosine": kept["cosine"],
        }
    )


def _card_batch(pdf: pd.DataFrame, codes: vec.TokenCodes) -> _Cards:
    if "lexical_counts" in pdf:
        return _Cards(
            pdf["card_id"].to_numpy(object),
            pdf["ord"].to_numpy(np.int64),
            pdf["boosted"].to_numpy(bool),
            pdf["reference_only"].to_numpy(bool),
            [set(t) for t in pdf["keyword_tokens"]],
            np.stack(pdf["lexical_counts"].to_list()).astype(np.float64),
            np.stack(pdf["document_counts"].to_list()).astype(np.float64),
        )
    lexical = vec.count_matrix(pdf["lexical_text"].tolist(), codes)
    extra = vec.count_matrix(pdf["example_text"].tolist(), codes)
    # a blank separates tokens, so joined keywords have the tokens of the single ones
    tokens = [set(vec.token_list(k)) if k else set() for k in pdf["keywords"]]
    return _Cards(
        pdf["card_id"].to_numpy(object),
        pdf["ord"].to_numpy(np.int64),
        pdf["boosted"].to_numpy(bool),
        pdf["reference_only"].to_numpy(bool),
        tokens,
        lexical,
        lexical + extra,
    )


# ---- the two ways to bring questions to the cards ---------------------------


def questions_fit(questions: DataFrame) -> bool:
    """Whether the question side is small enough to broadcast (one aggregated row is read)."""
    size = questions.agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("chars")).first()
    return size["n"] <= MAX_BROADCAST_QUESTIONS and (size["chars"] or 0) <= MAX_BROADCAST_CHARS


def _result_schema(questions: DataFrame) -> str:
    return (
        f"qid {questions.schema['qid'].dataType.simpleString()}, course string, card_id string, ord bigint, "
        "reference_only boolean, lexical double, cosine double"
    )


def _by_broadcast(questions: DataFrame, cards: DataFrame, limits: _Limits) -> DataFrame:
    by_course: dict[str, tuple[list, list]] = {}
    for row in questions.select("course", "qid", "question").collect():
        qids, texts = by_course.setdefault(row["course"], ([], []))
        qids.append(row["qid"])
        texts.append(row["question"] or "")
    if len(by_course) <= MAX_PRUNED_COURSES:  # reaches the scan as a partition or row-group filter
        cards = cards.filter(F.col("course").isin(*by_course))
    shared = questions.sparkSession.sparkContext.broadcast(by_course)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = vec.TokenCodes()
        ready: dict[str, _Questions] = {}
        kept: dict[str, dict] = {}
        for pdf in slices(batches):
            for course, part in pdf.groupby("course", sort=False):
                if course not in shared.value:
                    continue
                if course not in ready:
                    ready[course] = _Questions(*shared.value[course], codes)
                kept[course] = _best(ready[course], _card_batch(part, codes), limits, kept.get(course))
        for course, rows in kept.items():
            yield _frame(course, ready[course], rows)

    return _scoring_columns(cards).mapInPandas(score, _result_schema(questions))


def _numbers(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)


def _course_blocks(
    questions: DataFrame, cards: DataFrame, questions_per_block: int, cards_per_block: int, chars_per_block: int
) -> DataFrame:
    """(course, question_blocks, card_blocks) of courses that have both sides, from their own rows and characters."""
    asked = questions.groupBy("course").agg(
        F.ceil(F.greatest(F.count("*") / questions_per_block, F.sum(F.length("question")) / chars_per_block)).alias("question_blocks")
    )
    chars = F.lit(0) if is_counted(cards) else F.length("lexical_text") + F.length("example_text")
    offered = cards.groupBy("course").agg(
        F.ceil(F.greatest(F.count("*") / cards_per_block, F.sum(chars) / chars_per_block)).alias("card_blocks")
    )
    return asked.join(offered, "course")


def _by_blocks(
    questions: DataFrame,
    cards: DataFrame,
    limits: _Limits,
    questions_per_block: int = QUESTIONS_PER_BLOCK,
    cards_per_block: int = CARDS_PER_BLOCK,
    chars_per_block: int = CHARS_PER_BLOCK,
) -> DataFrame:
    """Score in tasks of one block of a course's questions with one block of its cards.

    Blocks are cut per course, so a course that fits one block is shuffled
    once and never copied, and courses without questions are not shuffled at
    all.  Of larger courses each side is copied once per block of the other.
    """
    scored = _scoring_columns(cards)
    blocks = checkpointed(_course_blocks(questions, scored, questions_per_block, cards_per_block, chars_per_block))
    left = (
        questions.join(blocks, "course")
        .withColumn("question_block", F.pmod(F.xxhash64("qid"), F.col("question_blocks")))
        .withColumn("card_block", F.explode(_numbers(F.col("card_blocks"))))
        .select("course", "qid", "question", "question_block", "card_block")
    )
    right = (
        scored.join(blocks, "course")
        .withColumn("card_block", F.pmod(F.xxhash64("ord"), F.col("card_blocks")))
        .withColumn("question_block", F.explode(_numbers(F.col("question_blocks"))))
        .drop("card_blocks", "question_blocks")
    )
    keys = ["course", "card_block", "question_block"]
    columns = [c.split()[0] for c in _result_schema(questions).split(", ")]

    def score(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or offered.empty:
            return pd.DataFrame({c: np.array([], dtype=object) for c in columns})
        codes = vec.TokenCodes()
        side = _Questions(asked["qid"].tolist(), asked["question"].fillna("").tolist(), codes)
        return _frame(asked["course"].iloc[0], side, _best(side, _card_batch(offered, codes), limits, None))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, _result_schema(questions))


def candidates(
    questions: DataFrame,
    cards: DataFrame,
    lexical_k: int,
    vector_n: int,
    small: bool | None = None,
) -> DataFrame:
    """Best ``lexical_k`` and best ``vector_n`` cards per question with both scores and both ranks.

    ``questions``: qid, course, question.  ``cards``: card columns and ``ord``,
    or the rows of a stored vector table, whose texts need no counting.
    Vector ranks count reference-only cards too; the lexical channel keeps
    scores above zero of other cards.  Questions and cards without a course find nothing.
    """
    small = questions_fit(questions) if small is None else small
    way = _by_broadcast if small else _by_blocks
    found = way(questions.filter("course IS NOT NULL"), cards.filter("course IS NOT NULL"), _Limits(lexical_k, vector_n))
    # one row per channel, so that one salted cut per question and channel serves both
    limits = {"lexical": lexical_k, "cosine": vector_n}
    channels = [
        F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("name"), F.col(name).alias("score")))
        for name, limit in limits.items()
        if limit
    ]
    asked = found.withColumn("_c", F.explode(F.array_compact(F.array(*channels))))
    best = top_per_key(
        asked.withColumn("_name", F.col("_c.name")),
        ["qid", "_name"],
        [F.desc("_c.score"), F.asc("ord")],
        max(lexical_k, vector_n),
        rank="_rank",
        salt=F.col("card_id"),
    )
    rank = lambda name: F.max(
        F.when((F.col("_name") == name) & (F.col("_rank") <= limits[name]), F.col("_rank"))
    )
    return (
        best.groupBy("qid", "course", "card_id", "ord", "reference_only")
        .agg(
            F.max("lexical").alias("lexical"),
            rank("lexical").alias("lexical_rank"),
            F.max("cosine").alias("cosine"),
            rank("cosine").alias("vector_rank"),
        )
        .filter("lexical_rank IS NOT NULL OR vector_rank IS NOT NULL")
    )


# ---- operators --------------------------------------------------------------


def vector_topk(questions: DataFrame, cards: DataFrame, n: int, small: bool | None = None) -> DataFrame:
    """Best ``n`` cards per question by cosine; the score is clamped at 0 after ranking."""
    return (
        candidates(questions, cards, 0, n, small)
        .filter(F.col("vector_rank").isNotNull())
        .select(
            "qid",
            "course",
            F.col("vector_rank").alias("rank"),
            "card_id",
            "ord",
            F.greatest(F.lit(0.0), F.col("cosine")).alias("score"),
        )
    )


def lexical_topk(questions: DataFrame, cards: DataFrame, k: int, small: bool | None = None) -> DataFrame:
    return (
        candidates(questions, cards, k, 0, small)
        .filter(F.col("lexical_rank").isNotNull())
        .select("qid", "course", F.col("lexical_rank").alias("rank"), "card_id", "ord", F.col("lexical").alias("score"))
    )


def hybrid_topk(
    questions: DataFrame,
    cards: DataFrame,
    k: int | None = None,
    use_vector: bool = True,
    small: bool | None = None,
    vector_hits: DataFrame | None = None,
) -> DataFrame:
    """Fused top-k per question.

    ``vector_hits`` (qid, card_id, cosine; reference-only cards included)
    replaces the hashed vector channel by another embedding's best cards.

    Keeping the k best lexical and the max(3k, 10) best vector cards is exact:
    a card in neither list is behind k cards in the lexical order, and each of
    those scores at least as much after fusion.  Equal scores keep the card
    order, lexical hits before vector-only hits.  A vector hit counts even
    with score 0.
    """
    k = k if k and k > 0 else fixed.DEFAULT_TOP_K
    n = max(fixed.VECTOR_OVERFETCH * k, fixed.MIN_VECTOR_HITS) if use_vector else 0
    if vector_hits is None or not use_vector:
        found = candidates(questions, cards, k, n, small)
    else:
        found = _with_given_vectors(questions, cards, vector_hits, k, n, small)
    usable = found.filter(~F.col("reference_only"))
    vector = F.when(F.col("vector_rank").isNotNull(), F.greatest(F.lit(0.0), F.col("cosine")))
    fused = usable.withColumn("vector", vector).withColumn(
        "raw_score", F.coalesce("lexical", F.lit(0.0)) + F.coalesce("vector", F.lit(0.0))
    )
    only_vector = F.col("lexical").isNull()
    order = [
        F.desc("raw_score"),
        only_vector,
        F.when(only_vector, F.col("vector_rank").cast("bigint")).otherwise(F.col("ord")),
    ]
    return top_per_key(fused, ["qid"], order, k).select(
        "qid",
        "course",
        "rank",
        "card_id",
        "ord",
        exact_round(F.col("raw_score"), 4).alias("score"),
        "lexical",
        "vector",
    )


def pair_lexical(pairs: DataFrame) -> DataFrame:
    """Lexical score of given pairs: columns of the scoring view plus ``question``; null where the gate drops it."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("lexical", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = vec.TokenCodes()
        for pdf in slices(batches):
            asked = vec.count_matrix(pdf["question"].tolist(), codes)
            offered = vec.count_matrix(pdf["lexical_text"].tolist(), codes)
            near = np.einsum("ij,ij->i", asked, offered) / (vec.norms(offered) * vec.norms(asked))
            words = [set(vec.token_list(q or "")) for q in pdf["question"]]
            hits = np.array([len(w & set(vec.token_list(k or ""))) for w, k in zip(words, pdf["keywords"])], dtype=float)
            sizes = np.array([len(w) for w in words], dtype=float)
            boost = np.where(pdf["boosted"].to_numpy(bool), fixed.KIND_BOOST, 0.0)
            with np.errstate(invalid="ignore", divide="ignore"):
                value = fixed.KEYWORD_WEIGHT * (hits / sizes) + fixed.COSINE_WEIGHT * near + boost
            gate = (sizes > 0) & ~pdf["reference_only"].to_numpy(bool) & (value > 0)
            yield pdf.assign(lexical=np.where(gate, value.astype(object), None))

    return pairs.mapInPandas(score, schema)


def _with_given_vectors(
    questions: DataFrame, cards: DataFrame, vector_hits: DataFrame, k: int, n: int, small: bool | None
) -> DataFrame:
    """Rows like those of ``candidates``, with the vector side given from outside."""
    small = questions_fit(questions) if small is None else small
    given = top_per_key(
        vector_hits.select("qid", "card_id", "cosine").join(questions.select("qid", "course", "question"), "qid"),
        ["qid"],
        [F.desc("cosine"), F.asc("card_id")],
        n,
        rank="vector_rank",
        salt=F.col("card_id"),
    )
    few = small and MAX_BROADCAST_QUESTIONS * n <= MAX_BROADCAST_HITS
    pairs = _scoring_columns(cards).join(F.broadcast(given) if few else given, ["course", "card_id"])
    columns = ["qid", "course", "card_id", "ord", "reference_only", "lexical", "lexical_rank", "cosine", "vector_rank"]
    near = pair_lexical(pairs).withColumn("lexical_rank", F.lit(None).cast("int")).select(*columns)
    words = candidates(questions, cards, k, 0, small).join(given.select("qid", "card_id"), ["qid", "card_id"], "left_anti")
    return near.unionByName(words.select(*columns))


def attach_cards(hits: DataFrame, cards: DataFrame, columns: list[str], small: bool, k: int | None = None) -> DataFrame:
    """Join card payload after ranking.

    ``small`` says that the questions were measured to fit the broadcast bound.
    With k hits each there are at most ``MAX_BROADCAST_HITS`` rows to
    broadcast; otherwise Spark chooses the join.
    """
    payload = cards.select("course", F.col("id").alias("card_id"), *columns)
    few = small and MAX_BROADCAST_QUESTIONS * (k or fixed.DEFAULT_TOP_K) <= MAX_BROADCAST_HITS
    return payload.join(F.broadcast(hits) if few else hits, ["course", "card_id"])


def rerank_by_bias(hits: DataFrame, bias: str | Column) -> DataFrame:
    """Reorder by score plus a boost for favoured kinds; the score itself stays.  Needs ``kind``."""
    bias = F.lit(bias) if isinstance(bias, str) else bias
    favoured = F.when(bias == fixed.BIAS_CONCEPT, F.col("kind").isin(*fixed.BIAS_KINDS[fixed.BIAS_CONCEPT])).otherwise(
        F.col("kind").isin(*fixed.BOOSTED_KINDS)
    )
    boost = F.when((bias != fixed.BIAS_BALANCED) & favoured, F.lit(fixed.BIAS_BOOST)).otherwise(F.lit(0.0))
    keyed = F.when(bias == fixed.BIAS_BALANCED, F.lit(0.0)).otherwise(F.col("score") + boost)
    return (
        hits.withColumn("_key", keyed)
        .withColumn("_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_key"), "rank")))
        .drop("_key", "rank")
        .withColumnRenamed("_rank", "rank")
    )


def kind_after_rank(hits: DataFrame, kind: str | Column, k: int) -> DataFrame:
    """Keep one kind among hits ranked to 2k, then cut to k.  Needs ``kind``."""
    return top_per_key(
        hits.filter(F.col("rank") <= 2 * k).filter(F.col("kind") == kind).withColumnRenamed("rank", "first_rank"),
        ["qid"],
        [F.asc("first_rank")],
        k,
    )


# ---- stored vectors ---------------------------------------------------------


def collection_name(course: Column) -> Column:
    """ASCII form of the course plus eight md5 digits."""
    ascii_part = F.substring(
        F.regexp_replace(F.regexp_replace(course, fixed.COLLECTION_UNSAFE, "_"), "^_+|_+$", ""),
        1,
        fixed.COLLECTION_CHARS,
    )
    return F.concat(
        F.lit("cb-"),
        F.when(ascii_part == "", F.lit("course")).otherwise(ascii_part),
        F.lit("-"),
        F.substring(F.md5(course.cast("binary")), 1, 8),
    )


def vector_rows(cards: DataFrame) -> DataFrame:
    """Rows of the vector table: id, document, metadata and the 256 signed counts."""
    schema = (
        "course string, id string, ord bigint, document string, chapter string, kind string, topic string, "
        "weights array<int>"
    )
    rows = cards.select(
        "course", "id", F.col("ord").cast("bigint").alias("ord"), vector_document().alias("document"), "chapter", "kind", "topic"
    )

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = vec.TokenCodes()
        for pdf in slices(batches):
            counts = vec.count_matrix(pdf["document"].tolist(), codes).astype(np.int32)
            yield pdf.assign(weights=list(counts))

    return rows.mapInPandas(embed, schema)


def dense_topk(
    queries: DataFrame, rows: DataFrame, n: int, max_queries: int = MAX_BROADCAST_QUESTIONS
) -> DataFrame:
    """Exact cosine top-n over precomputed vectors.

    ``queries``: qid, vector.  ``rows``: ord, vector.  Up to ``max_queries``
    queries of ``MAX_BROADCAST_DOUBLES`` numbers in all are broadcast; more are
    compared with the rows block by block.
    """
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("doubles")).first()
    small = size["n"] <= max_queries and (size["doubles"] or 0) <= MAX_BROADCAST_DOUBLES
    found = _dense_slice(queries, rows, n) if small else _dense_blocks(queries, rows, n)
    return top_per_key(found, ["qid"], [F.desc("cosine"), F.asc("ord")], n, salt=F.col("ord")).select(
        "qid", "rank", "ord", F.greatest(F.lit(0.0), F.col("cosine")).alias("score")
    )


def _dense_best(qids: np.ndarray, matrix: np.ndarray, ords: np.ndarray, offered: np.ndarray, n: int, kept: dict | None) -> dict:
    """Best ``n`` rows per query of one batch, merged with those kept so far."""
    lengths = vec.norms(matrix)
    step = max(64, SCORE_CELLS // max(len(qids), 1))
    for start in range(0, len(ords), step):
        block = offered[start : start + step]
        cosine = block @ matrix.T / np.outer(vec.norms(block), lengths)
        row, q = np.nonzero(_at_least_nth(cosine, n))
        new = {"q": q, "ord": ords[start + row], "cosine": cosine[row, q], "lexical": np.full(len(q), np.nan)}
        if kept is not None:
            new = {k: np.concatenate([kept[k], new[k]]) for k in new}
        kept = _trim(new, _Limits(0, n))
    return kept


def _dense_schema(queries: DataFrame) -> str:
    return f"qid {queries.schema['qid'].dataType.simpleString()}, ord bigint, cosine double"


def _dense_blocks(
    queries: DataFrame,
    rows: DataFrame,
    n: int,
    queries_per_block: int = QUESTIONS_PER_BLOCK,
    rows_per_block: int = CARDS_PER_BLOCK,
) -> DataFrame:
    """One task per block of queries and block of rows; neither side passes through the driver."""
    asked = F.lit(-(-max(queries.count(), 1) // queries_per_block))
    offered = F.lit(-(-max(rows.count(), 1) // rows_per_block))
    left = queries.select(
        "qid", "vector", F.pmod(F.xxhash64("qid"), asked).alias("qb"), F.explode(_numbers(offered)).alias("rb")
    )
    right = rows.select(
        F.col("ord").cast("bigint").alias("ord"),
        F.col("vector").alias("vector"),
        F.pmod(F.xxhash64("ord"), offered).alias("rb"),
        F.explode(_numbers(asked)).alias("qb"),
    )

    def score(questions: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if questions.empty or block.empty:
            return pd.DataFrame({"qid": [], "ord": [], "cosine": []})
        qids = questions["qid"].to_numpy(object)
        matrix, vectors = (np.stack(f["vector"].to_list()).astype(np.float64) for f in (questions, block))
        kept = _dense_best(qids, matrix, block["ord"].to_numpy(np.int64), vectors, n, None)
        return pd.DataFrame({"qid": qids[kept["q"]], "ord": kept["ord"], "cosine": kept["cosine"]})

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(score, _dense_schema(queries))


def _dense_slice(queries: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    asked = queries.select("qid", "vector").collect()
    shared = queries.sparkSession.sparkContext.broadcast(
        ([r["qid"] for r in asked], np.array([r["vector"] for r in asked], dtype=np.float64))
    )
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, matrix = shared.value
        kept = None
        if not len(qids):
            return
        for pdf in slices(batches):
            if not pdf.empty:
                offered = np.stack(pdf["vector"].to_list()).astype(np.float64)
                kept = _dense_best(qids, matrix, pdf["ord"].to_numpy(np.int64), offered, n, kept)
        if kept is not None:
            yield pd.DataFrame({"qid": np.array(qids, dtype=object)[kept["q"]], "ord": kept["ord"], "cosine": kept["cosine"]})

    return rows.select(F.col("ord").cast("bigint").alias("ord"), "vector").mapInPandas(score, _dense_schema(queries))
