"""Retrieve, render and answer a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.operators import external as ex
from cardloom.operators import render
from cardloom.operators import retrieval as rt
from cardloom.schema import CARD_COLUMNS

PAYLOAD = [c for c in CARD_COLUMNS if c not in ("id", "course")]


def find(questions: DataFrame, cards: DataFrame, k: int | None = None, use_vector: bool = True) -> DataFrame:
    """Hits with rank, score and the whole card."""
    small = rt.questions_fit(questions)
    return rt.attach_cards(rt.hybrid_topk(questions, cards, k, use_vector, small), cards, PAYLOAD, small, k)


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    text = render.render_methods(hits)
    joined = questions.join(text, "qid", "left")
    system, user = render.ask_prompt(F.col("course"), F.col("question"), F.col("methods_text"))
    return joined.withColumns({"system": system, "user": user})


def ask(
    questions: DataFrame, cards: DataFrame, model: Callable[[dict], str] = ex.echo_answer, k: int | None = None
) -> DataFrame:
    asked = prompts(questions, find(questions, cards, k))
    return ex.call_rows(asked, ex.with_retries(model), "answer")


def write_hits(hits: DataFrame, path: str) -> None:
    """Hits as JSON lines, ordered within each question."""
    hits.repartition("qid").sortWithinPartitions("qid", "rank").write.mode("overwrite").json(path)
