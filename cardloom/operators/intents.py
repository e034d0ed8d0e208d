"""Rule intent, question depth and turn mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions.text import strip


def rule_intent(question: Column) -> Column:
    q = strip(question)
    return (
        F.when(q.rlike(fixed.GREETING), F.lit(fixed.CHAT))
        .when(q.rlike(fixed.DAILY_LIFE), F.lit(fixed.GENERAL))
        .when(q.rlike(fixed.REVIEW_ASK), F.lit(fixed.REVIEW))
        .when(q.rlike(fixed.QUIZ_ASK), F.lit(fixed.QUIZ))
        .when(q.rlike(fixed.CONCEPT_WORDS), F.lit(fixed.CONCEPT_ASK))
        .otherwise(F.lit(fixed.ANSWER))
    )


def is_general(intent: Column) -> Column:
    return intent.isin(fixed.GENERAL, fixed.CHAT)


def wants_memory(intent: Column) -> Column:
    """Everyday questions and greetings never look into the student's memory."""
    return ~is_general(intent)


def known_intent(intent: Column) -> Column:
    return F.when(intent.isin(*fixed.INTENTS), intent).otherwise(F.lit(fixed.ANSWER))


def question_depth(question: Column, intent: Column, top_score: Column) -> Column:
    """Depth 0..1 from intent, length, reasoning words, terms or formulas, and the best score."""
    q = strip(question)
    base = F.lit(fixed.DEPTH_OTHER)
    for name, value in fixed.DEPTH_BASE.items():
        base = F.when(intent == name, F.lit(value)).otherwise(base)

    def plus(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    depth = (
        base
        + plus(F.length(q) >= fixed.DEPTH_LONG_CHARS, fixed.DEPTH_LONG)
        + plus(q.rlike(fixed.DEPTH_REASON_WORDS), fixed.DEPTH_REASON)
        + plus(q.rlike(fixed.DEPTH_TERM_WORDS), fixed.DEPTH_TERM)
        + F.least(F.coalesce(top_score, F.lit(0.0)), F.lit(1.0)) * fixed.DEPTH_HIT
    )
    return F.least(depth, F.lit(1.0))


def turn_mode(intent: Column, hits: Column, top_score: Column) -> Column:
    """general: nothing found or no course question; hard: a relevant card for a task; soft: the rest."""
    hard = intent.isin(fixed.ANSWER, fixed.QUIZ) & (top_score >= fixed.RELEVANCE_GATE)
    return (
        F.when(is_general(intent) | (F.coalesce(hits, F.lit(0)) == 0), F.lit("general"))
        .when(F.coalesce(hard, F.lit(False)), F.lit("hard"))
        .otherwise(F.lit("soft"))
    )
