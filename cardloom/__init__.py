"""Spark-native study-card engine: long course texts in, searchable cards and study analytics out."""

from cardloom.schema import CARD, REVIEW, TURN
from cardloom.fixed_values import KINDS

__all__ = ["CARD", "REVIEW", "TURN", "KINDS"]
