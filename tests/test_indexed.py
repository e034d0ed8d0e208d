"""The stored posting lists against scoring of all cards."""

import pytest
from pyspark.sql import functions as F
from test_retrieval import QUESTIONS, asked, library

import helpers as h
from cardloom.catalogue import tables as t
from cardloom.operators import indexed, retrieval as rt
from cardloom.sources import postings
from cardloom.sources.postings import PostingTable


def rows(frame):
    return sorted((r.qid, r.rank, r.card_id, r.ord, r.score) for r in frame.collect())


@pytest.fixture(scope="module")
def cards(spark):
    return h.cards_df(spark, library(150) + library(40, 2, "小课") + [dict(c, course=None) for c in library(2, 3)])


@pytest.mark.parametrize("size, k", [(4096, 4), (16, 1), (48, 500)])
def test_same_rows_as_scoring_all(spark, cards, tmp_path, monkeypatch, size, k):
    monkeypatch.setattr(postings, "RANGE", size)
    monkeypatch.setattr(indexed, "BLOCKS_AT_ONCE", 2)
    asked_ = asked(spark, [(i, c, q) for c in ("数学", "小课", "none", None) for i, q in enumerate(QUESTIONS, 100 * len(c or ""))])
    table = PostingTable(spark, str(tmp_path / "index"), buckets=4)
    table.rebuild(cards)
    want = rows(rt.lexical_topk(asked_, cards, k))
    assert rows(indexed.lexical_topk_indexed(asked_, table, k)) == want and want
    monkeypatch.setattr(rt, "MAX_BROADCAST_QUESTIONS", 3)  # several lots
    assert rows(indexed.lexical_topk_indexed(asked_, table, k)) == want


def test_counted_rows_and_empty_sides(spark, cards, tmp_path):
    asked_ = asked(spark, [(i, "数学", q) for i, q in enumerate(QUESTIONS)])
    table = PostingTable(spark, str(tmp_path / "index"))
    table.rebuild(rt.counted_cards(cards))
    assert rows(indexed.lexical_topk_indexed(asked_, table, 3)) == rows(rt.lexical_topk(asked_, cards, 3))
    assert rows(indexed.lexical_topk_indexed(asked_.limit(0), table, 3)) == []
    table.rebuild(cards.limit(0))
    assert rows(indexed.lexical_topk_indexed(asked_, table, 3)) == []


def test_most_blocks_are_never_read(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    table = PostingTable(spark, str(tmp_path / "index"))
    table.rebuild(t.cards(spark, folder))
    asked_ = t.questions(spark, folder)
    total = indexed.blocks_read(asked_, table, 1).agg(F.sum("read").alias("read"), F.sum("held").alias("held")).first()
    assert 0 < total["read"] < 0.5 * total["held"]
    one = asked_.limit(1)
    lists = table.postings().count()
    terms = indexed._asked_terms(one, table.buckets)
    assert table.postings().join(terms, ["course", "bucket", "term"], "left_semi").count() < 0.1 * lists
