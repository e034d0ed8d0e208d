"""The stored coarse index: exact over all lists, measured recall over some, upserts and commits."""

import pytest
from pyspark.sql import functions as F
from test_retrieval import QUESTIONS, asked, library

import helpers as h
from cardloom.catalogue import tables as t
from cardloom.operators import indexed, retrieval as rt
from cardloom.sources import coarse
from cardloom.sources.coarse import MAX_LISTS, CoarseIndex


def rows(frame):
    return sorted((r.qid, r.rank, r.card_id, r.score) for r in frame.collect())


def test_upserts_rebuilds_and_lots(spark, tmp_path, monkeypatch):
    old, new = library(60), library(90, 5)
    asked_ = asked(spark, [(i, c, q) for c in ("数学", "新课", "none", None) for i, q in enumerate(QUESTIONS, 100 * len(c or ""))])
    index = CoarseIndex(spark, str(tmp_path / "index"))
    assert rows(indexed.vector_topk_indexed(asked_, index, 3, 1)) == []
    index.rebuild(h.cards_df(spark, old))
    index.upsert(h.cards_df(spark, new[:30] + library(20, 7, "新课")))
    now = h.cards_df(spark, new[:30] + old[30:] + library(20, 7, "新课"))
    want = rows(rt.vector_topk(asked_, now, 3))
    assert rows(indexed.vector_topk_indexed(asked_, index, 3, MAX_LISTS)) == want and want
    monkeypatch.setattr(rt, "MAX_BROADCAST_QUESTIONS", 5)
    monkeypatch.setattr(coarse, "MAX_BROADCAST", 4)
    assert rows(indexed.vector_topk_indexed(asked_, index, 3, MAX_LISTS)) == want


def test_a_batch_without_commit_is_not_seen(spark, tmp_path, monkeypatch):
    cards, more = library(30), library(30, 9)
    index, other = (CoarseIndex(spark, str(tmp_path / "index")) for _ in range(2))
    index.rebuild(h.cards_df(spark, cards))
    before = sorted(r.card_id for r in index.rows().collect())

    def stop(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(index, "_commit", stop)  # killed between writing and committing
    with pytest.raises(KeyboardInterrupt):
        index.upsert(h.cards_df(spark, [dict(c, id="x" + c["id"]) for c in more]))
    assert sorted(r.card_id for r in other.rows().collect()) == before

    base = other.live()[0]["number"]
    seen = other.commits()
    monkeypatch.setattr(other, "commits", lambda: seen)  # two writers that read the same state: one takes the next number
    CoarseIndex(spark, other.path)._commit("more", other.live()[0]["batch"], after=base)
    other._commit("more", other.live()[0]["batch"], after=base)
    assert [c["number"] for c in index.commits()] == [1, 2, 3]
    CoarseIndex(spark, index.path).rebuild(h.cards_df(spark, cards))
    with pytest.raises(RuntimeError):
        CoarseIndex(spark, index.path)._commit("more", "b", after=base)
    assert [c["kind"] for c in index.live()] == ["base"]


def test_recall_with_some_lists(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    cards, asked_ = t.cards(spark, folder), t.questions(spark, folder)
    index = CoarseIndex(spark, str(tmp_path / "index"))
    index.rebuild(cards)
    lists = index.centroids().agg(F.max(F.size("centres"))).first()[0]
    want = {r[:3:2] for r in rows(rt.vector_topk(asked_, cards, 5))}
    got = {r[:3:2] for r in rows(indexed.vector_topk_indexed(asked_, index, 5, lists // 2))}
    print("recall", len(want & got) / len(want), lists)
    assert len(want & got) >= 0.95 * len(want)
    plan = index.rows((F.col("course") == "en") & F.col("list").isin(0, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(course" in plan
