"""Bounded frames, ranks that are counted once, and stored tables that are merged in one shuffle."""

import pandas as pd
from helpers import card, cards_df
from pyspark.sql import functions as F

from cardloom.catalogue import card_queries
from cardloom.operators import external as ex
from cardloom.operators import indexed
from cardloom.operators import retrieval as rt
from cardloom.scale import ROWS_AT_ONCE, ranked, slices
from cardloom.sources.coarse import CoarseIndex
from cardloom.sources import vectors
from cardloom.sources.vectors import VectorTable


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_cut():
    frame = pd.DataFrame({"x": range(2 * ROWS_AT_ONCE + 5)})
    parts = list(slices(iter([frame, frame.iloc[:0], frame.iloc[:3]])))
    assert [len(p) for p in parts] == [ROWS_AT_ONCE, ROWS_AT_ONCE, 5, 3]
    assert pd.concat(parts)["x"].tolist() == [*range(len(frame)), 0, 1, 2]
    assert all(p.index[0] == 0 for p in parts)


def test_counts_and_calls_over_several_frames(spark):
    """More rows than a frame holds come out whole and once."""
    n = ROWS_AT_ONCE + 200
    cards = cards_df(spark, [card(f"k{i}", f"topic {i} of {i % 7}", ord=i) for i in range(n)]).coalesce(1)
    counted = rt.counted_cards(cards).select("ord", F.aggregate("document_counts", F.lit(0), lambda a, w: a + F.abs(w)).alias("n")).collect()
    assert sorted(r.ord for r in counted) == list(range(n)) and all(r.n > 0 for r in counted)
    told = ex.call_rows(spark.range(n).coalesce(1), lambda row: str(row["id"] + 1), "said").collect()
    assert sorted((r.id, r.said) for r in told) == [(i, str(i + 1)) for i in range(n)]


def test_ranks_are_counted_once(spark):
    """Readers of a rank do not add up the partitions again."""
    rows = ranked(spark.range(50).withColumn("x", F.hash("id")), "x", "place")
    assert "Aggregate" not in plan(rows)
    assert [r.place for r in rows.orderBy("x").collect()] == list(range(50))


def test_lists_share_the_questions_of_a_course(spark, tmp_path):
    """A search of all lists holds a course's questions once; a search of some lists holds their places."""
    cards = cards_df(spark, [card(f"k{i}", f"topic{i % 5} word{i}", ord=i) for i in range(60)])
    index = CoarseIndex(spark, f"{tmp_path}/coarse")
    index.rebuild(cards)
    pairs = {"数学": [(q, f"topic{q} word{q}") for q in range(4)]}
    every = indexed._opened(pairs, index, 1000)
    assert len(every) > 2 and all(places is None for places in every.values())
    some = indexed._opened(pairs, index, 2)
    opened = [int(q) for key, places in some.items() if places is not None for q in places]
    assert sorted(opened) == [0, 0, 1, 1, 2, 2, 3, 3]
    asked = spark.createDataFrame([(q, "数学", text) for q, text in pairs["数学"]], "qid bigint, course string, question string")
    rows = lambda f: sorted(map(tuple, f.select("qid", "rank", "card_id", "score").collect()))
    assert rows(indexed.vector_topk_indexed(asked, index, 5, 1000)) == rows(rt.vector_topk(asked, cards, 5))


def test_upsert_meets_stored_rows_in_one_shuffle(spark, tmp_path, monkeypatch):
    """New rows win, all others stay, copies of an id go or stay together; stored rows are not joined by id."""
    store = VectorTable(spark, f"{tmp_path}/vectors")
    old = [card(f"k{i}", f"old {i}", ord=i) for i in range(30)] + [card("k7", "old twin", ord=40), card("k8", "old twin", ord=41)]
    store.rebuild(cards_df(spark, old))
    plans = []
    seen = vectors
    kept = seen.checkpointed
    monkeypatch.setattr(seen, "checkpointed", lambda frame: (plans.append(plan(frame)), kept(frame))[1])
    store.upsert(cards_df(spark, [card(f"k{i}", f"new {i}", ord=i) for i in (7, 9, 31)]))
    assert not any("LeftAnti" in p for p in plans)
    rows = sorted((r.card_id, r.topic) for r in store.read().collect())
    want = [(f"k{i}", f"{'new' if i in (7, 9) else 'old'} {i}") for i in range(30)] + [("k8", "old twin"), ("k31", "new 31")]
    assert rows == sorted(want)


def test_jsonl_is_read_back_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(card_queries, "ranked", lambda *a: (calls.append(plan(a[0])), ranked(*a))[1])
    rows = card_queries.jsonl_roundtrip(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and "from_json" not in calls[0].lower() and "jsontostructs" not in calls[0].lower()
    assert {r.place for r in rows if r.course == "en"} == set(range(sum(r.course == "en" for r in rows)))
