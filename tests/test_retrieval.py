import random

import pytest
from pyspark.sql import functions as F

import helpers as h
from cardloom import fixed_values as fixed
from cardloom.operators import cards as cd
from cardloom.operators import draw
from cardloom.operators import evaluation as ev
from cardloom.operators import retrieval as rt
from cardloom.plans import ask

WORDS = "极限 导数 积分 级数 矩阵 向量 rate schedule page memory deadlock 进程 线程 调度 a bc 法则 洛必达 方程".split()


def library(n, seed=1, course="数学"):
    rnd = random.Random(seed)
    pick = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    return [
        h.card(
            f"{course}|{i}", pick(2), kind=rnd.choice(fixed.KINDS), course=course, ord=i * 3, keywords=[pick(1) for _ in range(3)],
            applicability=pick(3), steps=[pick(4), pick(2)], technique=pick(1), worked_example=pick(5),
            error_notes=[pick(2)], reference_only=rnd.random() < 0.15,
        )
        for i in range(n)
    ]


def asked(spark, rows):
    return spark.createDataFrame(rows, "qid long, course string, question string")


QUESTIONS = ["洛必达 法则 极限", "page memory schedule", "", "！？", "矩阵", "deadlock 进程 调度 怎么", "zzz qqq"]


@pytest.mark.parametrize("use_vector", [True, False])
@pytest.mark.parametrize("k", [1, 3, 7])
def test_hybrid_matches_straight_scoring(spark, k, use_vector):
    sides = {"数学": library(60), "小课": library(4, 2, "小课")}
    cards = h.cards_df(spark, [c for rows in sides.values() for c in rows]).repartition(5)
    questions = [(i, c, q) for i, (c, q) in enumerate((c, q) for c in sides for q in QUESTIONS)]
    hits = rt.hybrid_topk(asked(spark, questions), cards, k, use_vector)
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["card_id"], r["score"]))
    for qid, course, question in questions:
        want = h.brute_hybrid(question, sides[course], k, use_vector)
        assert [s for _, s in got.get(qid, [])] == pytest.approx([s for _, s in want], abs=1e-9)
        assert [i for i, _ in got.get(qid, [])] == [i for i, _ in want]


def test_block_path_gives_the_same(spark):
    cards = h.cards_df(spark, library(80) + library(5, 3, "小课"))
    questions = asked(spark, [(i, "数学" if i % 3 else "小课", q) for i, q in enumerate(QUESTIONS * 2)])
    limits = rt._Limits(5, 15)
    columns = ["qid", "card_id", "lexical", "cosine"]
    whole = rt.hybrid_topk(questions, cards, 5, small=True).collect()
    blocked = rt.hybrid_topk(questions, cards, 5, small=False).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, blocked)) and whole
    small = rt._by_blocks(questions, cards, limits, questions_per_block=3, cards_per_block=20).select(*columns)
    best = {}
    for r in small.collect():
        best.setdefault(r["qid"], []).append((-r["cosine"], r["card_id"]))
    direct = {}
    for r in rt._by_broadcast(questions, cards, limits).select(*columns).collect():
        direct.setdefault(r["qid"], []).append((-r["cosine"], r["card_id"]))
    assert {q: min(v) for q, v in best.items()} == {q: min(v) for q, v in direct.items()}


def test_null_courses_find_nothing_either_way(spark):
    rows = library(20) + [dict(c, course=None) for c in library(5, 9)]
    cards = h.cards_df(spark, rows)
    questions = asked(spark, [(1, "数学", QUESTIONS[0]), (2, None, QUESTIONS[0])])
    both = [sorted(map(tuple, rt.hybrid_topk(questions, cards, 3, small=s).collect())) for s in (True, False)]
    assert both[0] == both[1] and {r[0] for r in both[0]} == {1}


def test_courses_of_one_block_are_not_copied(spark):
    """Many small courses: no card or question is written more than once to a shuffle of the block path."""
    cards = h.cards_df(spark, [c for i in range(12) for c in library(6, i, f"课{i}")])
    questions = asked(spark, [(i, f"课{i}", q) for i, q in enumerate(QUESTIONS)])
    scored = rt._scoring_columns(cards)
    blocks = {r["course"]: (r["question_blocks"], r["card_blocks"]) for r in rt._course_blocks(questions, scored, 4, 10, 10**6).collect()}
    assert blocks == {f"课{i}": (1, 1) for i in range(len(QUESTIONS))}
    cut = rt._course_blocks(questions, scored, 4, 2, 10**6).collect()
    assert {r["card_blocks"] for r in cut} == {3}
    assert {r["card_blocks"] > 3 for r in rt._course_blocks(questions, scored, 4, 10, 20).collect()} == {True}


def test_each_channel_is_cut_before_the_shuffle(spark):
    hits = rt.candidates(asked(spark, [(1, "数学", "极限")]), h.cards_df(spark, library(30)), 3, 10, True)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_partitioning_changes_nothing(spark):
    cards = h.cards_df(spark, library(70))
    questions = asked(spark, [(i, "数学", q) for i, q in enumerate(QUESTIONS)])
    first = sorted(map(tuple, rt.hybrid_topk(questions, cards.coalesce(1), 5).collect()))
    assert first == sorted(map(tuple, rt.hybrid_topk(questions, cards.repartition(13), 5).collect()))


def test_ties_keep_card_order(spark):
    rows = [h.card(f"c{i}", "同一主题", ord=i) for i in range(12)]
    hits = rt.hybrid_topk(asked(spark, [(1, "数学", "同一主题")]), h.cards_df(spark, rows).repartition(6), 5)
    assert [r["card_id"] for r in hits.orderBy("rank").collect()] == [f"c{i}" for i in range(5)]


def test_zero_score_vector_hit_stays(spark):
    """In a small course every usable card comes back, a concept without any overlap with score 0."""
    rows = [h.card("a", "甲乙", kind="概念"), h.card("b", "丙丁", kind="概念", ord=1, reference_only=True)]
    hits = rt.hybrid_topk(asked(spark, [(1, "数学", "xyz")]), h.cards_df(spark, rows), 5).collect()
    want = h.brute_hybrid("xyz", rows, 5)
    assert [(r["card_id"], r["score"]) for r in hits] == want and len(hits) == 1


def test_named_method_comes_first(spark):
    rows = [
        h.card("1", "洛必达法则", keywords=["洛必达", "未定型", "0/0", "求导"], applicability="0/0 型未定式", steps=["判断型别", "分别求导"]),
        h.card("2", "等价无穷小替换", keywords=["等价无穷小", "替换"], applicability="乘除中的趋于0因子", steps=["整体替换"], ord=1),
    ]
    hits = ask.find(asked(spark, [(1, "数学", "分子分母都趋于零，用洛必达法则求")]), h.cards_df(spark, rows), 3)
    assert hits.filter("rank = 1").first()["topic"] == "洛必达法则"


def test_rerank(spark):
    rows = [(1, 1, "概念", 0.55), (1, 2, "方法", 0.50), (1, 3, "例题", 0.50), (1, 4, "定理", 0.2)]
    hits = spark.createDataFrame(rows, "qid long, rank int, kind string, score double")
    order = lambda bias: [r["kind"] for r in rt.rerank_by_bias(hits, bias).orderBy("rank").collect()]
    assert order("均衡") == ["概念", "方法", "例题", "定理"]
    assert order("方法") == ["方法", "例题", "概念", "定理"]
    assert order("概念") == ["概念", "方法", "例题", "定理"]


def test_kind_filter_after_rank(spark):
    rows = [(1, i, "方法" if i in (2, 9, 10, 11) else "概念", 1.0) for i in range(1, 13)]
    hits = spark.createDataFrame(rows, "qid long, rank int, kind string, score double")
    kept = rt.kind_after_rank(hits, "方法", 5).orderBy("rank").collect()
    assert [(r["first_rank"], r["rank"]) for r in kept] == [(2, 1), (9, 2), (10, 3)]


def test_reference_cards_are_flagged_and_never_retrieved(spark):
    rows = [
        h.card("n", "推荐阅读顺序", course="操作系统", keywords=["阅读顺序"], applicability="教材编排建议", steps=["先完成第1至3章"]),
        h.card("r", "轮转调度", course="操作系统", keywords=["轮转"], applicability="多进程并发", steps=["分配时间片"], ord=1),
    ]
    flagged = cd.flag_reference(h.cards_df(spark, rows))
    assert {r["id"]: r["reference_only"] for r in flagged.collect()} == {"n": True, "r": False}
    found = rt.hybrid_topk(asked(spark, [(1, "操作系统", "推荐阅读顺序"), (2, "操作系统", "轮转调度怎么分配时间片")]), flagged, 5, False)
    got = {(r["qid"], r["rank"]): r["card_id"] for r in found.collect()}
    assert "n" not in got.values() and got[(2, 1)] == "r"


def test_vector_table_and_names(spark):
    rows = library(10)
    table = {r["id"]: r["weights"] for r in rt.vector_rows(h.cards_df(spark, rows)).collect()}
    for c in rows:
        text = " ".join([c["topic"], c["applicability"], *c["steps"], *c["keywords"], c["technique"], c["worked_example"], *c["error_notes"]])
        assert table[c["id"]] == h.vector(text)
    name = spark.range(1).select(rt.collection_name(F.lit("操作系统 OS")).alias("x")).first()["x"]
    assert name.startswith("cb-") and name[3:-9].strip("_") == "OS" and len(name.split("-")[-1]) == 8


def test_dense_slices_agree(spark):
    rnd = random.Random(5)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(8)]
    rows = spark.createDataFrame([(i, vec()) for i in range(50)], "ord long, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(i, vec()) for i in range(9)], "qid long, vector array<double>")
    flat = lambda df: sorted((r["qid"], r["rank"], r["ord"], round(r["score"], 9)) for r in df.collect())
    one = flat(rt.dense_topk(queries, rows, 4))
    assert one == flat(rt.dense_topk(queries, rows, 4, max_queries=3)) and len(one) == 36


def test_evaluation(spark):
    questions = spark.createDataFrame(
        [(1, "直查", ["Mode Switch", "死锁"]), (2, "两跳", ["x"]), (3, "直查", [])], "qid long, tag string, expect_topics array<string>"
    )
    topics = spark.createDataFrame([(1, ["mode switch 过程", "页表"]), (3, ["y"])], "qid long, topics array<string>")
    results = {r["qid"]: r["recall"] for r in ev.recall(questions, topics).collect()}
    assert results == {1: 0.5, 2: 0.0, 3: 0.0}
    means = {r["tag"]: (r["questions"], round(r["recall"], 3)) for r in ev.recall_by_tag(ev.recall(questions, topics)).collect()}
    assert means == {"直查": (2, 0.25), "两跳": (1, 0.0), None: (3, 0.167)}


def test_daily_draw(spark):
    rows = [h.card(f"c{i}", "t", ord=i, chapter="一" if i % 2 else "二") for i in range(40)] + [h.card("ref", "t", reference_only=True)]
    pool = draw.draw_pool(h.cards_df(spark, rows), chapter="一")
    ids = [r["id"] for r in draw.daily_draw(pool.repartition(7), ["course"], 5, "s").collect()]
    again = [r["id"] for r in draw.daily_draw(pool.coalesce(1), ["course"], 5, "s").collect()]
    assert sorted(ids) == sorted(again) and len(set(ids)) == 5
    assert draw.daily_draw(pool, ["course"], 500).count() == 20


def test_given_vectors_take_the_place_of_hashed_ones(spark):
    cards = h.cards_df(spark, library(60))
    questions = asked(spark, [(i, "数学", q) for i, q in enumerate(QUESTIONS)])
    own = rt.candidates(questions, cards, 0, 15).select("qid", "card_id", "cosine")
    plain = {(r["qid"], r["rank"]): r["score"] for r in rt.hybrid_topk(questions, cards, 5).collect()}
    given = {(r["qid"], r["rank"]): r["score"] for r in rt.hybrid_topk(questions, cards, 5, vector_hits=own).collect()}
    assert plain == given and plain


def test_wide_dense_queries_are_not_broadcast(spark, monkeypatch):
    rnd = random.Random(8)
    rows = lambda n, name: spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(n)], f"{name} long, vector array<double>")
    queries, offered = rows(6, "qid").persist(), rows(90, "ord").persist()
    found = lambda: sorted((r.qid, r.rank, r.ord, round(r.score, 12)) for r in rt.dense_topk(queries, offered, 4).collect())
    want = found()
    monkeypatch.setattr(rt, "MAX_BROADCAST_DOUBLES", 6 * 16 - 1)
    monkeypatch.setattr(rt, "_dense_slice", None)
    assert found() == want and len(want) == 24
