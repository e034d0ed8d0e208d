import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

import helpers as h
from cardloom.operators import intents, jobs, render
from cardloom.operators import profiles as pf
from cardloom.operators import progress as pg
from cardloom.operators import sessions as ss
from cardloom.operators import transcripts as tr
from cardloom.session import checkpointed
from cardloom.plans import agent_rounds, ask, ingest, notes, teach

T0 = dt.datetime(2024, 1, 1)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# ---- intents ----------------------------------------------------------------


@pytest.mark.parametrize(
    "question, intent",
    [("你好呀", "闲聊"), ("Hello there", "闲聊"), ("今天天气如何", "通识"), ("帮我复习一下第三章", "复习"), ("给我出几道题", "出题"),
     ("什么是虚拟内存", "概念"), ("证明洛必达法则", "答疑"), ("please review it", "复习"), ("preview it", "答疑"), ("这部电影怎么样", "通识")],
)
def test_rule_intent(spark, question, intent):
    assert one(spark, intents.rule_intent(F.lit(question))) == intent


def test_depth(spark):
    depth = lambda q, i, s: round(one(spark, intents.question_depth(F.lit(q), F.lit(i), F.lit(s))), 6)
    assert depth("短", "闲聊", 0.0) == 0.30
    assert depth("证明方程", "答疑", 2.0) == round(0.55 + 0.15 + 0.10 + 0.10, 6)
    assert depth("为什么 page fault 会让这个系统的效率下降这么多呢", "答疑", 1.0) == 1.0


# ---- transcripts ------------------------------------------------------------


def test_captions(spark, tmp_path):
    body = {"events": [
        {"tStartMs": 0, "dDurationMs": 1500, "segs": [{"utf8": "你"}, {"utf8": "好\n"}]}, {"tStartMs": 1500, "segs": [{"utf8": " \n"}]},
        {"tStartMs": 2000, "dDurationMs": 500, "segs": [{"utf8": "世界"}]}, {"tStartMs": 2500},
    ]}
    for name in ("p2.ai-zh.json3", "p2.zh-Hans.json3", "p3.ai-zh.json3"):
        (tmp_path / name).write_text(json.dumps(body, ensure_ascii=False, indent=1), encoding="utf-8")
    files = tr.choose_captions(tr.read_subtitles(spark, str(tmp_path)), ["part_no"])
    got = [(r["part_no"], r["start"], r["end"], r["text"], r["lang"], r["source"]) for r in tr.caption_segments(files, ["part_no"]).orderBy("part_no", "seq").collect()]
    assert got == [
        (2, 0.0, 1.5, "你好", "zh-Hans", "cc"), (2, 2.0, 2.5, "世界", "zh-Hans", "cc"),
        (3, 0.0, 1.5, "你好", "ai-zh", "ai"), (3, 2.0, 2.5, "世界", "ai-zh", "ai"),
    ]


def greedy(starts, gap):
    out, at = [], None
    for s in starts:
        if at is None or s - at >= gap:
            at = s
        out.append(at)
    return out


@pytest.mark.parametrize("block", [30.0, 100.0, 86_400.0])
def test_anchors_match_fold(spark, block):
    rnd = random.Random(3)
    tracks = {p: sorted(round(rnd.uniform(0, 900), 2) for _ in range(n)) for p, n in [(1, 200), (2, 1), (3, 15), (4, 60)]}
    rows = [(p, i, s, f"{p}.{i} ") for p, starts in tracks.items() for i, s in enumerate(starts)]
    df = spark.createDataFrame(rows, "part_no int, seq long, start double, text string").repartition(4)
    got = {(r["part_no"], r["seq"]): r["para_start"] for r in tr.paragraph_starts(df, ["part_no"], 45.0, block).collect()}
    assert got == {(p, i): a for p, starts in tracks.items() for i, a in enumerate(greedy(starts, 45.0))}


def test_paragraph_text(spark):
    rows = [(1, i, 20.0 * i, 20.0 * i + 5, f"句{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "part_no int, seq long, start double, end double, text string")
    text = tr.transcript_text(tr.paragraphs(tr.paragraph_starts(df, ["part_no"]), ["part_no"]), ["part_no"]).first()["text"]
    assert text == "[00:00] 句0句1句2\n[01:00] 句3句4句5\n[02:00] 句6句7句8\n[03:00] 句9"
    totals = tr.transcript_totals(df.withColumn("duration", F.lit(300.0)), ["part_no"], "duration").first()
    assert totals["chars"] == 20 and totals["last_end"] == 185.0 and totals["low_coverage"]
    assert tr.drop_music(spark.createDataFrame([("作曲：某",), ("讲课",)], "text string")).count() == 1


def test_parts_and_links(spark):
    parts = lambda spec: one(spark, tr.chosen_parts(F.lit(spec), F.lit(9)))
    assert parts("") is None and parts(" 1-3,5 ") == [1, 2, 3, 5] and parts("2,99,2") == [2] and parts("99") == [] and parts("7-3") == []
    with pytest.raises(Exception):
        parts("a-3")
    df = h.cards_df(spark, [h.card("1", "t", source_page="[12:35]"), h.card("2", "t", source_page="", ord=1), h.card("3", "t", source_page="末尾", ord=2)])
    got = [(r["source_page"], r["source_url"].split("?")[1]) for r in tr.attach_source(df, F.lit("BV1"), F.lit(2)).orderBy("ord").collect()]
    assert got == [("P2 12:35", "p=2&t=755"), ("P2", "p=2"), ("P2 末尾", "p=2")]
    assert one(spark, tr.video_id(F.lit("https://x/BV1xx411c7mD/?p=1"))) == "BV1xx411c7mD"
    assert one(spark, tr.part_name(F.lit("系列 p03 进程 管理"))) == "进程 管理"
    assert one(spark, tr.part_chapter(F.lit(3), F.lit("a/b: c"))) == "P3 a b  c"


def test_video_chapters(spark):
    rows = [(p, i, 10.0 * i, 10.0 * i + 9, "讲解内容" * (5 if p == 1 else 1)) for p in (1, 2) for i in range(40)]
    rows = [("课", v, *r[:4], v + r[4]) for v in ("BV1", "BV2") for r in rows]
    segments = spark.createDataFrame(rows, "course string, video string, part_no int, seq long, start double, end double, text string")
    titles = [("课", v, p, t) for v in ("BV1", "BV2") for p, t in ((1, "开始"), (2, "短"))]
    parts = spark.createDataFrame(titles, "course string, video string, part_no int, title string")
    chapters = ingest.video_chapters(segments, parts)
    found = {r["video"]: (r["chapter"], r["text"]) for r in chapters.collect()}
    assert {v: c for v, (c, _) in found.items()} == {"BV1": "P1 开始", "BV2": "P1 开始"}
    assert "BV2" not in found["BV1"][1] and "BV1" not in found["BV2"][1]
    cards = h.cards_df(spark, [h.card("1", "t", course="课", chapter="P1 开始", source_page="[00:50]")])
    both = cards.withColumn("video", F.explode(F.array(F.lit("BV1"), F.lit("BV2"))))
    links = sorted(r["source_url"] for r in ingest.video_cards(both, chapters).collect())
    assert len(links) == 2 and "BV1" in links[0] and "BV2" in links[1] and links[0].endswith("p=1&t=50")


# ---- rendering --------------------------------------------------------------

FULL = h.card(
    "数学|一|001", "洛必达", chapter="一", applicability="0/0 型", steps=["判断", "求导"], core_formula_latex="\\lim", technique="先化简",
    worked_example="例" * 601, error_notes=["漏条件", "错用"], keywords=["洛必达"], source_page="P2 12:35", source_url="http://v?t=755",
)


def test_render_methods(spark):
    hits = h.cards_df(spark, [FULL, h.card("2", "空", kind="概念", chapter="二", ord=1)]).select(
        F.lit(1).alias("qid"), (F.col("ord") + 1).cast("int").alias("rank"), F.when(F.col("ord") == 0, 1.125).otherwise(0.5).alias("score"), "*"
    )
    row = render.render_methods(hits).first()
    assert row["methods_text"] == (
        "〔方法1·相关度 1.12 · 一 / 洛必达〕\n- 种类：方法\n- 适用条件：0/0 型\n- 标准步骤：\n   1. 判断\n   2. 求导\n- 核心公式：$\\lim$\n- 技巧：先化简\n- 代表例题："
        + "例" * 600 + " ……\n- 易错点：漏条件；错用\n〔方法2·相关度 0.50 · 二 / 空〕\n- 种类：概念"
    )
    assert (row["n_methods"], row["top_score"]) == (2, 1.125)


def test_card_views(spark):
    assert one(spark, render.card_number(F.lit("课|章|012"))) == 12 and one(spark, render.card_number(F.lit("记忆|知识|abcdef"))) is None
    df = h.cards_df(spark, [FULL]).withColumn("card_id", F.col("id")).withColumn("score", F.lit(0.12345)).withColumn("rank", F.lit(1))
    seen = json.loads(render.previews(df, ["course"]).first()["preview"])
    assert seen == {"hits": [{"id": "数学|一|001", "topic": "洛必达", "kind": "方法", "chapter": "一", "score": 0.123, "applicability": "0/0 型"}]}
    whole = json.loads(df.select(render.card_json().alias("x")).first()["x"])
    assert len(whole["worked_example"]) == 502 and whole["steps"] == ["判断", "求导"]


def test_notes(spark, tmp_path):
    rows = [FULL, h.card("数学|一|1000", "后", chapter="一", kind="易错点", ord=2), h.card("数学|一|999", "前", chapter="一", ord=1)]
    df = h.cards_df(spark, rows)
    notes.write_notes(df, str(tmp_path))
    read = lambda kind: "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / kind / "course=数学").glob("part-*")))
    text = read("notes_md")
    assert text.index("｜洛必达") < text.index("｜前") < text.index("｜后") and "（含 1 张视频卡）" in text and "## 一（3 卡）" in text
    assert text.count("[▶ 跳回视频原时刻](http://v?t=755)") == 1 and "**标准步骤**\n1. 判断\n2. 求导\n\n" in text
    tree = read("mindmap_md")
    assert tree.startswith("# 数学\n\n## 一\n### 洛必达｜🛠 方法\n- 适用：0/0 型\n- 1. 判断\n- 2. 求导\n- 公式：\\lim\n- ⚠ 漏条件\n- ⚠ 错用\n\n### 前")
    page = read("mindmap_html")
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</html>") and page.count("### ") == 3
    notes.write_notes(df, str(tmp_path), kinds="易错点,例题")
    assert read("mindmap_md").count("### ") == 1
    with pytest.raises(ValueError):
        notes.write_notes(df, str(tmp_path), kinds="定理")


def test_job_history(spark):
    stored = spark.createDataFrame(
        [("a", "f1", "queued", None, None), ("b", "f2", "done", "2024-01-02", "2024-01-03"), ("c", "f3", "error", None, "2024-01-09")],
        "jid string, filename string, status string, started_at string, finished_at string",
    )
    live = spark.createDataFrame([("a", "running", "2024-01-05", None), ("x", "running", "2024-01-06", None)], "jid string, status string, started_at string, finished_at string")
    got = [(r["jid"], r["status"]) for r in jobs.job_history(stored, live).collect()]
    assert got == [("c", "error"), ("a", "running"), ("b", "done")]


# ---- plans ------------------------------------------------------------------

LIBRARY = [
    h.card("o1", "死锁 预防", course="操作系统", chapter="死锁", keywords=["死锁", "银行家算法"], applicability="资源分配", steps=["检查安全序列"]),
    h.card("o2", "虚拟内存", kind="概念", course="操作系统", chapter="内存", keywords=["虚拟内存", "分页"], applicability="内存不足", steps=["映射"], ord=1),
    h.card("o3", "页面置换", course="操作系统", chapter="内存", keywords=["页面置换", "LRU"], steps=["选择牺牲页"], ord=2),
]


def test_ask(spark):
    questions = spark.createDataFrame([(1, "操作系统", "怎么预防死锁"), (2, "没有的课", "x")], "qid long, course string, question string")
    rows = {r["qid"]: r for r in ask.ask(questions, h.cards_df(spark, LIBRARY), lambda row: "答:" + row["user"][:8]).collect()}
    assert rows[1]["user"].startswith("【优先参考的教材方法】\n〔方法1·") and "死锁 预防" in rows[1]["user"].split("\n")[1]
    assert rows[2]["user"].startswith("【未命中任何教材方法") and rows[2]["answer"].startswith("答:")
    assert "《操作系统》" in rows[1]["system"]


def test_teach(spark):
    cards = h.cards_df(spark, LIBRARY)
    rows = [(1, "u", "操作系统", "s", "用银行家算法怎么预防死锁", 1), (2, "v", "操作系统", "s", "什么是虚拟内存", 1), (3, "w", "操作系统", "s", "你好", 1), (4, "x", "空课", "s", "算一下", 1)]
    turns = spark.createDataFrame([(*r, T0) for r in rows], "qid long, user_id string, course string, sid string, question string, seq long, ts timestamp")
    people = pf.default_profiles(turns.select("user_id")).withColumn("turn_count", F.when(F.col("user_id") == "u", F.lit(2)).otherwise(F.lit(0)).cast("bigint"))
    entries = spark.createDataFrame([("u", "知识", "死锁 的条件", "四个条件", [], ["死锁"], 1)], "user_id string, bucket string, topic string, content string, examples array<string>, keywords array<string>, ord long")
    memory = pf.memory_cards(entries)
    earlier = spark.createDataFrame([("u", "s", 0, "旧问题", "旧回答", T0)], "user_id string, sid string, turn long, question string, answer string, ts timestamp")
    asked = teach.classified(turns)
    hits = teach.course_hits(asked, cards, people)
    remembered = teach.memory_hits(asked, memory, people)
    prepared = teach.composed(asked, hits, remembered, people, ss.chat_context(earlier))
    answers = checkpointed(teach.answered(prepared, lambda row: "好的"))
    got = {r["user_id"]: r for r in answers.collect()}
    assert {u: r["mode"] for u, r in got.items()} == {"u": "hard", "v": "soft", "w": "general", "x": "general"}
    assert got["u"]["user"].startswith("【近期对话") and "死锁 的条件" in got["u"]["user"] and "【优先参考的教材方法】" in got["u"]["user"]
    assert "【教材方法（仅供对照" in got["v"]["user"] and got["w"]["user"] == "你好" and "过往相关问答" not in got["v"]["user"]
    events = {r["user_id"]: (r["chapter"], r["depth_units"]) for r in teach.study_events(prepared).collect()}
    assert set(events) == {"u", "v"} and events["u"][0] == "死锁" and events["v"][0] == "内存"
    assert pg.chapter_progress(teach.study_events(prepared)).count() == 2
    assert teach.chat_turns(answers).count() == 4
    extractor = lambda row: json.dumps({"items": [{"bucket": "知识", "topic": "记 " + row["question"], "content": "c"}]}, ensure_ascii=False)
    kept = {r["user_id"]: r["bucket"] for r in teach.memory_entries(answers, extractor).collect()}
    assert kept == {"u": "知识", "v": "知识", "x": "通识"}
    assert pf.memory_cards(teach.memory_entries(answers, extractor)).select("id").distinct().count() == 3
    offline = {r["user_id"]: r["answer"] for r in teach.answered(prepared, None).collect()}
    strangers = teach.composed(asked, hits, remembered, people.limit(0), ss.chat_context(earlier))
    assert strangers.filter("system IS NULL OR user IS NULL").isEmpty()
    hints = teach.model_intents(turns, lambda row: json.dumps({"intent": "复习", "stuck_topics": ["死锁", ""]}) if row["qid"] == 1 else "?")
    asked_again = {r["qid"]: r["intent"] for r in teach.classified(turns, hints).collect()}
    assert asked_again[1] == "复习" and asked_again[3] == "闲聊"
    assert [r["item"] for r in pf.capped_list(teach.list_items(hints, "stuck_topics"), 12).collect()] == ["死锁"]
    assert offline["u"].startswith("（离线降级") and offline["w"] == "（离线且未命中任何教材方法）"
    stream = teach.turn_events(prepared, hits, answers).orderBy("qid", "event_no").collect()
    assert [json.loads(r["event"])["type"] for r in stream if r["qid"] == 1] == ["intent", "methods", "done"]
    assert len(json.loads(stream[1]["event"])["methods"]) == 3


def tool_model(row):
    messages = json.loads(row["messages"])
    first = messages[0]["content"]
    if not row["tools"]:
        return json.dumps({"answer": "被迫回答"}, ensure_ascii=False)
    if first.startswith("循环"):
        return json.dumps({"calls": [{"name": "search_methods", "arguments": {"query": "分页"}}]}, ensure_ascii=False)
    told = [m for m in messages if m["role"] == "tool"]
    if not told:
        return json.dumps({"calls": [
            {"name": "search_methods", "arguments": {"query": "页面置换 LRU", "kind": "概念"}}, {"name": "read_card", "arguments": {"card_id": "o3"}},
            {"name": "read_card", "arguments": {"card_id": "none"}}, {"name": "other", "arguments": {}},
        ]}, ensure_ascii=False)
    return json.dumps({"answer": f" 共 {len(told)} 条，" + ("有错" if "error" in told[2]["content"] and "error" in told[3]["content"] else "无错")}, ensure_ascii=False)


def test_a_failing_model_leaves_the_plain_answer(spark):
    def model(row):
        if row["qid"] == 2:
            raise RuntimeError("down")
        return json.dumps({"answer": "ok"})

    questions = spark.createDataFrame([(1, "操作系统", "LRU 是什么"), (2, "操作系统", "LRU 是什么")], "qid long, course string, question string")
    rows = {r["qid"]: r for r in agent_rounds.run(questions, h.cards_df(spark, LIBRARY), model, k=2).collect()}
    assert (rows[1]["answer"], rows[1]["failed"]) == ("ok", None)
    assert rows[2]["answer"].startswith("（离线降级") and "down" in rows[2]["failed"] and rows[2]["rounds"] == 1


def test_tool_rounds(spark):
    questions = spark.createDataFrame([(1, "操作系统", "LRU 是什么"), (2, "操作系统", "循环提问")], "qid long, course string, question string")
    rows = {r["qid"]: r for r in agent_rounds.run(questions, h.cards_df(spark, LIBRARY), tool_model, k=2, max_rounds=3).collect()}
    assert rows[1]["answer"] == "共 4 条，有错" and rows[1]["rounds"] == 2 and rows[1]["tool_calls"] == 4 and not rows[1]["forced_final"]
    assert rows[1]["read_cards"] == ["o3"] and "虚拟内存" in rows[1]["seen_topics"] and "页面置换" in rows[1]["seen_topics"]
    assert rows[1]["trace"][:2] == ["1:search_methods:页面置换 LRU", "1:read_card:o3"] and rows[1]["failed"] is None
    assert rows[2]["answer"] == "被迫回答" and rows[2]["forced_final"] and rows[2]["rounds"] == 3 and rows[2]["tool_calls"] == 3
