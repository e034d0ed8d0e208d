import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import profiles as pf
from cardloom.operators import progress as pg
from cardloom.operators import sessions as ss
from cardloom.plans import documents
from cardloom.scale import ranked, time_block, top_per_key

T0 = dt.datetime(2024, 1, 1)


def blocks():
    return [None, F.floor(F.col("seq") / 7)]


def study_rows(seed=1, n=300):
    rnd = random.Random(seed)
    users = ["hot"] * 5 + ["a", "b"]
    return [
        (rnd.choice(users), "c", rnd.choice(["x", "y", "z", ""]), rnd.choice([0, 200_000, 550_000, 1_000_000]), T0 + dt.timedelta(hours=i), i)
        for i in range(n)
    ]


STUDY = "user_id string, course string, chapter string, depth_units long, ts timestamp, seq long"


@pytest.mark.parametrize("index", [0, 1])
def test_curve_matches_fold(spark, index):
    rows = study_rows()
    curve = pg.progress_curve(spark.createDataFrame(rows, STUDY).repartition(5), blocks()[index])
    got = {(r["user_id"], r["seq"]): (r["q"], r["pct"]) for r in curve.collect()}
    deepest, count = {}, {}
    for user, _, chapter, depth, _, seq in rows:
        mine = deepest.setdefault(user, {})
        mine[chapter] = max(mine.get(chapter, 0), depth)
        count[user] = count.get(user, 0) + 1
        pct = round(min(sum(mine.values()) / len(mine) / 1_000_000, 1.0) * 100)
        assert got[(user, seq)] == (count[user], pct)
    totals = {r["user_id"]: (r["questions"], r["percent"]) for r in pg.course_percent(spark.createDataFrame(rows, STUDY)).collect()}
    for user, mine in deepest.items():
        assert totals[user] == (count[user], round(min(sum(mine.values()) / len(mine) / 1_000_000, 1.0) * 100))


def test_daily_rollup(spark):
    rows = [("u", "c", "x", d, T0 + dt.timedelta(days=day, hours=h), day * 10 + h) for day in range(20) for h, d in enumerate([0, 300_000])]
    rows += [("v", "c", "x", 0, T0, 0)]
    curve = pg.progress_curve(spark.createDataFrame(rows, STUDY))
    days = {(r["user_id"], r["day"]): (r["questions"], r["pct"]) for r in pg.daily_rollup(curve).collect()}
    assert len(days) == 15 and days[("u", "2024-01-20")] == (2, 30) and days[("v", "2024-01-01")] == (1, 0)
    assert ("u", "2024-01-06") not in days and ("u", "2024-01-07") in days
    today = {r["user_id"]: r["today_questions"] for r in pg.today_questions(curve, "2024-01-20").collect()}
    assert today == {"u": 2, "v": 0}


REVIEWS = "user_id string, card_id string, ok boolean, ts timestamp, seq long"


@pytest.mark.parametrize("index", [0, 1])
def test_boxes_match_fold(spark, index):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), rnd.choice("xyyy"), rnd.random() < 0.75, T0 + dt.timedelta(minutes=i), i) for i in range(400)]
    boxed = pg.review_boxes(spark.createDataFrame(rows, REVIEWS).repartition(6), blocks()[index])
    got = {r["seq"]: r["box"] for r in boxed.collect()}
    box = {}
    for user, card, ok, _, seq in rows:
        box[user, card] = min(box.get((user, card), 1) + 1, 5) if ok else 1
        assert got[seq] == box[user, card]
    assert {(r["user_id"], r["card_id"]): r["box"] for r in pg.current_boxes(boxed).collect()} == box


def test_review_example(spark):
    rows = [("u", c, ok, T0, i) for i, (c, ok) in enumerate([("A", True), ("A", True), ("A", False), ("B", True)])]
    df = spark.createDataFrame(rows, REVIEWS)
    assert [r["box"] for r in pg.review_boxes(df).orderBy("seq").collect()] == [2, 3, 1, 2]
    stats = pg.review_stats(df).first()
    assert (stats["total"], stats["correct"], stats["wrong"], stats["accuracy"], stats["boxes"]) == (4, 3, 1, 0.75, 2)
    capped = pg.review_stats(df, cap=2).first()
    assert (capped["total"], capped["correct"], capped["boxes"]) == (2, 1, 2)


def test_time_block_is_measured(spark):
    df = spark.createDataFrame(study_rows(), STUDY)
    assert time_block(df, ["user_id"], "ts") is None
    block = time_block(df, ["user_id"], "ts", rows_per_block=20)
    sizes = df.groupBy("user_id", block.alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 45 and sizes.filter("user_id = 'hot'").count() >= 10
    plain = sorted(map(tuple, pg.progress_curve(df).collect()))
    assert plain == sorted(map(tuple, pg.progress_curve(df, block).collect()))


def test_nulls_do_not_depend_on_blocks(spark):
    """Null users, courses and times keep their rows and values, whether a key is blocked or not."""
    rows = study_rows(n=60) + [(None, "c", "x", 5, T0, 1000), (None, "c", "x", 9, T0, 1001), ("a", None, "y", 5, T0, 1002)]
    rows += [("hot", "c", "x", 7, None, 1003), ("hot", "c", None, 7, None, 1004)]
    df = spark.createDataFrame(rows, STUDY).repartition(3)
    block = time_block(df, ["user_id", "course"], "ts", rows_per_block=5)
    plain = sorted(map(str, pg.progress_curve(df).collect()))
    assert len(plain) == len(rows) and plain == sorted(map(str, pg.progress_curve(df, block).collect()))
    answers = spark.createDataFrame(
        [(u, c, s % 3 > 0, t, s) for u, _, c, _, t, s in rows], "user_id string, card_id string, ok boolean, ts timestamp, seq long"
    )
    block = time_block(answers, ["user_id", "card_id"], "ts", rows_per_block=5)
    plain = sorted(map(str, pg.review_boxes(answers).collect()))
    assert len(plain) == len(rows) and plain == sorted(map(str, pg.review_boxes(answers, block).collect()))


def test_ranked(spark):
    df = spark.range(1000).select(F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("string")).alias("path")).distinct()
    got = {r["path"]: r["i"] for r in ranked(df.repartition(7), "path", "i").collect()}
    assert got == {p: i for i, p in enumerate(sorted(got))}


def test_salted_top(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")))
    order = [F.desc("id")]
    plain = sorted(map(tuple, top_per_key(df, ["k"], order, 4).collect()))
    assert plain == sorted(map(tuple, top_per_key(df, ["k"], order, 4, salt=F.col("id")).collect()))


def test_capped_list_may_take_an_item_again(spark):
    rnd = random.Random(4)
    rows = [(u, s, p, rnd.choice(" abcdefgh"), ) for u in ("u", "v") for s in range(120) for p in range(2)]
    rows += [("few", 3, 0, "q"), ("few", 1, 0, " r "), ("few", 9, 0, "q"), ("few", 10, 0, None)]
    got = {}
    for r in pf.capped_list(spark.createDataFrame(rows, "user_id string, seq long, pos long, item string").repartition(5), 3).collect():
        got.setdefault(r["user_id"], {})[r["place"]] = r["item"]
    want, last = {}, {}
    for user, seq, _, item in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held = want.setdefault(user, [])
        if last.get(user) != seq:
            want[user] = held = held[-3:]
            last[user] = seq
        item = (item or "").strip()
        if item and item not in held:
            held.append(item)
    assert {u: [v[i] for i in sorted(v)] for u, v in got.items()} == {u: v[-3:] for u, v in want.items()}


def test_expression_notes(spark):
    rnd = random.Random(6)
    notes = [("u", i, "".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randint(1, 6)))) for i in range(80)] + [("v", 0, "")]
    got = {r["user_id"]: r["expression_notes"] for r in pf.expression_notes(spark.createDataFrame(notes, "user_id string, seq long, note string"), 40).collect()}
    text = ""
    for _, _, note in notes[:-1]:
        if note not in text:
            text = (text + "；" + note).strip("；")[:40]
    assert got == {"u": text}


def test_expression_notes_that_end_in_the_separator(spark):
    notes = [("u", 0, "abc；"), ("u", 1, "abc；"), ("u", 2, "x"), ("v", 0, "；"), ("v", 1, "y"), (None, 0, "z")]
    got = {r["user_id"]: r["expression_notes"] for r in pf.expression_notes(spark.createDataFrame(notes, "user_id string, seq long, note string")).collect()}
    assert got == {"u": "abc；abc；x", "v": "y", None: "z"}


def test_preamble(spark):
    users = spark.createDataFrame([("u",)], "user_id string")
    plain = pf.default_profiles(users).select(pf.preamble().alias("p")).first()["p"]
    assert plain == pf.default_preamble()
    assert plain == "你是面对一位初级水平学生的一对一助教。 讲解风格：推导、易错点。"
    items = lambda xs: spark.createDataFrame([("u", i, 0, x) for i, x in enumerate(xs)], "user_id string, seq long, pos long, item string")
    lists = {
        "weak_topics": pf.capped_list(items([f"题{i}" for i in range(8)]), 12),
        "common_mistakes": pf.capped_list(items(["漏解"]), 12),
        "general_notes": pf.general_notes(items(["天气" * 40])),
    }
    notes = spark.createDataFrame([("u", "口语")], "user_id string, expression_notes string")
    turns = spark.createDataFrame([("u", 1), ("u", 2)], "user_id string, seq long")
    row = pf.profiles(users, turns, lists, notes).withColumn("p", pf.preamble()).first()
    assert row["turn_count"] == 2 and row["general_notes"] == ["天气" * 15] and len(row["weak_topics"]) == 8
    assert "『题0、题1、题2、题3、题4、题5』" in row["p"] and "曾犯『漏解』类错误" in row["p"] and row["p"].endswith("不必特意提及。")


def test_memory_cards(spark):
    rows = [("u", "知识", "极限", "要点", ["x"], ["k"], 1), ("u", "语义表意", "", "", ["原话", ""], None, 2), ("u", "知识", "极限", "要点", ["x"], ["k"], 3)]
    df = spark.createDataFrame(rows, "user_id string, bucket string, topic string, content string, examples array<string>, keywords array<string>, ord long")
    got = pf.memory_cards(df).orderBy("ord").collect()
    assert got[0]["id"] == got[2]["id"] and got[0]["id"].startswith("记忆|知识|") and len(got[0]["id"].split("|")[2]) == 10
    assert got[0]["course"] == "用户·u·知识" and got[0]["steps"] == ["要点"] and got[0]["keywords"] == ["k"]
    assert (got[1]["topic"], got[1]["keywords"], got[1]["applicability"]) == ("未命名", ["原话"], "该生措辞习惯")
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    counts = {(r["user_id"], r["bucket"]): r["n_cards"] for r in pf.memory_counts(users, pf.memory_cards(df).dropDuplicates(["id"])).collect()}
    assert len(counts) == 10 and counts["u", "知识"] == 1 and counts["v", "知识"] == 0


TURNS = "user_id string, sid string, turn long, question string, answer string, ts timestamp"


def test_context_titles_and_list(spark):
    rows = [("u", "s", i, f"问题{i}" + "长" * 400, f"回答{i}" + "文" * 600, T0 + dt.timedelta(minutes=i)) for i in range(8)]
    rows += [("u", "t", 1, " \n ", "x", T0 + dt.timedelta(days=1)), ("u", "t", 2, "什么是\n极限", None, T0 + dt.timedelta(days=2))]
    df = spark.createDataFrame(rows, TURNS)
    text = {r["sid"]: r["context"] for r in ss.chat_context(df).collect()}
    assert text["s"].count("学生问：") == 5 and "问题2" not in text["s"] and text["s"].index("问题3") < text["s"].index("问题7")
    assert "长" * 297 in text["s"] and "长" * 298 not in text["s"] and "文" * 497 in text["s"] and "文" * 498 not in text["s"]
    titles = {r["sid"]: r["title"] for r in ss.session_titles(df).collect()}
    assert titles == {"s": "问题0" + "长" * 11 + "…", "t": "什么是 极限"}
    given = spark.createDataFrame([("u", "s", "会话 2"), ("u", "t", "我的"), ("u", "z", "会话 3")], "user_id string, sid string, title string")
    titles = {r["sid"]: r["title"] for r in ss.session_titles(df, given).collect()}
    assert titles == {"s": "问题0" + "长" * 11 + "…", "t": "我的", "z": "会话 3"}
    listed = ss.session_list(df, cap=6).orderBy(F.desc("updated")).collect()
    assert [(r["sid"], r["count"]) for r in listed] == [("t", 2), ("s", 6)]
    assert ss.history(df, 3).filter("sid = 's'").count() == 3


def test_session_actions(spark):
    steps = [
        ("u", 1, "new", "a"), ("u", 2, "new", "b"), ("u", 3, "switch", "a"), ("u", 4, "switch", "zzz"), ("u", 5, "clear", "a"),
        ("u", 6, "delete", "b"), ("u", 7, "switch", "b"), ("v", 1, "new", "a"), ("v", 2, "delete", "a"), ("v", 3, "delete", "default"),
        ("w", 1, "switch", "default"), ("w", 2, "new", "q"), ("w", 3, "switch", "default"),
    ]
    df = spark.createDataFrame([(*s, "t") for s in steps], "user_id string, seq long, action string, sid string, title string")
    for block in (None, F.floor(F.col("seq") / 2)):
        current = {r["user_id"]: r["current_session"] for r in ss.current_sessions(df, block).collect()}
        assert current == {"u": "a", "v": "default", "w": "default"}
    state = {(r["user_id"], r["sid"]): r["cleared_seq"] for r in ss.session_state(df).collect()}
    assert ("u", "a") in state and state["u", "a"] == 5 and ("u", "b") not in state and ("v", "default") in state


def test_actions_reach_context_history_and_list(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    turns = [("u", s, i, f"{s}{i}", "x", at(i)) for s in ("a", "b", "c", "default") for i in range(1, 6)]
    steps = [
        ("u", 1, "new", "a", "Mine", at(0)), ("u", 2, "clear", "a", None, at(3)), ("u", 3, "delete", "b", None, at(9)),
        ("u", 4, "new", "e", "会话 2", at(4)), ("u", 5, "delete", "c", None, at(2)), ("u", 6, "new", "c", "会话 3", at(2.5)),
        ("u", 7, "delete", "default", None, at(9)), ("w", 1, "switch", "default", None, at(1)),
    ]
    turns = spark.createDataFrame(turns, TURNS)
    actions = spark.createDataFrame(steps, "user_id string, seq long, action string, sid string, title string, ts timestamp")
    kept = {}
    for r in ss.history(turns, actions=actions).collect():
        kept.setdefault(r["sid"], set()).add(r["turn"])
    assert kept == {"a": {4, 5}, "c": {3, 4, 5}, "default": {1, 2, 3, 4, 5}}
    text = {r["sid"]: r["context"] for r in ss.chat_context(turns, actions=actions).collect()}
    assert set(text) == set(kept) and "a3" not in text["a"] and "a4" in text["a"]
    listed = {(r["user_id"], r["sid"]): (r["title"], r["count"]) for r in ss.session_list(turns, actions=actions).collect()}
    assert listed == {
        ("u", "a"): ("Mine", 2), ("u", "c"): ("c3", 3), ("u", "e"): ("会话 2", 0), ("u", "default"): ("default1", 5), ("w", "default"): ("默认会话", 0),
    }
    state = {(r["user_id"], r["sid"]) for r in ss.session_state(actions).collect()}
    assert state == {("u", "a"), ("u", "c"), ("u", "e"), ("u", "default"), ("w", "default")}


def test_documents(spark, tmp_path):
    log = spark.createDataFrame(study_rows(), STUDY)
    docs = {r["user_id"]: r for r in documents.progress_documents(log, "2024-01-03").collect()}
    hot = docs["hot"]
    mine = [r for r in study_rows() if r[0] == "hot"]
    assert hot["questions"] == len(mine) == hot["curve"][-1]["q"] and hot["percent"] == hot["curve"][-1]["pct"]
    assert set(hot["chapters"]) == {"x", "y", "z", "(未分章)"} and hot["chapters"]["x"]["depth_max"] == 1.0
    assert hot["today_questions"] == sum(r[4].date() == dt.date(2024, 1, 3) for r in mine) and hot["daily"][-1]["day"] == "2024-01-13"
    people = pf.default_profiles(spark.createDataFrame([("hot",), ("new",)], "user_id string"))
    reviews = spark.createDataFrame([("hot", "A", True, T0, 1)], REVIEWS)
    memory = spark.createDataFrame([("用户·hot·知识",)], "course string")
    full = {r["user_id"]: r for r in documents.profile_documents(people, log, reviews, memory).collect()}
    assert full["hot"]["memory_buckets"]["知识"] == 1 and full["new"]["memory_buckets"]["知识"] == 0
    assert full["hot"]["course_progress"]["c"]["questions"] == len(mine) and full["hot"]["reviews_stats"]["boxes"] == 1
    documents.write_profiles(people.withColumn("level", F.lit("高级")), str(tmp_path / "p"))
    (tmp_path / "p" / "broken.json").write_text("{not json", encoding="utf-8")
    users = spark.createDataFrame([("hot",), ("third",)], "user_id string")
    assert {r["user_id"]: r["level"] for r in documents.read_profiles(spark, str(tmp_path / "p"), users).collect()} == {"hot": "高级", "third": "初级"}


@pytest.fixture
def eager_skew_join(spark):
    """Settings under which the adaptive skew join splits even small hot keys."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_user_under_skew_join(spark, eager_skew_join):
    """A split hot key must not split the fold: one list of at most ``cap`` items per user."""
    base = spark.range(40_000).repartition(8)
    items = base.select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 20).alias("user_id"), F.col("id").alias("seq"),
        F.lit(0).alias("pos"), F.concat(F.lit("t"), (F.col("id") * 7 % 40).cast("string")).alias("item"),
    )
    got = {}
    for r in pf.capped_list(items, 12).collect():
        got.setdefault(r["user_id"], []).append((r["place"], r["item"]))
    want = {}
    for r in sorted(items.collect(), key=lambda r: r["seq"]):
        held = want.setdefault(r["user_id"], [])
        if r["item"] not in held:
            held.append(r["item"])
            del held[:-12]
    assert {u: [i for _, i in sorted(v)] for u, v in got.items()} == want


def test_blocks_under_skew_join(spark, eager_skew_join):
    df = spark.createDataFrame(study_rows(n=3000), STUDY).repartition(8)
    block = time_block(df, ["user_id", "course"], "ts", rows_per_block=100)
    assert sorted(map(tuple, pg.progress_curve(df).collect())) == sorted(map(tuple, pg.progress_curve(df, block).collect()))
