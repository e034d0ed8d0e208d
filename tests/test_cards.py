import json

import pytest
from pyspark.sql import functions as F

import helpers as h
from cardloom.operators import cards as cd
from cardloom.operators import external as ex
from cardloom.plans import ingest
from cardloom.sources import cards as src
from cardloom.sources import documents as docs


def raw(**fields):
    base = dict(id="1", course="c", chapter="h", topic="t", kind="方法")
    base.update(fields)
    return json.dumps({k: v for k, v in base.items() if v is not ...}, ensure_ascii=False)


def test_validation(spark):
    rows = [
        (raw(), None), (raw(extra=1, steps=["a"]), None), (raw(topic=...), "missing topic"), (raw(kind="其他"), "unknown kind"),
        (raw()[:20], "malformed"), ("7", "malformed"), (raw(steps=["a", None]), "bad steps"), (raw(technique=None), "null technique"),
        (raw(keywords="no list"), "malformed"), (raw(course=..., chapter=...), None), (raw(reference_only=True), None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, raw_json string")
    parsed = cd.parse_cards(df, course=F.lit("deflt"), chapter=F.lit("dc")).orderBy("i").collect()
    assert [p["error"] for p in parsed] == [e for _, e in rows]
    assert (parsed[9]["card"]["course"], parsed[9]["card"]["chapter"], parsed[9]["card"]["keywords"]) == ("deflt", "dc", [])
    assert parsed[10]["card"]["reference_only"] is True and parsed[0]["card"]["technique"] == ""


def test_dedup_and_numbers(spark):
    rows = [
        h.card("x", "甲", ord=5), h.card("y", "甲", ord=2, applicability="first"), h.card("z", "甲", kind="概念", ord=3),
        h.card("w", "乙", chapter="第二章", ord=4), h.card("v", "丙", ord=9),
    ]
    got = {r["ord"]: (r["id"], r["applicability"]) for r in cd.dedup_and_number(h.cards_df(spark, rows).repartition(3)).collect()}
    assert got == {
        2: ("数学|第一章|001", "first"), 3: ("数学|第一章|002", ""), 9: ("数学|第一章|003", ""), 4: ("数学|第二章|001", "")
    }


def test_numbers_beyond_999_and_blocks(spark):
    df = h.cards_df(spark, [h.card(str(i), f"t{i}", ord=i) for i in range(1200)])
    plain = {r["ord"]: r["id"] for r in cd.number_cards(df, ["ord"]).collect()}
    blocked = {r["ord"]: r["id"] for r in cd.number_cards(df, ["ord"], F.floor(F.col("ord") / 100)).collect()}
    assert plain == blocked and plain[1099] == "数学|第一章|1100" and plain[7] == "数学|第一章|008"


def test_upsert(spark):
    old = h.cards_df(spark, [h.card("a", "1", ord=0), h.card("b", "2", ord=1), h.card("a", "other", course="物理", ord=2)])
    new = h.cards_df(spark, [h.card("c", "3", ord=0), h.card("a", "1b", ord=1), h.card("c", "3b", ord=2), h.card("d", "4", ord=3)])
    merged = cd.upsert(old, new).orderBy("ord").collect()
    assert [(r["course"], r["id"], r["topic"], r["is_new"]) for r in merged] == [
        ("数学", "a", "1b", False), ("数学", "b", "2", False), ("物理", "a", "other", False), ("数学", "c", "3b", True), ("数学", "d", "4", True)
    ]
    assert [tuple(r) for r in cd.new_counts(old, new).collect()] == [("数学", 2)]


def test_card_table(spark, tmp_path):
    store = src.CardTable(spark, str(tmp_path / "cards"))
    rows = [h.card("a", "1", ord=0), h.card("b", "2", ord=1), h.card("p", "阅读计划", course="物理", ord=2)]
    assert store.save(h.cards_df(spark, rows)) == 3
    assert store.save(h.cards_df(spark, rows[:1])) == 0
    assert store.save(h.cards_df(spark, [h.card("b", "2b", ord=0), h.card("c", "3", ord=1)])) == 1
    assert sorted((r["course"], r["id"], r["topic"]) for r in store.read().collect()) == [
        ("数学", "a", "1"), ("数学", "b", "2b"), ("数学", "c", "3"), ("物理", "p", "阅读计划")
    ]
    assert [r["course"] for r in store.courses().collect()] == ["数学", "物理"]
    assert store.flag_reference() == 1 and store.flag_reference() == 0
    assert store.read().filter("reference_only").count() == 1


def test_save_reads_only_touched_partitions(spark, tmp_path):
    store = src.CardTable(spark, str(tmp_path / "cards"), buckets=4)
    rows = [h.card(f"{c}{i}", "t", course=c, ord=i) for c in ("数学", "物理", "7") for i in range(40)]
    assert store.save(h.cards_df(spark, rows)) == 120
    batch = h.cards_df(spark, [h.card("数学3", "new", ord=0)])
    plan = store.touched(batch)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :][:400]
    assert "course" in filters and "数学" in filters and "bucket" in filters
    assert 0 < store.touched(batch).count() < 40
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cards").rglob("*.parquet")}
    assert store.save(batch) == 0
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "cards").rglob("*.parquet")}
    assert len(before.items() & kept.items()) >= len(before) * 3 // 4
    assert store.read().count() == 120 and store.read().filter("course = '7'").count() == 40


def test_positions_never_run_out(spark, tmp_path):
    store = src.CardTable(spark, str(tmp_path / "cards"))
    for batch in range(3):
        rows = [h.card(f"b{batch}-{i}", "t", ord=(2_000_000_000 + i) << 32) for i in range(3)]
        assert store.save(h.cards_df(spark, rows)) == 3
    got = [r["id"] for r in store.read().orderBy("ord").collect()]
    assert got == [f"b{b}-{i}" for b in range(3) for i in range(3)]
    assert store.read().agg({"ord": "max"}).first()[0] < 100


def test_jsonl_order_over_many_files(spark, tmp_path):
    rows = [h.card(f"{i:05d}", "t", course=c, ord=n) for n, (c, i) in enumerate((c, i) for c in ("a", "b", "c") for i in range(3000))]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "700")
    src.write_jsonl(h.cards_df(spark, rows).repartition(7), str(tmp_path / "out"))
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "out").rglob("part-*"))) > 3
    back = src.load_cards(spark, [str(p) for p in (tmp_path / "out").iterdir() if p.is_dir()])
    assert back.select("ord").distinct().count() == 9000
    assert [(r["course"], r["id"]) for r in back.orderBy("ord").collect()] == [(r["course"], r["id"]) for r in rows]


def test_failures_are_data(spark, tmp_path):
    chapters = spark.createDataFrame([("c", "good", 0, "x" * 400), ("c", "bad", 1, "y" * 400)], "course string, chapter string, chapter_ord long, text string")

    def model(row):
        if row["chapter"] == "bad":
            return "never JSON"
        return json.dumps({"cards": [{"id": "1", "topic": "t", "kind": "方法"}]})

    told = ingest.answers(ingest.chapter_chunks(chapters), model)
    assert {r["chapter"] for r in ingest.failed_chunks(told).collect()} == {"bad"}
    assert "no JSON object" in ingest.failed_chunks(told).first()["call_error"]
    assert [r["chapter"] for r in ingest.parsed_items(told).select("card.chapter").collect()] == ["good"]
    store = src.CardTable(spark, str(tmp_path / "cards"))
    assert ingest.ingest(chapters, store, model, clean=False, failures_path=str(tmp_path / "failed")) == 1
    assert [r["chapter"] for r in spark.read.json(str(tmp_path / "failed")).collect()] == ["bad"]
    with pytest.raises(ex.Transient):
        ex.raise_for_status(503)
    with pytest.raises(RuntimeError):
        ex.raise_for_status(404)
    ex.raise_for_status(200)


def test_failed_batches_leave_the_others(spark):
    slices = spark.createDataFrame([("a-1", 1), ("b-1", 2)], "stem string, batch_no long")

    def convert(stems):
        if stems == ["b-1"]:
            raise ValueError("no such file")
        return {s: "# x" for s in stems}

    checked = docs.checked_results(slices, ex.convert_slices(slices, convert), ["stem"])
    assert {r["stem"]: (r["md_content"], r["error"]) for r in checked.collect()} == {"a-1": ("# x", None), "b-1": (None, "ValueError: no such file")}


def test_jsonl_round_trip(spark, tmp_path):
    rows = [h.card(f"c{i}", f"t{i}", ord=i) for i in range(300)]
    src.write_jsonl(h.cards_df(spark, rows), str(tmp_path / "out"))
    back = src.load_cards(spark, str(tmp_path / "out" / "*")).orderBy("id").collect()
    assert len(back) == 300
    one = tmp_path / "one.jsonl"
    one.write_text("\n".join(["", raw(id="1"), "broken", "   ", raw(id="2"), raw(topic=...)]) + "\n", encoding="utf-8")
    assert [r["id"] for r in src.load_cards(spark, str(one)).orderBy("ord").collect()] == ["1", "2"]
    assert cd.rejects(src.read_jsonl(spark, str(one))).count() == 2
    assert src.load_cards(spark, str(one)).select("ord").distinct().count() == 2


def test_names(spark):
    for name, safe in [("操作系统", "操作系统"), ("a/b:c", "a_b_c"), (" x.. ", "x"), ("...", "course"), ("a-b 1.2", "a-b 1.2")]:
        assert spark.range(1).select(src.safe_name(F.lit(name)).alias("x")).first()["x"] == safe


def test_code_fence(spark):
    for text, body in [('```json\n{"a":1}\n```', '{"a":1}'), ('x ```\n{}``` y', "{}"), ("  {} ", "{}")]:
        assert spark.range(1).select(cd.strip_code_fence(F.lit(text)).alias("x")).first()["x"] == body


def test_retries_and_repair():
    calls, waits = [], []

    def flaky(row):
        calls.append(row)
        if len(calls) < 3:
            raise ex.Transient("busy")
        return "```json\n{\"cards\": []}\n```"

    assert ex.with_json_repair(ex.with_retries(flaky, sleep=waits.append))({"chunk": "x"}) == '{"cards": []}'
    assert waits == [2, 4]
    answers = iter(["nope", "[1]", '{"ok": 1}'])
    seen = []
    assert ex.with_json_repair(lambda row: (seen.append(row), next(answers))[1])({"a": 1}) == '{"ok": 1}'
    assert "repair" not in seen[0] and seen[2]["repair"]


def test_ingest(spark, tmp_path):
    body = "第一句话在这里讲定义。第二句话讲方法步骤。" * 30
    chapters = spark.createDataFrame(
        [("数学", "极限", 0, body + "\n谢谢观看"), ("数学", "短", 1, "太短"), ("物理", "力", 0, body)],
        "course string, chapter string, chapter_ord long, text string",
    )
    store = src.CardTable(spark, str(tmp_path / "cards"))

    def model(row):
        assert "谢谢观看" not in row["chunk"]
        return json.dumps(
            {"cards": [
                {"id": "z", "topic": "定义", "kind": "概念", "course": "own", "steps": ["一"]},
                {"id": "z", "topic": "定义", "kind": "概念", "steps": ["二"]},
                {"id": "z", "topic": "坏", "kind": "未知"}, 5,
                {"id": "z", "topic": "阅读顺序", "kind": "方法"},
            ]}, ensure_ascii=False)

    assert ingest.ingest(chapters, store, model, chunk_chars=700) == 4
    got = sorted((r["id"], r["topic"], r["steps"], r["reference_only"]) for r in store.read().collect())
    assert got == [
        ("数学|极限|001", "定义", ["一"], False), ("数学|极限|002", "阅读顺序", [], True),
        ("物理|力|001", "定义", ["一"], False), ("物理|力|002", "阅读顺序", [], True),
    ]
    assert ingest.ingest(chapters, store, model, chunk_chars=700) == 0


def test_stand_in_extraction_matches_loop(spark):
    texts = [("c", "h", i, " ".join(f"Sentence number {j} of text {i} is here." for j in range(60))) for i in range(4)]
    chapters = spark.createDataFrame(texts, "course string, chapter string, chapter_ord long, text string")
    got = ingest.to_cards(ingest.extract(ingest.chapter_chunks(chapters, 1000))).orderBy("ord").collect()
    want, seen = [], set()
    for _, _, _, text in texts:
        start = 0
        while True:
            for item in json.loads(ex.sample_cards({"chunk": text[start : start + 1000]}))["cards"]:
                if (item["topic"], item["kind"]) not in seen:
                    seen.add((item["topic"], item["kind"]))
                    want.append((f"c|h|{len(want) + 1:03d}", item["topic"]))
            if start + 1000 >= len(text):
                break
            start += 400
    assert [(r["id"], r["topic"]) for r in got] == want


def test_fallbacks_and_recognition(spark):
    def broken(row):
        raise RuntimeError("blocked")

    assert ex.first_that_works(broken, lambda row: "second")({}) == "second"
    parts = spark.createDataFrame([(1, "a"), (2, "b")], "part_no int, title string")
    heard = lambda row: json.dumps([{"start": 0.5, "end": 2.0, "text": f" {row['title']} "}, {"start": 2.0, "end": 3.0, "text": " "}])
    got = [tuple(r) for r in ex.recognised_segments(parts, heard, ["part_no"]).orderBy("part_no").collect()]
    assert got == [(1, 0, 0.5, 2.0, "a"), (2, 0, 0.5, 2.0, "b")]


def test_converted_slices(spark):
    slices = spark.createDataFrame([("book-1", 1), ("book-2", 1), ("book-3", 2)], "stem string, batch_no long")
    results = ex.convert_slices(slices, lambda stems: {s: f"# {s}" for s in stems if s != "book-2"})
    checked = {r["stem"]: (r["md_content"], r["error"]) for r in docs.checked_results(slices, results, ["stem"]).collect()}
    assert checked == {"book-1": ("# book-1", None), "book-2": (None, "missing result"), "book-3": ("# book-3", None)}
