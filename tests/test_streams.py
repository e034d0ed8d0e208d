import datetime as dt
import json
import random

from cardloom.operators import progress as pg
from cardloom.sources.cards import CardTable
from cardloom.streaming.ingest import store_stream
from cardloom.streaming.reviews import box_stream

SCHEMA = "user_id string, card_id string, ok boolean, ts timestamp, seq long"


def test_streamed_boxes_equal_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice("xy"), rnd.random() < 0.7, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i) for i in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        box_stream(stream).writeStream.format("memory").queryName("boxes").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r["seq"]: r["box"] for r in spark.table("boxes").collect()}
    want = {r["seq"]: r["box"] for r in pg.review_boxes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_streamed_cards(spark, tmp_path):
    rows = [json.dumps({"id": str(i % 4), "course": "c", "chapter": "h", "topic": f"t{i}", "kind": "方法"}, ensure_ascii=False) for i in range(6)] + ["bad"]
    spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "raw_json string, ord long").coalesce(1).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("raw_json string, ord long").parquet(str(tmp_path / "in"))
    store = CardTable(spark, str(tmp_path / "cards"))
    store_stream(raw, store, str(tmp_path / "ck"), str(tmp_path / "rejects")).awaitTermination(120)
    assert {r["id"]: r["topic"] for r in store.read().collect()} == {"0": "t4", "1": "t5", "2": "t2", "3": "t3"}
    assert spark.read.json(str(tmp_path / "rejects")).count() == 1
