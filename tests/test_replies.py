"""Assembled replies: batch against a plain fold, and the stream against the batch, restart included."""

import random

from cardloom.operators import replies
from cardloom.streaming.replies import reply_stream


def events():
    rng, out = random.Random(3), []
    for r in range(40):
        seq, size = [], rng.randrange(0, 30)
        for _ in range(size):
            pick = rng.randrange(3) if r % 2 else 0
            if pick == 0:
                seq.append((rng.choice(["ab", "é ", "", None, "尾"]), None, None, None, None))
            else:
                seq.append((None, rng.choice([0, 2, 11]), rng.choice(["", None, f"id{r}"]), rng.choice(["", "na", None]), rng.choice(['{"a', '":1}', None])))
        rows = [(f"r{r}", i, *s, False) for i, s in enumerate(seq)] + [(f"r{r}", size, None, None, None, None, None, True)]
        if r == 7:
            rows.pop()  # never ends
        if r == 8 and size:
            rows.pop(0)  # a fragment is missing
        out += rows
    out += [("long", i, f"{i},", None, None, None, None, i == 3500) for i in range(3501)]
    rng.shuffle(out)
    return out


def fold(rows):
    done = {}
    for reply in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == reply), key=lambda r: r[1])
        if [r[1] for r in own] != list(range(len(own))) or not own[-1][7]:
            continue
        text, calls = "", {}
        for _, _, piece, index, call_id, name, arguments, _ in own:
            if index is None:
                text += piece or ""
            else:
                call = calls.setdefault(index, ["", "", ""])
                call[0] = call_id or call[0]
                call[1] += name or ""
                call[2] += arguments or ""
        done[reply] = ("tool_calls", "", [(i, *calls[i]) for i in sorted(calls)]) if calls else ("text", text, [])
    return done


def as_dict(frame):
    found = [(r.reply, (r.kind, r.text, [tuple(c) for c in r.calls])) for r in frame.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_batch_is_a_fold(spark):
    rows = events()
    assert as_dict(replies.assembled(spark.createDataFrame(rows, replies.EVENTS))) == fold(rows)
    assert as_dict(replies.assembled(spark.createDataFrame([], replies.EVENTS))) == {}


def test_stream_is_the_batch_over_a_restart(spark, tmp_path):
    rows = [r for r in events() if r[0] != "long" or r[1] < 0]

    def run(part):
        spark.createDataFrame(part, replies.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(replies.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = (
            reply_stream(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination(200)
        assert query.exception() is None

    for at in range(0, len(rows), len(rows) // 2 + 1):
        run(rows[at : at + len(rows) // 2 + 1])
    assert as_dict(spark.read.schema(replies.REPLY).parquet(str(tmp_path / "out"))) == fold(rows)
