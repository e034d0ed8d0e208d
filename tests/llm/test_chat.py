"""Preference formatting against a plain loop."""

from cardloom.llm import chat

TURNS = "pair_id bigint, side string, turn bigint, role string, text string, prompt string, c int"


def brute(rows):
    out = []
    for pair in {r[0] for r in rows}:
        sides = []
        for name in ("chosen", "rejected"):
            turns = [((-1, 0) if t is None else (0, t), role or "", text or "") for p, s, t, role, text, *_ in rows if p == pair and s == name]
            sides.append([(role, text) for _, role, text in sorted(turns)])
        if not any(sides):
            continue
        same = 0
        while same < min(map(len, sides)) and sides[0][same] == sides[1][same]:
            same += 1
        show = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
        spans = []
        for side in sides:
            own, at = [], 0
            for role, text in side[same:]:
                start = at + len(f"<|im_start|>{role}\n")
                at = start + len(text) + len("<|im_end|>\n")
                if role == "assistant":
                    own.append((start, at))
            spans.append(own)
        out.append((pair, show(sides[0][:same]), show(sides[0][same:]), show(sides[1][same:]), *spans))
    return sorted(out, key=str)


def test_against_plain_loop(spark):
    rows = []
    for pair in range(40):
        for side in ("chosen", "rejected"):
            for turn in range(2 + pair % 5 + (side == "chosen") * (pair % 3)):
                text = f"turn {turn} é🙂" + (side if turn >= pair % 4 else "")
                rows.append((pair, side, turn, ("system", "user", "assistant")[turn % 3], text, "x", 1))
    rows += [(100, "chosen", 0, "user", "only one side", "x", 1), (101, "chosen", 0, "user", "same", "x", 1), (101, "rejected", 0, "user", "same", "x", 1)]
    rows += [(102, "other", 0, "user", "neither", "x", 1), (None, "chosen", 1, None, None, None, None), (None, "rejected", None, "assistant", None, None, None)]
    rows += [(103, s, 0, "assistant", "twice", "x", 1) for s in ("chosen", "chosen", "rejected")]
    rows += [(104, s, 0, "assistant", "long " * 50_000 + s, "x", 1) for s in ("chosen", "rejected")]
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    got = [(*r[:4], [tuple(s) for s in r[4]], [tuple(s) for s in r[5]]) for r in chat.preference_pairs(frame).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert chat.preference_pairs(frame.limit(0)).collect() == []


def test_spans_cut_out_the_trained_text(spark):
    pairs = chat.preference_pairs(chat.from_conversations(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))).collect()
    assert pairs
    for r in pairs:
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            for start, end in spans:
                assert text[:start].endswith("<|im_start|>assistant\n") and text[:end].endswith("<|im_end|>\n")


def test_no_python_in_the_plan(spark):
    pairs = chat.preference_pairs(chat.from_conversations(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
