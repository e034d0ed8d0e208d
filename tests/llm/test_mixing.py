"""Fair queueing against a plain loop, and the shape of the mix."""

import hashlib
import math
import re
from collections import Counter

import pytest

from cardloom.llm import mixing

DOCS = "doc_id bigint, text string, source string, size int, target string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sized = [(d, len(WORD.findall(t or "")), s) for d, t, s, *_ in rows]
    sources = sorted({s for _, _, s in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, t in sized if t == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in sources if s not in capped]
        rest = total - sum(3 * size[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    target |= {s: 3 * size[s] for s in capped}
    out = []
    for s in sources:
        queue = sorted((hashlib.md5(str("" if d is None else d).encode()).hexdigest(), d or 0, n, d) for d, n, t in sized if t == s)
        left, taken = math.floor(target[s] + 1e-9), [0] * len(queue)
        for _ in range(3):
            for i, (_, _, n, _) in enumerate(queue):
                taken[i] += min(n, left)
                left -= min(n, left)
        out += [(d, n, size[s], pytest.approx(target[s]), taken[i]) for i, (_, _, n, d) in enumerate(queue)]
    return out


def brute_whole(rows):
    """Copies per doc_id where no text is cut: those that end within their source's target, epoch by epoch."""
    target = {s: t.expected for (d, n, size, t, _), s in zip(brute(rows), brute_sources(rows))}
    taken = Counter()
    for source, limit in target.items():
        own = [(hashlib.md5(str(d).encode()).hexdigest(), d, len(WORD.findall(t or ""))) for d, t, s, *_ in rows if s == source]
        end = 0
        for _ in range(3):
            for _, d, n in sorted(own):
                end += n
                if n and end <= math.floor(limit * (1 + 1e-12)):
                    taken[d] += 1
    return taken


def brute_sources(rows):
    """Source of each row of ``brute``, in its order."""
    sources = [s for _, _, s, *_ in rows]
    return [s for s in sorted(set(sources), key=lambda s: (s is None, s or "")) for _ in range(sources.count(s))]


def rows_of(frame, **options):
    queue = mixing.fair_queue(frame, **options)
    return sorted(map(tuple, queue.select("doc.doc_id", "size", "source_size", "target", "taken").collect()), key=lambda r: str(r[:2]))


def sample():
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), f"s{i % 5}", i, "x", 5) for i in range(200)]
    rows += [(1000 + i, "a b\tc\n", "big", i, "x", 5) for i in range(300)]
    rows += [(2000, None, "s1", 1, "x", 0), (2001, "", None, 1, "x", 0), (2002, "one word two", None, None, None, None)]
    rows += [(None, "no id", "s2", 1, "x", 1), (3000, "w " * 5000, "tiny", 1, "x", 1), (3001, "w", "𝔘", 1, "x", 1), (3002, "w", "￮", 1, "x", 1)]
    return rows + [(5, "w w", "s0", 1, "x", 1)] * 2


def test_against_plain_loop(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, DOCS)
    want = sorted(brute(rows), key=lambda r: str(r[:2]))
    got = rows_of(frame)
    assert got == want
    assert rows_of(frame.repartition(7)) == got
    assert all(r[4] <= 3 * r[1] for r in got)


def test_mix_is_ordered_whole_and_cut_to_the_word(spark):
    frame = spark.createDataFrame(sample(), DOCS)
    queue = mixing.fair_queue(frame)
    mix = mixing.mixed(queue)
    assert mix.columns == frame.columns
    rows = mix.collect()
    taken = {(r.doc.doc_id, r.doc.source, r.doc.text): r.taken for r in queue.filter("taken > 0").collect()}
    words = sum(len(WORD.findall(r.text)) for r in rows)
    assert words == sum(r.taken for r in queue.collect())
    texts = {}
    for r in frame.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert all(any(t and t.startswith(r.text) for t in texts[r.doc_id]) for r in rows)
    assert len({(r.doc_id, r.source) for r in rows}) == len({k[:2] for k in taken})
    finish = {}
    for r in queue.collect():
        for c in r.copies:
            finish.setdefault(r.doc.doc_id, []).append(c.finish)
    last = -1.0
    for r in rows:  # each row can be matched with a finish time that does not fall
        last = min(f for f in finish[r.doc_id] if f >= last)


def test_budget_empty_and_wordless(spark):
    frame = spark.createDataFrame(sample(), DOCS)
    total = sum(r[1] for r in rows_of(frame))
    half = sum(r[4] for r in rows_of(frame, budget=total // 2))
    assert total // 2 - 12 <= half <= total // 2
    assert rows_of(frame.limit(0)) == []
    blank = spark.createDataFrame([(1, None, None, 1, "x", 1), (2, " ", "a", 1, "x", 1)], DOCS)
    assert [r[3:] for r in rows_of(blank)] == [(0.0, 0), (0.0, 0)]
    assert mixing.mixed(mixing.fair_queue(blank)).collect() == []


def test_stage_takes_whole_texts(spark):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{i}" for _ in range(5 + i * 7 % 40)), f"s{i % 60:02}", i, "x", 5) for i in range(180)]
    frame = spark.createDataFrame(rows, DOCS)
    texts = {d: t for d, t, *_ in rows}
    words, longest = {}, {}
    for r in corpus_pipeline.mix_sources(spark, frame, "").collect():
        assert r.text == texts[r.doc_id]
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for _, t, s, *_ in rows:
        longest[s] = max(longest.get(s, 0), len(t.split()))
    for r in mixing.fair_queue(frame).select("doc.source", "target").distinct().collect():
        assert -longest[r.source] < words.get(r.source, 0) - r.target <= 1e-6


def test_whole_copy_that_ends_at_the_cut(spark):
    frame = spark.createDataFrame([(1, "a b c", "s", 1, "x", 5), (2, "d e", "s", 1, "x", 3)], DOCS)
    assert sorted(r.text for r in mixing.mixed(mixing.fair_queue(frame, whole=True)).collect()) == ["a b c", "d e"]
