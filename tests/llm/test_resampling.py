"""Importance resampling against a plain loop; the registered query is compared with DuckDB in test_oracle.py."""

import hashlib
import math
import re
import zlib
from collections import Counter

from cardloom.llm import resampling

DOCS = "doc_id bigint, text string, score int, codes string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def features(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, max_n=1, buckets=10_000, percent=10, least=20):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, max_n)[1])
    s, t = count(r[1] for r in rows), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, text, *_ in rows:
        n, found = features(text, max_n)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def sample():
    rows = [(i, " ".join(f"w{(i * j * 7) % 91}" for j in range(i % 60)), 1, "x") for i in range(150)]
    rows += [(200 + i, t, None, None) for i, t in enumerate([None, "", " .,;", "one", "ÄÖ É-ß _a_ 𝔘x\x00y\x7fZ", "A b\tc\n\n D  e"])]
    rows += [(300, "long " * 30_000, 1, "x"), (301, "x" * 200_000, 1, "x"), (None, "no id " * 20, 1, "x"), (7, rows[149][1], 1, "x")]
    return rows + [rows[59]] * 3


TARGET = ["w1 w2 w3 w7 W7 w7", None, "", "long no"]


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_against_plain_loop(spark):
    frame, target = spark.createDataFrame(sample(), DOCS), spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    for options in ({}, {"max_n": 3, "percent": 35, "buckets": 97}, {"max_n": 2, "buckets": 100_000}):
        want = brute(sample(), TARGET, **options)
        assert got(resampling.resample(frame, target, **options)) == want
        assert any(r[4] for r in want)
    assert got(resampling.resample(frame.repartition(9), target)) == brute(sample(), TARGET)


def test_empty_tables(spark):
    frame, target = spark.createDataFrame(sample(), DOCS), spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert got(resampling.resample(frame.limit(0), target)) == []
    assert got(resampling.resample(frame, target.limit(0))) == brute(sample(), [])


def test_spans_overlap_and_stop_at_words():
    text = "The  cat,sat -- ON".encode()
    plain = resampling.collapsed(text)
    assert plain == b"the cat sat on"
    assert [plain[a:b] for a, b in resampling.spans(text, 2)] == [b"the", b"cat", b"sat", b"on", b"the cat", b"cat sat", b"sat on"]
    assert resampling.spans(None) == resampling.spans(b" .") == []
