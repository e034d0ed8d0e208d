"""The filter audit against plain loops over documents; the registered query is compared with DuckDB in test_oracle.py."""

import random
import re
from itertools import permutations

from cardloom.llm import audit, tries

DOCS = "doc_id bigint, text string, lang string, fails string, node int, least string"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def failed(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return out + "E" * (doc_id is not None and least is not None and doc_id > least)


def brute(rows, labels):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, bad = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    docs = [(lang or "", failed(t or "", d, least.get(t or "")), d in good, d in bad) for d, t, lang, *_ in rows]
    out, shapley = [], {}
    for part in {p for p, *_ in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, letter in enumerate(order, 1):
                here = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                all_ = [d for d in docs if d[0] == part and letter in d[1]]
                row = (len(left), len(here), len(all_) - len(here), sum(d[1] == letter for d in all_), sum(d[2] for d in here), sum(d[3] for d in here))
                out.append((part, "".join(order), step, *row))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(here)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def sample():
    rng, rows = random.Random(5), []
    texts = [" ".join(rng.choice(["Ab", "cd", "EF", "g", "h&i", "é"]) + str(rng.randrange(150)) for _ in range(rng.randrange(80, 140))) for _ in range(60)]
    texts += [t.upper() for t in texts[:20]] + [" ".join(f"w{i}" for i in range(150)) + tail for tail in ("", "x", " ", "xy")]
    texts += ["", None, "a", "ab", "b", "a" * 100_000, "a" * 100_000 + "b", "é", "è", "#"]
    rows = [(rng.randrange(500), rng.choice(texts), rng.choice(["en", "de", None, ""]), "x", 1, "y") for _ in range(300)]
    rows += [(None, texts[3], "en", None, None, None), (None, "only without id", "en", None, None, None)] * 2
    return rows + [(900 + i, texts[0], "fr", None, None, None) for i in range(150)] + rows[:5]


def label_rows():
    rng = random.Random(6)
    return [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "p") for d in range(0, 1000, 2)] + [(4, 1, 1, "p"), (None, 1, 1, "p")]


def got(frame):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, frame.select(*names).collect()))


def test_against_plain_loop(spark):
    docs, labels = spark.createDataFrame(sample(), DOCS), spark.createDataFrame(label_rows(), LABELS)
    want = brute(sample(), label_rows())
    assert got(audit.interactions(docs, labels)) == want
    assert got(audit.interactions(docs.repartition(1), labels)) == want
    assert got(audit.interactions(docs, labels.limit(0))) == brute(sample(), [])
    assert got(audit.interactions(docs.limit(0), labels)) == []


def test_small_tries_and_longer_prefixes(spark, monkeypatch):
    for name, value in {"LOCAL_BYTES": 2_000, "RANGE_BYTES": 3_000, "_BATCH_BYTES": 500, "PREFIXES": (2, 3, 40)}.items():
        monkeypatch.setattr(tries, name, value)
    docs, labels = spark.createDataFrame(sample(), DOCS).repartition(6), spark.createDataFrame(label_rows(), LABELS)
    assert got(audit.interactions(docs, labels)) == brute(sample(), label_rows())


def test_trie():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(400)] + [b"", b"a" * 5000, b"a" * 5001]
    trie, want = tries.Trie(), {}
    for i, text in enumerate(texts):
        end = trie.end_of(text)
        end[2] = min(end[2], i) if end[2] is not None else i
        want[text] = min(want.get(text, i), i)
    assert dict(trie.terminals()) == want
    assert sorted(trie.values()) == sorted(want.values())
    assert trie.held <= sum(map(len, want))
