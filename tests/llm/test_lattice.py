"""Lattice scores against enumeration of segmentations and plain loops over documents."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cardloom.llm import lattice

DOCS = "doc_id bigint, text string, word string, part int, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def segmentations(token, pieces):
    if not token:
        yield []
    for n in range(1, len(token) + 1):
        if token[:n] in pieces:
            for rest in segmentations(token[n:], pieces):
                yield [token[:n], *rest]


def small():
    pieces = sorted({b" ", b" a", b" ab", b"ab", b"ba", b"aba", b"bab", *[bytes([b]) for b in range(256)]})
    return lattice.Lattice(pieces, np.arange(1.0, len(pieces) + 1))


WORDS = [b"a", b"ab", b"abab", b"bababa", "é".encode(), b"abcab", b"ab", b"bb" * 5]


def test_marginal_and_expected_counts_are_sums_over_segmentations():
    own = small()
    weight = dict(zip(own.pieces, np.exp(own.log)))
    used = Counter()
    for word, log in zip(WORDS, own.log_marginals(WORDS)):
        ways = [(way, math.prod(weight[p] for p in way)) for way in segmentations(b" " + word, weight)]
        whole = sum(w for _, w in ways)
        assert log == pytest.approx(math.log(whole), abs=1e-9)
        for way, w in ways:
            for piece in way:
                used[piece] += w / whole
    found = own.expected(WORDS)
    assert [found[i] for i, p in enumerate(own.pieces)] == pytest.approx([used[p] for p in own.pieces], abs=1e-9)


def test_long_tokens_follow_the_same_recursion(monkeypatch):
    own, words = small(), [b"ab" * 20, b"abcba" * 11, bytes(range(128, 190))]
    logs, used = own.log_marginals(words), own.expected(words)
    monkeypatch.setattr(lattice, "_SHORT", 0)
    assert own.log_marginals(words) == pytest.approx(logs, abs=1e-9)
    assert own.expected(words) == pytest.approx(used, abs=1e-9)
    assert own.log_marginals([b"ab" * 50_000])[0] == pytest.approx(own.log_marginals([b"ab" * 25_000])[0] * 2, rel=1e-3)


def test_tokens_sum_to_one_at_most():
    own = lattice.Lattice([b" ", b" a", b"a", b"b", b"ab"], np.array([1.0, 2.0, 1.0, 3.0, 1.0]))
    total, words = 0.0, [b"a", b"b"]
    for _ in range(13):
        total += np.exp(own.log_marginals(words)).sum()
        words = [w + c for w in words for c in (b"a", b"b")]
    assert 0.5 < total <= 1.0


def sample():
    rng = random.Random(4)
    parts = ["ab", "ion", "zu", "é", "K"]
    rows = [(i, " ".join("".join(rng.choices(parts, k=rng.choice([1, 1, 1, 2, 3, 4]))) for _ in range(rng.randrange(60))), "x", 1, 0.5) for i in range(120)]
    rows += [(200 + i, t, None, None, None) for i, t in enumerate([None, "", " \n", "A\tb\x1cc d", "Ab ab AB", "x" * 3_000, "many " * 20_000])]
    return rows + [(None, "no id at all", "x", 1, 0.5), *rows[:2]]


def brute(rows, model):
    """The contract's counts, and the score from the model's weights by a dictionary recursion."""
    tokens = lambda t: WORD.findall((t or "").translate(LOWER))
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    c, ends = Counter(), 0
    for d, t, *_ in rows:
        if not held(d):
            c.update(tokens(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    once, twice = (sum(k == i for k in c.values()) for i in (1, 2))
    discount = min(0.9, max(0.1, once / (once + 2 * twice)))
    weight = dict(zip(model.lattice.pieces, np.exp(model.lattice.log)))

    def spelled(word):
        token = b" " + word.encode()
        alpha = [1.0] + [0.0] * len(token)
        for end in range(1, len(token) + 1):
            alpha[end] = sum(alpha[s] * weight.get(token[s:end], 0.0) for s in range(max(0, end - model.lattice.longest), end))
        return alpha[-1]

    out = []
    for d, t, *_ in rows:
        words = tokens(t)
        if any(len(w) > 100 for w in words):  # plain products underflow
            continue
        p = [max(c[w] - discount, 0) / n + discount * v / n * (1 - lattice.END_SHARE) * spelled(w) for w in set(words)]
        times = Counter(words)
        score = sum(times[w] * math.log10(x) for w, x in zip(set(words), p)) + math.log10((ends - discount) / n + discount * v / n * lattice.END_SHARE)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        out.append((d, held(d), len(words) + 1, sum(c[w] > 0 for w in words) + 1, n, pytest.approx(base), pytest.approx(score)))
    return out


def models(spark, frame):
    held = lattice.fold(lattice.F.col("doc_id"), 7) == 2
    rows = frame.select((~held).alias("learns"), lattice.F.col("text").cast("binary").alias("text"))
    return lattice.train(lattice.checkpointed(lattice.word_counts(rows)), rows.filter("learns").count(), lattice.default_vocabulary())


@pytest.mark.parametrize("hot, held", [(1 << 20, 1 << 18), (20, 3)])
def test_against_plain_loop(spark, monkeypatch, hot, held):
    monkeypatch.setattr(lattice, "HOT", hot)
    monkeypatch.setattr(lattice, "_HELD", held)
    frame = spark.createDataFrame(sample(), DOCS)
    want = brute(sample(), models(spark, frame))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r)[:7] for r in lattice.score(frame).collect()), key=order)
    assert len(got) == len(sample())
    assert [r for r in got if r[0] != 205] == sorted(want, key=order)
    long = next(r for r in got if r[0] == 205)
    assert long[2] == 2 and math.isfinite(long[6])


def test_no_rows_and_nothing_to_learn(spark):
    frame = spark.createDataFrame(sample(), DOCS)
    assert lattice.score(frame.limit(0)).collect() == []
    held = frame.filter(lattice.fold(lattice.F.col("doc_id"), 7) == 2)
    rows = lattice.score(held).collect()
    assert rows and all(r.train_tokens == r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_held_out_documents(spark):
    """Training pays on unseen documents; where all words are known the score is that of good word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lattice.score(docs).filter("held_out").collect()
    raw = {r.doc_id: r for r in lattice.score(docs, rounds=0).filter("held_out").collect()}
    total = lambda name, found: sum(r[name] for r in found)
    assert total("score", rows) > total("lattice_score", rows) > total("lattice_score", raw.values())
    known = [r for r in rows if r.n_known == r.n_tokens]
    assert len(known) > 20 and total("score", known) > 1.05 * total("base_score", known)
