"""Partial matching against a plain context tree, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardloom.llm import language

DOCS = "doc_id bigint, text string, lang string, score string, p int, lang_pred string"


def brute_bits(samples, text):
    """Code length of a text after samples, with nested dictionaries."""
    seen = defaultdict(Counter)
    for sample in samples:
        data = b"\n" * language.ORDER + sample.encode().lower()
        for i in range(language.ORDER, len(data)):
            for order in range(language.ORDER + 1):
                seen[data[i - order : i]][data[i]] += 1
    bits, data = 0.0, b"\n" * language.ORDER + text.encode().lower()
    for i in range(language.ORDER, len(data)):
        for order in range(language.ORDER, -2, -1):
            if order < 0:
                bits += 8
                break
            after = seen.get(data[i - order : i])
            if not after:
                continue
            room = sum(after.values()) + len(after)
            if data[i] in after:
                bits -= math.log2(after[data[i]] / room)
                break
            bits -= math.log2(len(after) / room)
    return bits


def model_of(samples):
    trees = {}
    for lang, texts in samples.items():
        grams, n = np.unique(np.concatenate([language._grams(t.encode()) for t in texts]), return_counts=True)
        trees[lang] = language.Tree(grams, n)
    return language.Model(trees)


def test_exact_code_lengths():
    samples = {"a": ["the cat sat on the mat. the end", "another cat"], "b": ["der hund und die katze", "ende gut"]}
    model = model_of(samples)
    for text in ["the cat", "Der Hund", "zzz qqq", "", "éß 123", "the cat sat on the mat" * 50]:
        want = [brute_bits(samples[lang], text) for lang in model.langs]
        for _ in range(2):  # computed, then from the table
            assert model.code_lengths(text) == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_letters_and_ties():
    model = model_of({"b": ["one and the same text"], "a": ["one and the same text"]})
    for text in (None, "", " ", "12 ½ ² ① Ⅷ _ ٣", "!\ud800"):  # numbers, not letters, though regular expressions count some as word characters
        assert model.predict(text) == (language.UNKNOWN, 0.0)
    for text in ("é", "² б", "語", "ª"):
        assert model.predict(text) == ("a", pytest.approx(0.5))  # equal code lengths: the first language in code point order


def test_held_out_accuracy(spark):
    from cardloom.llm.catalogue import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_language"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(i, ("the quick brown fox jumps " if i % 2 else "der schnelle braune fuchs springt ") * 3, "en" if i % 2 else "de", "s", i, "x") for i in range(60)]
    rows += [(100, None, "en", None, None, None), (101, "", "de", "s", 1, "x"), (102, "12 34 !!", None, "s", 1, "x"), (103, "der Fuchs", None, "s", 1, "x")]
    rows += [(None, "the fox", None, "s", 1, "x"), (104, "the fox jumps " * 100_000, None, "s", 1, "x"), (105, "the fox", None, "s", 1, "x"), (105, "the fox", None, "s", 1, "x")]
    frame = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.lang_pred) for r in language.identify(frame).collect() if r.doc_id is None or r.doc_id >= 100), key=str)
    assert got == sorted([(100, "und"), (101, "und"), (102, "und"), (103, "de"), (None, "en"), (104, "en"), (105, "en"), (105, "en")], key=str)
    kept = language.accepted(frame)
    assert kept.columns == frame.columns and kept.count() == len(rows) - 3
    assert language.identify(frame.limit(0)).collect() == []
    unlabelled = frame.withColumn("lang", frame["lang"].substr(9, 1)).filter("lang IS NULL OR lang = 'none'")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} <= {"und"}
