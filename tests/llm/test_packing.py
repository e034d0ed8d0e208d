"""Packing: exact ids, exact round trip, no gaps, few sequences."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from cardloom.llm import packing

DOCS = "doc_id bigint, text string, offset string, length string, done boolean"


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


ODD = [
    None, "", " ", "a", "Hello  world\n\n\n x", "it's we'll", "äöü ñ é", "日本語 テキスト", "🙂👍🏽", "a" * 5000, "1234567890" * 30,
    "tab\t\ttab   nbsp", "<|endoftext|>", "before<|endoftext|>after", "\r\n\r\n", "...!!!???", " x\u0085y", "İSTANBUL ǅ ﬁ", "é ‍", "\x00\x01",
]


def test_ids_are_those_of_the_tokenizer_file(spark):
    path = packing.default_tokenizer()
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert packing.token_ids(text, path).tolist() == reference_ids(text)


def check(rows, sources, capacity):
    """Every piece of every document once, gapless from its start and in its sequence."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc, text in sources:
        ids = reference_ids(text)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want += [
            (str(doc), i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return len(by_sequence)


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_documents(spark, parts):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    docs += [(99, "word " * 20_000)]
    frame = spark.createDataFrame([(d, t, "x", "y", True) for d, t in docs], DOCS).repartition(parts)
    rows = packing.pack_documents(frame).collect()
    used = check(rows, docs, 2048)
    assert used <= 1.03 * -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(frame.limit(0)).collect() == []


def test_sequences_hold_the_ids(spark):
    docs = [(i, "some words here " * (i * 37 % 150)) for i in range(60)]
    frame = spark.createDataFrame([(d, t, "x", "y", True) for d, t in docs], DOCS)
    found = {}
    for r in packing.sequences(frame, capacity=128).collect():
        assert len(r.ids) <= 128
        for p in r.pieces:
            found.setdefault(p.doc_id, {})[p.piece] = r.ids[p.offset : p.offset + p.length]
    for doc, text in docs:
        assert [x for _, part in sorted(found[doc].items()) for x in part] == reference_ids(text)


def test_tree_passes_on_bounded_bins_and_loses_none(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randrange(600, 1400), 7) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(30)
    monkeypatch.setattr(packing, "LEAST_ITEMS", 10)
    out = packing.packed(frame, 2048, fan_in=4).toPandas()
    assert sorted(out["doc_id"]) == list(range(4000))
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
    # node bound, on one node
    monkeypatch.setattr(packing, "CARRY", 5)
    own = pd.DataFrame({"doc_id": range(100), "bin": range(100), "length": 1100, "offset": 0})
    placed = packing._packed(own, 0, 0, 2048, False)
    assert len(placed) == 100 and (~placed["done"]).sum() == 5


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit([60, 50, 40, 35, 10, 5], 100)
    assert bins == [0, 1, 0, 1, 1, 1] and offsets == [0, 0, 60, 50, 85, 95]
