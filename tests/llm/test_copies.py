"""Near copies by Jaccard similarity against plain loops over all pairs."""

import random
import sys

import corpus_pipeline
import numpy as np
import pyarrow as pa
from test_simhash import brute_components

from cardloom.llm import copies, simhash
from cardloom.llm.common import TASKS, fewer
from cardloom.llm.components import components

DOCS = "doc_id bigint, text string, component_id int"


def brute(rows):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [grams(t) for _, t, *_ in rows]
    alike = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    label = brute_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    return sorted(((d, least.get(label[i])) for i, (d, *_) in enumerate(rows)), key=str)


def sample():
    rng = random.Random(3)
    rows = []
    for group in range(25):  # single words replaced, at all similarities around the limit
        words = [f"g{group}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(30 if group == 0 else 5):
            new = [f"n{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in words]
            rows.append((len(rows), " ".join(new), 1))
    rows += [(900 + i, t, 1) for i, t in enumerate([None, "", " \n", "a b", "A  b", "a b c", rows[3][1], rows[3][1].upper()])]
    rows += [(None, rows[8][1], 1), (None, "alone in the world it is", 1), (5, rows[5][1], 1)]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = sample()
    frame = spark.createDataFrame(rows, DOCS)
    want = brute(rows)
    for stars in (3, 0):  # stars first, or every pair of a key at once
        monkeypatch.setattr(copies, "STARS", stars)
        assert sorted(map(tuple, copies.near_copies(frame).collect()), key=str) == want
    assert copies.near_copies(frame.limit(0)).collect() == []


def test_stage_leaves_one_of_near_copies(spark):
    rows = sample()
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, DOCS), "")
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, c in brute(rows) if d is None or d == c), key=str)


def test_sizes_and_long_texts(spark, monkeypatch):
    """Texts around the size limit, one long passage in texts that are not alike, very long texts, small blocks."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage, body, long = fresh(120), fresh(200), fresh(30_000)
    rows = [" ".join(body[:n]) for n in (200, 190, 170, 166, 165, 164, 163, 162, 150, 140, 132, 120)]
    rows += [" ".join(passage + fresh(n)) for n in (5, 10, 20, 25, 30, 40, 60, 100, 200)]
    rows += [" ".join(long), " ".join(long[:25_000]), " ".join(long[:20_000]), " ".join(long[:-3] + fresh(3))]
    rows = [(i, t, 1) for i, t in enumerate(rows)]
    want = brute(rows)
    monkeypatch.setattr(copies, "MEMBERS", 2)
    for stars in (3, 0):
        monkeypatch.setattr(copies, "STARS", stars)
        assert sorted(map(tuple, copies.near_copies(spark.createDataFrame(rows, DOCS)).collect()), key=str) == want
    assert 4 < len({c for _, c in want}) < len(rows) - 4


def test_ids_that_do_not_name_a_row(spark):
    """Rows with a null id only, and different texts under one id."""
    words = [f"w{i}" for i in range(60)]
    alike = [" ".join(words), " ".join(words).upper(), " ".join([*words, "x"]), " ".join(["y", *words])]
    rows = [(None, t, 1) for t in alike] + [(7, t, 1) for t in ("a b", *alike)] + [(9, "a b", 1), (None, alike[2], 1)]
    got = copies.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_marks_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    for size in (0, 1, 40, 150, 5000):
        base = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        for keep in (1.0, 0.9, 0.5):
            kept = base[rng.random(len(base)) < keep]
            other = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, size // 8, np.uint64)]))
            flips = np.bitwise_count(copies.mark(base) ^ copies.mark(other)).sum()
            assert flips <= len(np.setxor1d(base, other))
    assert (copies.mark(base) == copies.mark(base[::-1])).all()


def test_group_below_the_limit_meets_no_one(spark, monkeypatch):
    """Texts that all share most of one text, yet are no pair: none of their pairs reaches the texts, and real ones do."""
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(150)], []
    for _ in range(60):
        new = list(words)
        for at in rng.sample(range(4, 146), 6):
            new[at] = f"n{rng.randrange(10**7)}"
        rows.append((len(rows), " ".join(new), 1))
    rows.append((len(rows), rows[7][1] + " end", 1))
    asked = []
    linked = copies._linked
    monkeypatch.setattr(copies, "STARS", 0)
    monkeypatch.setattr(copies, "_linked", lambda pairs, *rest: asked.append(pairs.count()) or linked(pairs, *rest))
    assert sorted(map(tuple, copies.near_copies(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute(rows)
    assert 1 <= sum(asked) < 60


def test_fingerprints_alone_find_copies(spark, monkeypatch):
    """Sets whose SimHash differs in two bits at most are compared even if they share no key; the exact similarity decides."""
    rng = random.Random(5)
    rows = []
    for group in range(12):
        words = [f"g{group}w{rng.randrange(900)}" for _ in range(600)]
        for i in range(3):
            changed = list(words)
            if i:
                changed[rng.randrange(600)] = f"new{group}{i}"
            rows.append((len(rows), " ".join(changed), 1))
    prints = [copies.fingerprint(copies.hashes(t)) for _, t, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert 4 <= len(near) and any(prints[i] != prints[j] for i, j in near)
    signed = copies._signed

    def without_keys(batches):
        for batch in signed(batches):
            none = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
            yield batch.set_column(batch.schema.get_field_index("keys"), "keys", none)

    monkeypatch.setattr(copies, "_signed", without_keys)
    label = brute_components(range(len(rows)), near)
    found = {r.doc_id: r.component_id for r in copies.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {i: label[i] for i in range(len(rows))}


def test_fingerprint_of_a_set_is_simhash():
    text = "a b c d e f g h i j k l"
    assert copies.fingerprint(copies.hashes(text)) % (1 << 64) == simhash.fingerprint(text, copies.WORDS)
    assert copies.fingerprint(copies.hashes("")) == 0


def test_signatures_leave_a_batch_in_slices():
    """No more than 500 rows of an Arrow batch are signed before they are passed on; none is lost."""
    n = 1203
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"w{i} x y z" for i in range(n)])], ["doc_id", "text"])
    out = list(copies._signed(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= 500
    assert [d for b in out for d in b.column("doc_id").to_pylist()] == list(range(n))


def test_marks_are_compared_as_arrays(spark):
    frame = spark.createDataFrame([([1, 7, -1], [1, 0, 0])], "a array<bigint>, b array<bigint>")
    assert frame.select(copies._flips("a", "b").alias("n")).first().n == 0 + 3 + 64


def test_rounds_have_the_tasks_that_their_rows_are_worth(spark, monkeypatch):
    """With many shuffle partitions that Spark does not merge, small tables leave few files, and the same components."""
    rows, parts = sample(), []
    for module in (copies, simhash, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "checkpointed", lambda df, run=module.checkpointed: parts.append((out := run(df)).rdd.getNumPartitions()) or out)
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert sorted(map(tuple, copies.near_copies(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 12
    assert sum(n > TASKS for n in parts) <= 2  # rarest shingles and their pairs, whose number is not known before


def test_fewer_merges_parts_and_never_makes_more(spark):
    frame = spark.range(0, 100, 1, 40)
    assert [fewer(frame, n, 10).rdd.getNumPartitions() for n in (0, 160, 161, 10**6)] == [TASKS, TASKS, TASKS + 1, 40]
    assert fewer(frame, None) is frame
    assert sorted(r.id for r in fewer(frame, 5).collect()) == list(range(100))
