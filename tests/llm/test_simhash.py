"""SimHash against plain loops over all pairs."""

import random

import pytest
import xxhash

from cardloom.llm import simhash
from cardloom.llm.components import _starred, components

DOCS = "doc_id bigint, text string, fp string, component_id int"


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute(rows):
    prints = [(d, brute_print(t)) for d, t, *_ in rows]
    linked = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2]
    label = brute_components(range(len(prints)), linked)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    return sorted(((d, f"{p:016x}", least.get(label[i])) for i, (d, p) in enumerate(prints)), key=str)


def test_whole_query_against_all_pairs(spark):
    from cardloom.llm.catalogue import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op3_simhash"](spark, folder).collect()), key=str)
    assert got == brute(rows)


def test_nulls_empty_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (7, "One two three FOUR", "x", 1), (3, "one\ttwo\nthree  four", "x", 1), (3, "one\ttwo\nthree  four", "x", 1),
        (9, None, None, None), (8, "", "y", 2), (5, " \x0b\x0c", "y", 2), (None, "lone text here", "z", 3),
        (None, None, "z", 3), (1, long, "l", 4), (2, long + " tail", "l", 4), (4, "Übung", "u", 5), (6, "übung", "u", 5),
        (10, "one two", "u", 5),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, simhash.near_duplicates(frame).collect()), key=str) == brute(rows)
    kept = simhash.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 3, 4, 5, 6, 10, None, None], key=str)
    assert simhash.near_duplicates(frame.limit(0)).collect() == []
    assert simhash.deduplicated(frame.limit(0)).collect() == []


@pytest.mark.parametrize("pairs_up_to", [1, 32, 10_000])
def test_large_keys_lose_no_link(spark, pairs_up_to):
    """A crowd that shares blocks, with close and distant members, through pairs and through centres."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    crowd = {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))) & (1 << 64) - 1 for _ in range(400)}
    crowd |= {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in crowd)
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = components(simhash.links(frame, pairs_up_to), "a", "b").collect()
    got = {r.node: r.component for r in found}
    linked = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    want = brute_components(signed, linked)
    assert {p: got.get(p, p) for p in signed} == want


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (900, 900), (None, 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").collect() == []


def test_rounds_of_components_bring_no_rows_to_the_driver(spark):
    """Small sides are not collected and broadcast: a round is shuffled, whatever its size."""
    links = spark.createDataFrame([(i + 1, i) for i in range(50)], "node bigint, low bigint")
    step = _starred(links, True, 50)
    assert len(step.collect()) == 50
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
