"""Block-pruned top-k against a full scan."""

import math
import random

import numpy as np
import pytest

from cardloom.llm import topk

ROWS = "vec_id bigint, embedding array<double>, score string, rank string, v string"


def brute(rows, k=5, every=50):
    good = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, v in {i: v for i, v in good if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("super_rows, queries", [(300, 7), (8192, 1024)])
def test_against_full_scan(spark, monkeypatch, super_rows, queries):
    monkeypatch.setattr(topk, "SUPER", super_rows)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.1, 0.9]) + rng.gauss(0, 0.01) * (i % 3) for _ in range(8)]) for i in range(1500)]
    rows += [(2000 + i, rows[50][1]) for i in range(20)]  # ties
    frame = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], ROWS).repartition(5)
    assert sorted(map(tuple, topk.top_k(frame).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, -2.0]), (50, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("-inf"), 1.0]), (None, [9.0, 9.0]),
        (5, []), (6, [3.0]), (7, [1.0, 1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (-100, [0.001, -0.001]),
    ]
    frame = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], ROWS)
    assert sorted(map(tuple, topk.top_k(frame).collect())) == brute(rows)
    assert topk.top_k(frame.limit(0)).collect() == []
    assert topk.top_k(frame.filter("vec_id = 50")).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (20, 16))
    rows = np.repeat(centres, 100, axis=0) + rng.integers(-5, 6, (2000, 16))
    ranges = topk.Ranges(np.arange(2000), rows)
    queries = rows[::200]
    bounds = ranges.bounds(queries)
    for i, (a, b) in enumerate(ranges.cuts):
        assert ((queries @ rows[a:b].T).max(axis=1) <= bounds[:, i]).all()
    floor = np.full(len(queries), topk._NONE)
    *_, scored = ranges.search(np.full(len(queries), -1), queries, floor, 5)
    assert scored < 0.5 * len(queries) * len(ranges.cuts)


def test_large_numbers_stay_exact():
    a = np.array([[3_000_000_001, 1]], np.int64)
    assert topk._product(a, a).tolist() == [[9_000_000_006_000_000_002]]
