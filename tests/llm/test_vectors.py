"""Product-quantised near-duplicates against brute force."""

import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from cardloom.llm import vectors

ROWS = "vec_id bigint, embedding array<float>, label int, n_links string, cls string"


def brute(rows, cosine=0.95):
    """n_links and component of each (id, vector) row, by all pairs in double precision."""
    good = [
        (i, np.asarray(v, float)) for i, v in rows
        if i is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and any(v)
    ]
    label = list(range(len(good)))
    counts = [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and (np.array_equal(x, y) or (vectors.unit(x) * vectors.unit(y)).sum() >= cosine):
                counts[a] += 1
                counts[b] += 1
                old, new = label[a], label[b]
                label = [new if c == old else c for c in label]
    least = {}
    for (i, _), c in zip(good, label):
        least[c] = min(i, least.get(c, i))
    out = [(i, n, least[c]) for (i, _), n, c in zip(good, counts, label)]
    left = [i for i, _ in rows]
    for i, _, _ in out:
        left.remove(i)
    return sorted(out + [(i, 0, i) for i in left], key=str)


def clustered(seed=0, n=900, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, width))
    rows = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, width)) * rng.choice([0.1, 0.2, 0.3, 1.0], (n, 1))
    rows[:200] = centres[0] + rng.normal(size=(200, width)) * 0.15  # one large group
    return (rows * rng.uniform(0.1, 9, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("block", [64, 1024])
def test_recall_and_exactness(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    points = clustered()
    rows = [(i * 3, [float(x) for x in v]) for i, v in enumerate(points)]
    frame = spark.createDataFrame([(i, v, i % 2, "x", "y") for i, v in rows], ROWS)
    got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    want = {i: (n, c) for i, n, c in brute(rows)}
    assert set(got) == set(want)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [
        (5, v), (2, v), (9, [2.0, 4.0, 6.0]), (7, w), (7, w), (1, None), (3, []), (4, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]),
        (8, [float("nan"), 1.0, 1.0]), (10, [float("inf"), 1.0, 1.0]), (None, v), (11, [1.0, 2.0]), (12, [2.0, 4.0]), (13, [1.0, 2.001, 3.0]),
    ]
    frame = spark.createDataFrame([(i, x, None, "x", "y") for i, x in rows], ROWS)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()), key=str)
    assert got == brute(rows)
    assert vectors.near_duplicates(frame.limit(0)).collect() == []
    assert {r.kept for r in vectors.near_duplicates(frame.filter("vec_id IS NULL")).collect()} == {False}


def test_table_distances_bound_true_ones():
    """A member is never farther from a query than the table distance says, give or take its own coding error."""
    points = vectors.unit(clustered(3).astype(float))
    index = vectors.Index(points, 8)
    lists = vectors.nearest(points, index.centres, 1)[:, 0]
    codes, error = index.code(points, lists)
    for at in range(8):
        rows = np.flatnonzero(lists == at)
        table = np.sqrt(np.maximum(index.squared_distances(points, at, codes[rows]), 0))
        true = np.sqrt(((points[:, None] - points[None, rows]) ** 2).sum(-1))
        assert (table <= true + error[rows] + 1e-6).all()


def test_group_split_over_many_lists(spark):
    """Near copies that are not equal hold most rows, so they fill more lists than any fixed number of probes."""
    rng = np.random.default_rng(11)
    points = rng.normal(size=(3000, 64))
    points[:2400] = points[0] + 0.175 * rng.normal(size=(2400, 64))
    points = rng.permutation(points).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id bigint, embedding array<float>")
    unit = vectors.unit(points.astype(float))
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert want.max() >= 2300
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
    assert got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("same", [False, True])
def test_a_pair_of_blocks_takes_no_matrix_of_doubles(same):
    """Blocks with few links are counted without turning all their pairs into doubles; counts and edges are those of all pairs."""
    rng = np.random.default_rng(5)
    n = 1500
    points = rng.normal(size=(2 * n, 16))
    points[n : n + 5] = points[:5] + 0.01
    points[n - 3 : n] = points[n - 4] + 0.01
    unit = vectors.unit(points)
    index = vectors.Index(unit, 12)
    own = vectors.nearest(unit, index.centres, 1)[:, 0]
    codes, error = index.code(unit, own)
    frame = pd.DataFrame(
        {"cls": np.arange(2 * n), "size": 1 + np.arange(2 * n) % 3, "v": [vectors._packed(v) for v in points], "list": own}
    ).assign(codes=[c.tobytes() for c in codes], error=error)
    queries, members = frame[:n], (frame[:n] if same else frame[n:]).reset_index(drop=True)
    tracemalloc.start()
    counts, edges = vectors._compare(index, queries, members, 0.95, same)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    linked = vectors.unit(points[:n]) @ vectors.unit(points[members["cls"]]).T >= 0.95
    if same:
        np.fill_diagonal(linked, False)
    want = Counter(dict(zip(queries["cls"].tolist(), (linked @ members["size"].to_numpy()).tolist())))
    if not same:
        want.update(dict(zip(members["cls"].tolist(), (queries["size"].to_numpy() @ linked).tolist())))
    assert dict(zip(counts["cls"], counts["n"])) == +want and len(+want) >= 4
    assert {frozenset(e) for e in edges} <= {frozenset((int(queries["cls"][a]), int(members["cls"][b]))) for a, b in zip(*np.nonzero(linked))}
    assert peak < 8 * n * n
