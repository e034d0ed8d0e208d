"""The string kernel against plain enumeration, the collapsed machine, and held-out accuracy."""

import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cardloom.llm import toxicity as tox

DOCS = "doc_id bigint, text string, score string, predicted int, toxic string"


def brute_map(unit):
    framed, out = "^" + unit + "$", {}
    for at in combinations(range(len(framed)), tox.LENGTH):
        if at[-1] - at[0] < tox.SPAN:
            key = "".join(framed[i] for i in at)
            out[key] = out.get(key, 0.0) + tox.DECAY ** (at[-1] - at[0] + 1 - tox.LENGTH)
    return out, tox._SCALE[len(framed)]


def brute_kernel(a, b):
    (x, s), (y, t) = brute_map(a), brute_map(b)
    return s * t * sum(v * y.get(k, 0.0) for k, v in x.items())


def test_kernel_is_the_sum_over_common_subsequences():
    names = ["idiot", "idxiot", "stupid", "stuupid", "ab", "a", "trash", "ungeheuerlich"]
    got = tox.Kernel(names)(names)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert got[i, j] == pytest.approx(brute_kernel(a, b), rel=1e-5, abs=1e-7)


def test_units():
    assert tox.units("Hello, w-orld! i d i o t 42 and x") == ["hello", "world", "idiot", "and", "x"]
    assert tox.units(None) == tox.units("") == tox.units("12 ?!") == []
    cut = tox.units("x" * 50 + "idiot" + "y" * 50)
    assert all(len(u) <= 32 for u in cut) and any("idiot" in u for u in cut)


def trained():
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"], 4)) for _ in range(400)]
    found = [*dict.fromkeys(["idiot", "moron", "stupid", *clean])]
    toxic = np.array([30, 30, 30, *[1] * (len(found) - 3)], float)
    return tox.fit(found, toxic, np.array([0, 0, 0, *[9] * (len(found) - 3)], float), 40, 400), found


def test_gaps_and_inserted_characters_are_tolerated():
    machine, found = trained()
    clean = machine.margins(found[3:]).max()
    for insult in ["idiot", "moron", "stupid", "idiiot", "stu-pid", "i d i o t", "morron", "stuxpid", "m.o.r.o.n"]:
        assert machine.margins(tox.units(insult))[0] > clean, insult


def test_collapsed_weights_equal_the_landmark_form():
    """A margin is linear in kernel values against the landmarks: checked through sums of units' own maps."""
    machine, found = trained()
    of, key, weight = tox.occurrences(["idiiot"])
    by_key = dict(zip(machine.lookup.keys.tolist(), machine.weights.tolist()))
    want = machine.bias + sum(by_key.get(k, 0.0) * w for k, w in zip(key.tolist(), weight.tolist()))
    assert machine.margins(["idiiot"])[0] == pytest.approx(want)


def test_held_out_accuracy(spark):
    from cardloom.llm.catalogue import QUERIES

    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    score = np.array([got[r.doc_id].score for r in labels])
    y = np.array([r.toxic for r in labels])
    rank = score.argsort().argsort()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9
    assert ((score >= 0.5) == y).mean() > 0.93
    assert ((score < 0) | (score > 1)).sum() == 0


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(i, "the other one " + ("idiot moron" if i % 4 == 0 else "and then") + f" no{i}", "s", i, "t") for i in range(200)]
    rows += [(900, None, "s", 1, "t"), (901, "", "s", 1, "t"), (902, "12 !!", "s", 1, "t"), (None, "you idiot", "s", 1, "t")]
    rows += [(903, "and then " * 100_000 + "i.d.i.o.t", "s", 1, "t"), (904, "and then", "s", 1, "t"), (904, "and then", "s", 1, "t")]
    docs = spark.createDataFrame(rows, DOCS)
    marks = [(i, int(i % 4 == 0), None) for i in range(200)] + [(None, 1, None), (5, None, 1), (7, 9, 1), (8, 1, 1), (12345, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int, text string")
    got = [(r.doc_id, r.predicted) for r in tox.toxicity(docs, labels).collect()]
    assert sorted((g for g in got if g[0] is None or g[0] >= 900), key=str) == sorted(
        [(900, 0), (901, 0), (902, 0), (None, 1), (903, 1), (904, 0), (904, 0)], key=str
    )
    assert all(p == int(i % 4 == 0) for i, p in got if i is not None and i < 200)
    kept = tox.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 52
    assert tox.toxicity(docs.limit(0), labels).collect() == []
    blind = tox.toxicity(docs, labels.limit(0)).collect()
    assert len(blind) == len(rows) and {r.predicted for r in blind} == {0} and len({r.score for r in blind}) == 1


def test_scoring_holds_no_batch_of_strings(spark):
    """A batch of texts stays in Arrow, of which few rows at once become Python strings."""
    texts = pa.array([f"some words {i} " + "and more of them " * 400 for i in range(4000)])
    machine = tox.Machine(np.zeros(0, np.uint64), np.zeros(0), 0.5)
    run = tox.margin(spark.createDataFrame([], "text string"), machine).func
    tracemalloc.start()
    got = [m for part in run(iter([texts])) for m in part.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [0.5] * 4000
    assert peak < texts.nbytes / 2


def test_training_holds_few_rows_of_doubles():
    """Subsequences and units have a row of one double a landmark; only some of the rows exist at once."""
    rng = np.random.default_rng(2)
    clean = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"], 6)) for _ in range(16_000)]
    found = [*dict.fromkeys(["idiot", "moron", "stupid", *clean])]
    toxic = np.array([30.0] * 3 + [1.0] * (len(found) - 3))
    tracemalloc.start()
    machine = tox.fit(found, toxic, np.array([0.0] * 3 + [9.0] * (len(found) - 3)), 40, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert machine.margins(["idiot"])[0] > machine.margins(found[3:]).max()
    assert peak < 8 * len(found) * tox.LANDMARKS * 2


def test_kernel_of_many_subsequences_is_taken_in_whole_units(monkeypatch):
    names = ["idiot", "x", "ungeheuerlich", "stupid", "", "ab", "trash" * 6]
    kernel = tox.Kernel(names)
    whole = kernel(names)
    for rows in (1, 7, 30):
        monkeypatch.setattr(tox, "_ROWS_AT_ONCE", rows)
        assert kernel(names) == pytest.approx(whole, rel=1e-6)
