"""Weak labels, their estimate, and the scorer."""

import numpy as np

from cardloom.llm import quality

DOCS = "doc_id bigint, text string, score string, pattern int, turn string"


def test_expectation_maximisation_finds_planted_accuracies():
    """Votes drawn from known rates: the estimate comes back close to them, and its likelihood never falls."""
    rng = np.random.default_rng(0)
    k = len(quality.LABELLERS)
    truth = rng.random(200_000) < 0.7
    hit = np.linspace(0.6, 0.95, k)
    votes = np.where(rng.random((len(truth), k)) < hit, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(votes @ 3 ** np.arange(k), return_counts=True)
    post, rates, prior = quality.posteriors(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.02
    for i in range(k):
        assert abs(rates[i, 1, 1] / (rates[i, 1, 0] + rates[i, 1, 1]) - hit[i]) < 0.03
    by = dict(zip(patterns.tolist(), post.tolist()))
    sure = np.array([by[p] for p in votes @ 3 ** np.arange(k)]) > 0.5
    assert (sure == truth).mean() > 0.9


def test_reader_counts_whole_texts():
    shares = quality.Reader().read("Aa bb. bb. ## !! | x")[2]
    assert shares["words"] == 7 and shares["repeats"] == 1 / 7 and shares["bare"] == 3 / 7 and shares["top"] == 2 / 7
    assert shares["capitals"] == 1 / 7 and shares["shouts"] == 2 / 7 and shares["ends"] == 2 / 7 + 1 / 7
    assert quality.Reader().read("")[2]["words"] == 0


def test_labels_it_never_saw(spark):
    from cardloom.llm.catalogue import QUERIES

    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r.score for r in QUERIES["op9_quality"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    score = np.array([got[r.doc_id] for r in labels])
    y = np.array([r.quality for r in labels])
    rank = score.argsort().argsort()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.95
    assert (score[y == 1] >= 0.5).mean() > 0.95


def test_nulls_empty_and_clashing_columns(spark):
    good = "It was the best of times, it was the worst of times. It was the age of wisdom and of long sentences, twenty words at least. "
    bad = "buy now!! $$$ $$$ $$$ $$$ ### ### CLICK CLICK CLICK CLICK CLICK "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 4) + f" n{i}", "s", 1, "t") for i in range(150)]
    rows += [(900, None, None, None, None), (901, "", "s", 1, "t"), (None, good, "s", 1, "t"), (902, good * 3000, "s", 1, "t"), (903, good, "s", 1, "t"), (903, good, "s", 1, "t")]
    frame = spark.createDataFrame(rows, DOCS)
    got = quality.quality(frame).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 900)
    assert [r.predicted for r in got if r.doc_id is None or r.doc_id in (902, 903)] == [1] * 4
    assert quality.quality(frame.limit(0)).collect() == []
