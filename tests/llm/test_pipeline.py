"""The pipeline against per-document loops, stage by stage, as the driver runs it: each stage written and read again."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_copies import brute as brute_copies
from test_mixing import brute_whole
from test_packing import check

from cardloom.llm import language, toxicity
from cardloom.session import checkpointed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows read, rows written) of each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, done))
        docs = done
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_columns(stages):
    for _, docs, done in stages[:-1]:
        assert done.dtypes == docs.dtypes


def test_toxic_documents_go(spark, stages):
    _, docs, done = stages[0]
    machine = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = docs.collect()
    score = machine.scores(machine.text_margins([r.text for r in rows]))
    want = sorted(r.doc_id for r, s in zip(rows, score) if s < 0.5)
    assert ids(done) == want and 0 < len(want) < len(rows)


def test_unknown_languages_go(stages):
    _, docs, done = stages[1]
    model = language.train(docs)
    assert ids(done) == sorted(r.doc_id for r in docs.collect() if model.predict(r.text)[1] >= language.MIN_SCORE)


def test_one_of_each_group_stays(stages):
    _, docs, done = stages[2]
    groups = brute_copies([(r.doc_id, r.text) for r in docs.collect()])
    assert ids(done) == sorted(d for d, component in groups if d == component)
    assert len(ids(done)) < docs.count()


def test_mix(stages):
    _, docs, done = stages[3]
    rows = docs.collect()
    texts = {r.doc_id: r.text for r in rows}
    copies = Counter()
    for r in done.collect():
        copies[r.doc_id] += 1
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text)
    assert copies == brute_whole([(r.doc_id, r.text, r.source) for r in rows])


def test_packing(spark, stages):
    _, docs, done = stages[4]
    check(done.collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    digest = lambda frame: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())
    assert digest(corpus_pipeline.run(spark, FOLDER)) == digest(done)


EXTRA = ("node", "label", "key", "digest", "size", "score", "taken", "Text 2")


def odd(spark):
    """The documents with clashing extra columns, a null in every column in turn, and texts without a word."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    first = docs.first().asDict()
    rows = [{**first, name: None} for name in docs.columns] + [{**first, "doc_id": 900_000 + i, "text": t} for i, t in enumerate(("", " \n", "12 34 !"))]
    more = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    both = docs.unionByName(more)
    return both.select("*", *[F.lit(i).alias(name) for i, name in enumerate(EXTRA)])


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_tables_pass_every_stage(spark, rows):
    docs = odd(spark) if rows == "odd" else odd(spark).limit(0)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, FOLDER))
        if name != "packing":
            assert docs.columns == names
        assert (docs.count() > 0) == (rows == "odd")
    assert "sequence_id" in docs.columns
