"""Text quality from weak labels.

Overlapping heuristic labellers each call a text good, bad, or abstain.
Expectation-maximisation over the counts of their vote patterns estimates how
often each labeller gives each vote for good and for bad texts, and with that
the posterior of every pattern.  The posteriors of a bounded sample train a
logistic scorer on hashed features, which scores every text.

Scale: one scan for the votes; patterns are counted map-side, and since eight
labellers have at most 3**8 patterns, all documents enter the estimate through
a table of bounded size.  The second scan scores.  Nothing is shuffled but
pattern counts and the sample of at most ``TRAIN_DOCS`` documents.
"""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cardloom.llm.common import hash_order

TRAIN_DOCS = 6000
"""Bound of the sample that the scorer is fitted on."""
WIDTH = 1 << 16
BAD, GOOD, ABSTAIN = 0, 1, 2
THRESHOLD = 0.5
ROUNDS = 200
_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))
_SYMBOL = re.compile(r"[^\w\s.,;:'\"!?()\-/]+")
_TAILS = ".,;:!?"
_CACHE = 300_000
_BITS = 16
_FIELD = 21
_MOST = (1 << _FIELD) - 1


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH


@lru_cache(maxsize=100_000)
def _shape_hash(shape: str) -> int:
    return _hash("s" + shape) << _BITS


def _shape(word: str) -> str:
    for expression, mark in _SHAPES:
        word = expression.sub(mark, word)
    return word[:12]


def _word(word: str) -> tuple[int, int]:
    """What is to know of a word, in two numbers.

    The first has its hash, the hash of its shape, whether it lacks letters
    and digits, and whether it ends a sentence; the second its symbols,
    capitals and letters, each up to ``_MOST``.
    """
    own = _hash("w" + word.lower()) | (word[-1] in ".?!") << 2 * _BITS + 1
    core = word.rstrip(_TAILS)
    if core.isalpha():  # nearly all words: letters, perhaps with a mark behind
        if core.islower():
            return own | _shape_hash("a" + word[len(core) :][:11]), min(_MOST, len(core)) << 2 * _FIELD
        if core[0].isupper() and core[1:].islower():
            return own | _shape_hash("Aa" + word[len(core) :][:10]), 1 << _FIELD | min(_MOST, len(core)) << 2 * _FIELD
    bare = not any(map(str.isalnum, word))
    symbols = sum(map(len, _SYMBOL.findall(word)))
    capitals, letters = sum(map(str.isupper, word)), sum(map(str.isalpha, word))
    return (
        own | _shape_hash(_shape(word)) | bare << 2 * _BITS,
        min(_MOST, symbols) | min(_MOST, capitals) << _FIELD | min(_MOST, letters) << 2 * _FIELD,
    )


class Reader:
    """Reads whole texts; remembers the codes of words."""

    def __init__(self):
        self.cache: dict[str, int] = {}
        self.sizes: dict[str, int] = {}

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
        """(codes of the distinct words, how often each comes, shares that the labellers and the scorer look at)."""
        words = text.split()
        counts = Counter(words)
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
            self.sizes.clear()
        for word in counts:
            if word not in cache:
                cache[word], self.sizes[word] = _word(word)
        codes = np.fromiter(map(cache.__getitem__, counts), np.int64, len(counts))
        sizes = np.fromiter(map(self.sizes.__getitem__, counts), np.int64, len(counts))
        times = np.fromiter(counts.values(), float, len(counts))
        n = max(1, len(words))
        length = lambda field: float((sizes >> field * _FIELD & _MOST) @ times)
        return (
            codes,
            times,
            {
                "words": len(words),
                "repeats": sum(map(str.__eq__, words, islice(words, 1, None))) / n,
                "symbols": length(0) / max(1, len(text)),
                "capitals": length(1) / max(1.0, length(2)),
                "shouts": text.count("!") / n,
                "bare": float(times[codes >> 2 * _BITS & 1 == 1].sum()) / n,
                "top": float(times.max(initial=0)) / n,
                "ends": float(times[codes >> 2 * _BITS + 1 & 1 == 1].sum()) / n,
            },
        )

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(feature numbers, values, vote pattern): words, word shapes and binned shares, each kind of length 1.

        A number may come more than once.
        """
        codes, times, shares = self.read(text)
        ids, values = [], []
        for kind, value in ((codes & WIDTH - 1, np.log1p(times)), (codes >> _BITS & WIDTH - 1, times)):
            ids.append(kind)
            values.append(value / (np.sqrt((value * value).sum()) or 1.0))
        ids.append(np.array([_bin(name, int(4 * math.log2(share + 1e-3))) for name, share in shares.items()], np.int64))
        values.append(np.full(len(shares), 1 / math.sqrt(len(shares))))
        return np.concatenate(ids), np.concatenate(values), pattern(shares)


@lru_cache(maxsize=10_000)
def _bin(name: str, level: int) -> int:
    return _hash(f"b{name}{level}")


LABELLERS = (
    lambda s: _vote(s["repeats"] > 0.1, s["repeats"] < 0.02 and s["words"] >= 20),
    lambda s: _vote(s["symbols"] > 0.03, s["symbols"] < 0.005),
    lambda s: _vote(s["capitals"] > 0.3 and s["words"] >= 5, s["capitals"] < 0.1),
    lambda s: _vote(s["shouts"] > 0.1, s["shouts"] < 0.02),
    lambda s: _vote(s["bare"] > 0.1, s["bare"] < 0.02),
    lambda s: _vote(s["top"] > 0.3 and s["words"] >= 20, s["top"] < 0.12),
    lambda s: _vote(s["ends"] < 0.005 and s["words"] >= 50, 0.01 <= s["ends"] <= 0.5),
    lambda s: _vote(s["words"] < 2, s["words"] >= 20),
)


def pattern(stats: dict[str, float]) -> int:
    """All votes as one number in base 3, the first labeller lowest."""
    return sum(label(stats) * 3**i for i, label in enumerate(LABELLERS))


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, vote rates [labeller, class, vote], prior of good) by expectation-maximisation."""
    k = len(LABELLERS)
    votes = np.stack([patterns // 3**i % 3 for i in range(k)], axis=1)
    good = (votes == GOOD).sum(axis=1)
    bad = (votes == BAD).sum(axis=1)
    # one bad call outweighs several good ones at the start: each labeller knows one fault only
    post = (good + 1.0) / (good + 1.0 + 4.0 * bad + 1.0)
    rates, prior = np.zeros((k, 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = float((weight[1].sum() + 1) / (weight.sum() + 2))
        for i in range(k):
            for vote in range(3):
                rates[i, :, vote] = weight[:, votes[:, i] == vote].sum(axis=1) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.log(np.array([1 - prior, prior]))[None, :] + np.zeros((len(patterns), 2))
        for i in range(k):
            log += np.log(rates[i][:, votes[:, i]]).T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            post = new
            break
        post = new
    return post, rates, prior


@pandas_udf(T.IntegerType())
def _votes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    reader = Reader()
    for texts in parts:
        yield pd.Series([pattern(reader.read(t or "")[2]) for t in texts], dtype="int32")


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, of a logistic scorer by adaptive gradient steps over the rows in order."""
    weights, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-6)
    for _ in range(rounds):
        for (ids, values), goal in zip(rows, target):
            z = float(weights[ids] @ values) + weights[-1]
            off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal
            if abs(off) < 1e-3:
                continue
            step = np.r_[off * values, off]
            at = np.r_[ids, WIDTH]
            np.add.at(seen, at, step * step)
            np.subtract.at(weights, at, 0.1 * step / np.sqrt(seen[at]))
    return weights


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Scorer weights: vote patterns of all documents, posteriors, and a fit on a sample by a hash of the id."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.select(_votes("text").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    if not len(counted):
        return np.zeros(WIDTH + 1)
    post, _, _ = posteriors(counted["pattern"].to_numpy(), counted["n"].to_numpy(float))
    known = dict(zip(counted["pattern"].tolist(), post.tolist()))
    drawn = texts.select("doc_id", hash_order(F.col("doc_id")).alias("turn")).orderBy("turn", "doc_id").limit(train_docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            made = [reader.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("turn"),
                    pa.array([m[2] for m in made], pa.int32()),
                    pa.array([m[0].tolist() for m in made], pa.list_(pa.int32())),
                    pa.array([m[1].tolist() for m in made], pa.list_(pa.float32())),
                ],
                ["turn", "pattern", "ids", "vals"],
            )

    sample = texts.join(F.broadcast(drawn.dropDuplicates(["doc_id"])), "doc_id").select("turn", "text")
    schema = "turn string, pattern int, ids array<int>, vals array<float>"
    made = sample.mapInArrow(features, schema).toArrow().sort_by("turn").combine_chunks()
    # views into the columns, no second copy of the sample
    columns = [made.column(name).combine_chunks() if made.num_rows else pa.array([], pa.list_(pa.int32())) for name in ("ids", "vals")]
    flat = [c.values.to_numpy(zero_copy_only=False) for c in columns]
    ends = columns[0].offsets.to_numpy()
    rows = [(flat[0][a:b], flat[1][a:b]) for a, b in zip(ends, ends[1:])]
    return fit(rows, np.array([known.get(p, 0.5) for p in made.column("pattern").to_pylist()]))


def quality(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, score, predicted) of every row; score is 0 to 1, higher for better texts, predicted is 1 from 0.5 on.

    Null texts count as empty, and empty texts are scored by their bins alone.
    Rows with a null id are scored but not trained on.  Repeated rows count
    and come out as often as they go in; an empty table gives an empty table;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if weights is None else weights)

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, reader = shared.value, Reader()
        for texts in parts:
            z = []
            for text in texts:
                ids, values, _ = reader.features(text or "")
                z.append(float(own[ids] @ values) + own[-1])
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50))), dtype=float)

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), score(F.col("text").cast("string")).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
