"""Toxicity by a subsequence string kernel and a support vector machine over Nyström landmarks.

A text is read as units: its words, lower-cased and reduced to letters, with
runs of single letters joined to one unit, framed by ``^`` and ``$``.  The
kernel of two units sums, over all subsequences of ``LENGTH`` letters within
``SPAN`` letters, the products of their weights ``DECAY ** gaps``, scaled by
the units' lengths.  Gaps and inserted characters so cost weight, not the match.

Half of the landmarks are the units that speak most for the label; the others
are the units of clean texts that resemble those most, and the commonest.  A squared-hinge SVM is fitted on the Nyström features of the
units of labelled texts.  A text is toxic if one of its units is, so the units
of clean texts are negative, and those of toxic texts are positive where the
counts, and in later rounds the machine itself, say so.  A text's score is the
logistic of its highest unit margin.

The decision function is linear in the kernel's own features: the landmarks'
coefficients collapse to one weight per subsequence.  Scoring is one scan,
without a shuffle, of a few table lookups per letter.

Training takes at most ``TRAIN_DOCS`` labelled documents per class and
``MAX_UNITS`` units; both are bounds of the sample that the model is fitted on.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from cardloom.llm.common import ROWS_AT_ONCE, fold, hash_order, release
from cardloom.scale import top_per_key

LENGTH, SPAN, DECAY = 4, 6, 0.6
TRAIN_DOCS = 3000
MAX_UNITS = 150_000
LANDMARKS = 192
NEGATIVES = 12_000
ROUNDS = 3
RIDGE = 0.2
CLEAN_WEIGHT = 6.0
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
FLOOR = -2.0
"""Margin of a text without units."""
_WINDOW = 32
_CACHE = 100_000
_AT_ONCE = 2000
_MARKED_AT_ONCE = 200
"""Units whose subsequences are looked up among the landmarks' at once."""
_ROWS_AT_ONCE = 2000
"""Rows of doubles, one a landmark, that are held at once: of subsequences, or of units in the machine's fit."""
_SLOTS = 1 << 17
_NOT_LETTERS = re.compile(r"[\W\d_]+")

# offsets of the letters after the first, and the gaps they leave
_SHAPES = [
    (a, b, c, DECAY ** (c + 1 - LENGTH)) for a in range(1, SPAN) for b in range(a + 1, SPAN) for c in range(b + 1, SPAN)
]


def units(text: str | None) -> list[str]:
    """Units of a whole text, in order; long ones are cut into overlapping windows."""
    if not text:
        return []
    out, letters = [], []
    strip = _NOT_LETTERS.sub
    for word in text.lower().split():
        if not word.isalpha():
            word = strip("", word)
            if not word:
                continue
        if len(word) == 1:
            letters.append(word)
            continue
        if letters:
            out.append("".join(letters))
            letters = []
        out.append(word)
    if letters:
        out.append("".join(letters))
    if any(len(u) > _WINDOW for u in out):
        step = _WINDOW // 2
        out = [
            u[at : at + _WINDOW]
            for u in out
            for at in (range(0, max(1, len(u) - step), step) if len(u) > _WINDOW else (0,))
        ]
    return out


def _scale_by_length() -> np.ndarray:
    """1 / norm of a framed unit of each length whose subsequences all differ."""
    norms = np.zeros(_WINDOW + 3)
    for n in range(len(norms)):
        norms[n] = sum(w * w * max(0, n - c) for _, _, c, w in _SHAPES)
    return 1.0 / np.sqrt(np.maximum(norms, 1.0))


_SCALE = _scale_by_length()


def occurrences(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit number, subsequence key, weight) of every subsequence of every unit; weights hold the unit's scale."""
    framed = ["^" + u + "$" for u in found]
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    letters = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(framed)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(of))  # letters up to the unit's end, this one included
    scale = _SCALE[np.minimum(lengths, len(_SCALE) - 1)]
    spread = [letters * np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    parts = []
    for a, b, c, weight in _SHAPES:
        at = np.flatnonzero(left > c)
        key = spread[0][at] + spread[1][at + a]
        key ^= key >> np.uint64(29)
        key += spread[2][at + b] + spread[3][at + c]
        parts.append((of[at], key, weight * scale[of[at]]))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


class _Lookup:
    """Rows of known subsequence keys: a direct-mapped table that leaves nothing but near-certain hits to the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # sorted
        self.seen = np.zeros(_SLOTS, bool)
        self.seen[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``keys``, rows) of the keys that are known."""
        maybe = np.flatnonzero(self.seen[self._slot(keys)])
        if not len(self.keys) or not len(maybe):
            return maybe[:0], maybe[:0]
        row = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        sure = self.keys[row] == keys[maybe]
        return maybe[sure], row[sure]


class Machine:
    """Collapsed decision function and its calibration."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.lookup, self.weights, self.bias = _Lookup(keys), weights, bias
        self.slope, self.shift = slope, shift
        self.cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def margins(self, found: list[str]) -> np.ndarray:
        out = np.full(len(found), self.bias)
        for at in range(0, len(found), _AT_ONCE):
            part = found[at : at + _AT_ONCE]
            of, key, weight = occurrences(part)
            hit, row = self.lookup.find(key)
            out[at : at + len(part)] += np.bincount(of[hit], weights=weight[hit] * self.weights[row], minlength=len(part))
        return out

    def text_margins(self, texts: list[str | None]) -> list[float]:
        """Highest unit margin of each text."""
        distinct = [set(units(t)) for t in texts]
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
        new = list({u for own in distinct for u in own if u not in cache})
        known = cache if len(new) <= _CACHE else dict(cache)
        known.update(zip(new, self.margins(new).tolist()))
        return [max(map(known.__getitem__, own), default=FLOOR) for own in distinct]

    def scores(self, margins) -> np.ndarray:
        z = np.clip(self.slope * np.asarray(margins, float) + self.shift, -50, 50)
        return 1.0 / (1.0 + np.exp(-z))


def _svm(kernel: np.ndarray, root: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge SVM over the features ``kernel @ root``, by Newton steps on its active set.

    Kernel values stay in single precision; the features of ``_ROWS_AT_ONCE`` units at once are made again in each step.
    """
    w = np.zeros(root.shape[1] + 1)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    active = None

    def design(rows: np.ndarray) -> np.ndarray:
        return np.column_stack([kernel[rows] @ root, np.ones(len(rows))])

    def parts(rows: np.ndarray) -> Iterator[np.ndarray]:
        return (rows[at : at + _ROWS_AT_ONCE] for at in range(0, len(rows), _ROWS_AT_ONCE))

    for _ in range(50):
        now = np.concatenate([y[rows] * (design(rows) @ w) < 1 for rows in parts(np.arange(len(y)))])
        if active is not None and (now == active).all():
            break
        active = now
        inner, right = np.diag(penalty), np.zeros(len(w))
        for rows in parts(np.flatnonzero(active)):
            own = design(rows)
            weighed = own * cost[rows, None]
            inner, right = inner + own.T @ weighed, right + weighed.T @ y[rows]
        w = np.linalg.solve(inner, right)
    return w[:-1], float(w[-1])


class Kernel:
    """Kernel values of units against given units."""

    def __init__(self, marks: list[str]):
        of, key, weight = occurrences(marks)
        self.keys, row = np.unique(key, return_inverse=True)
        self.maps = np.zeros((len(self.keys), len(marks)))
        np.add.at(self.maps, (row, of), weight)
        self.lookup = _Lookup(self.keys)

    def __call__(self, names: list[str]) -> np.ndarray:
        out = np.zeros((len(names), self.maps.shape[1]), np.float32)
        for at in range(0, len(names), _MARKED_AT_ONCE):
            of, key, weight = occurrences(names[at : at + _MARKED_AT_ONCE])
            hit, row = self.lookup.find(key)
            order = np.argsort(of[hit], kind="stable")
            own, row, weight = of[hit][order], row[order], weight[hit][order]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
            ends = np.r_[starts[1:], len(own)]
            first = 0
            while first < len(starts):  # whole units, as many as there is room for
                last = max(first + 1, int(np.searchsorted(ends, starts[first] + _ROWS_AT_ONCE, "right")))
                a, b = starts[first], ends[last - 1]
                values = self.maps[row[a:b]]
                values *= weight[a:b, None]
                out[at + own[starts[first:last]]] = np.add.reduceat(values, starts[first:last] - a)
                first = last
        return out


def fit(found: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Machine:
    """Machine from distinct units with the numbers of toxic and of clean texts that hold them."""
    none = Machine(np.array([], np.uint64), np.array([]), -1.0, 0.0, -2.0)
    if not n_toxic or not n_clean or not len(found):
        return none
    rate, other = (toxic + 0.1) / (n_toxic + 0.2), (clean + 0.1) / (n_clean + 0.2)
    evidence = toxic * np.log(rate / other)
    sure = (toxic >= 3) & (rate > 8 * other)
    if not sure.any():
        return none
    by_evidence = np.argsort(-evidence, kind="stable")
    best = by_evidence[sure[by_evidence]][: LANDMARKS // 2]
    innocent = np.flatnonzero((clean > 0) & ~sure)
    alike = Kernel([found[i] for i in best])
    near = np.zeros(len(found))
    for at in range(0, len(found), _AT_ONCE):
        near[at : at + _AT_ONCE] = alike(found[at : at + _AT_ONCE]).max(axis=1, initial=0)
    del alike
    room = LANDMARKS - len(best)
    confusing = innocent[np.argsort(-near[innocent] * np.log1p(clean[innocent]), kind="stable")][: room * 2 // 3]
    common = innocent[np.argsort(-clean[innocent], kind="stable")][: room // 3]
    marks = [found[i] for i in [*best, *dict.fromkeys([*confusing, *common])]]
    against_marks = Kernel(marks)
    keys, maps = against_marks.keys, against_marks.maps

    gram = maps.T @ maps
    value, vector = np.linalg.eigh(gram + 1e-3 * np.eye(len(marks)))
    root = vector / np.sqrt(np.maximum(value, 1e-6))

    positive = sure.copy()
    machine = none
    for round_ in range(ROUNDS):
        negative = np.flatnonzero((clean > 0) & ~positive)
        hard = negative[np.argsort(-near[negative], kind="stable")][:NEGATIVES]
        usual = negative[np.argsort(-clean[negative], kind="stable")][:NEGATIVES]
        chosen = np.unique(np.concatenate([np.flatnonzero(positive), hard, usual]))
        y = np.where(positive[chosen], 1.0, -1.0)
        seen = np.where(positive, toxic, clean)[chosen]
        cost = np.log1p(seen)
        cost[y > 0] *= max(1.0, (y < 0).sum() / max(1, (y > 0).sum()) / 4)
        w, bias = _svm(against_marks([found[i] for i in chosen]), root, y, cost)
        weights = maps @ (root @ w)
        machine = Machine(keys, weights, bias)
        if round_ + 1 < ROUNDS:
            margin = machine.margins(found)
            positive = (sure | ((toxic > 0) & (margin > 0))) & (rate > 4 * other)
            near = margin
    return machine


def _labelled(docs: DataFrame, labels: DataFrame, train_docs: int) -> DataFrame:
    """(toxic, text) of a bounded sample outside the held-out fold: ``train_docs`` of either class, by a hash of the id."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    drawn = top_per_key(
        marked.withColumn("turn", hash_order(F.col("doc_id"))),
        ["toxic"],
        [F.col("turn"), F.col("doc_id")],
        train_docs,
        salt=F.col("doc_id"),
    )
    drawn = drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """Machine from the texts of labelled documents outside the held-out fold."""
    sample = _labelled(docs, labels, train_docs)

    @pandas_udf("array<string>")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(units(t))))

    classes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counted = (
        sample.select("toxic", F.explode(distinct("text")).alias("unit"))
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
        .orderBy(F.desc("toxic"), F.desc("clean"), "unit")
        .limit(MAX_UNITS)
        .toPandas()
    )
    release()  # of what the rows came in
    machine = fit(
        counted["unit"].tolist(),
        counted["toxic"].to_numpy(float),
        counted["clean"].to_numpy(float),
        classes.get(1, 0),
        classes.get(0, 0),
    )
    del counted
    release()
    if not len(machine.lookup.keys):
        return machine
    seen = sample.select("toxic", margin(docs, machine)("text").alias("m")).toPandas()
    return calibrated(machine, seen["m"].to_numpy(float), seen["toxic"].to_numpy(float))


def calibrated(machine: Machine, margins: np.ndarray, toxic: np.ndarray) -> Machine:
    """Logistic curve through the margins of labelled texts; clean texts weigh ``CLEAN_WEIGHT`` times the toxic ones."""
    share = {1: 1 / (1 + CLEAN_WEIGHT), 0: CLEAN_WEIGHT / (1 + CLEAN_WEIGHT)}
    weight = np.where(toxic == 1, share[1] / max(1, (toxic == 1).sum()), share[0] / max(1, (toxic == 0).sum()))
    design = np.column_stack([margins, np.ones(len(margins))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (weight * (p - toxic)) + 1e-4 * at
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    machine.slope, machine.shift = float(max(at[0], 0.0)), float(at[1])
    return machine


def margin(docs: DataFrame, machine: Machine):
    """Function from a text column to its highest unit margin, with the machine broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in parts:  # never a batch as Python strings
            out = []
            for at in range(0, len(texts), ROWS_AT_ONCE):
                out += own.text_margins(texts.slice(at, ROWS_AT_ONCE).to_pylist())
            yield pa.array(out, pa.float64())
        release()

    return run


def _score(docs: DataFrame, machine: Machine):
    z = F.lit(machine.slope) * margin(docs, machine)(F.col("text").cast("string")) + F.lit(machine.shift)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def toxicity(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the whole text alone.

    Null and empty texts, and texts without letters, get the score of the
    margin ``FLOOR``.  Without labels of both classes the score is constant
    and below the threshold.  Labels that are null or neither 0 nor 1, and
    labels of unknown documents, are not learnt from; of several labels for a
    document the higher counts.  Rows with a null id are scored, never learnt
    from.  Repeated rows come out as often as they go in; an empty table gives
    an empty table.
    """
    machine = machine or train(docs, labels)
    scored = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        _score(docs, machine).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; nothing is added or renamed."""
    return docs.filter(_score(docs, machine or train(docs, labels)) < THRESHOLD)
