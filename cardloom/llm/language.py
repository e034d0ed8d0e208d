"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes.  A byte is
coded in the longest context that has been seen; a context with ``n``
occurrences and ``q`` different successors gives a successor seen ``c`` times
the probability ``c / (n + q)`` and keeps ``q / (n + q)`` for the escape to the
next shorter context; below the empty context all 256 bytes are equally
likely.  Statistics are frozen after training, so the code length of a byte
depends on nothing but itself and the ``ORDER`` bytes before it, and the exact
code length of a text is the sum of a table lookup per byte.

Training takes at most ``TRAIN_DOCS`` documents per language, chosen by a hash
of the id, whole; Spark counts their byte (ORDER + 1)-grams.  Shorter contexts
are marginals of those counts.  The model is bounded by the sample, and
broadcast.

Scoring is one scan without a shuffle.  Code lengths of a gram are computed
once per Python worker and kept in a direct-mapped table of fixed size.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cardloom.llm.common import fold, hash_order, release
from cardloom.scale import top_per_key

ORDER = 4
TRAIN_DOCS = 400
"""Bound of the training sample: documents per language."""
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
MIN_SCORE = 0.5
_PAD = b"\n" * ORDER
_SLOTS = 1 << 20
_AT_ONCE = 1 << 20


def _grams(data: bytes) -> np.ndarray:
    """Key of each byte with the ORDER bytes before it; A-Z count as a-z."""
    raw = np.frombuffer(_PAD + data.lower(), np.uint8).astype(np.int64)
    n = len(data)
    keys = np.zeros(n, np.int64)
    for at in range(ORDER + 1):
        keys <<= 8
        keys |= raw[at : at + n]
    return keys


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                grams, n = np.unique(_grams(text.as_py().encode("utf-8", "surrogatepass")), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"]
                )

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """Frozen context tree of one language: for each order, sorted contexts and successors with their code lengths."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.levels = []
        for order in range(ORDER, -1, -1):
            gram = grams & ((1 << 8 * (order + 1)) - 1)
            symbols, at = np.unique(gram, return_inverse=True)
            count = np.bincount(at, weights=n, minlength=len(symbols))
            contexts, of = np.unique(symbols >> 8, return_inverse=True)
            total = np.bincount(of, weights=count, minlength=len(contexts))
            different = np.bincount(of, minlength=len(contexts))
            room = np.log2(total + different)
            self.levels.append((order, symbols, room[of] - np.log2(count), contexts, room - np.log2(different)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Exact code length of each gram's last byte after the bytes before it."""
        cost, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for order, symbols, hit, contexts, escape in self.levels:
            if not len(open_):
                break
            if not len(contexts):
                continue
            gram = grams[open_] & ((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, gram >> 8), len(contexts) - 1)
            seen = contexts[at] == gram >> 8
            to = np.minimum(np.searchsorted(symbols, gram), len(symbols) - 1)
            coded = seen & (symbols[to] == gram)
            cost[open_] += np.where(coded, hit[to], np.where(seen, escape[at], 0.0))
            open_ = open_[~coded]
        cost[open_] += 8.0
        return cost


class Model:
    """Trees of all languages; ``code_lengths`` gives the bits of a text under each."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[lang] for lang in self.langs]
        self._keys = None

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "trees": self.trees, "_keys": None}

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        if self._keys is None:
            self._keys = np.full(_SLOTS, -1, np.int64)
            self._bits = np.zeros((_SLOTS, len(self.langs)), np.float32)
        slot = (grams * np.int64(-7046029254386353131) >> 40) & (_SLOTS - 1)
        miss = self._keys[slot] != grams
        if not miss.any():
            return self._bits[slot]
        new, first = np.unique(grams[miss], return_index=True)
        rows = np.column_stack([tree.bits(new) for tree in self.trees]).astype(np.float32)
        out = self._bits[slot]
        out[miss] = rows[np.searchsorted(new, grams[miss])]
        at = slot[miss][first]
        at, keep = np.unique(at, return_index=True)  # one gram per slot
        self._keys[at], self._bits[at] = new[keep], rows[keep]
        return out

    def code_lengths(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        bits = np.zeros(len(self.langs))
        grams = _grams(data)
        for at in range(0, len(grams), _AT_ONCE):
            bits += self._rows(grams[at : at + _AT_ONCE]).sum(axis=0, dtype=np.float64)
        return bits

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior under equal priors); ``und`` with 0 for a text without a letter or without languages."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        return self.langs[best], float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Model from documents outside the held-out fold with a language and a text."""
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    # ids are drawn first, so that no unchosen text is sorted or shuffled
    drawn = top_per_key(
        usable.select("lang", "doc_id", hash_order(F.col("doc_id")).alias("turn")),
        ["lang"],
        [F.col("turn"), F.col("doc_id")],
        train_docs,
        salt=F.col("doc_id"),
    )
    sample = usable.join(F.broadcast(drawn.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    counts = gram_counts(sample).toArrow().combine_chunks()
    langs = counts.column("lang").to_pylist() if counts.num_rows else []
    grams, n = (counts.column(c).to_numpy() for c in ("gram", "n")) if langs else (np.array([]), np.array([]))
    names, of = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else ([], None)
    model = Model({str(lang): Tree(grams[of == i], n[of == i]) for i, lang in enumerate(names)})
    del counts, langs, grams, n, of
    release()
    return model


def predictor(docs: DataFrame, model: Model):
    """Function from a text column to a struct (lang, score), with the model broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("lang string, score double")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in parts:  # never a batch as Python strings
            found = [own.predict(t.as_py()) for t in texts]
            langs, scores = (pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64())))
            yield pa.StructArray.from_arrays([langs, scores], ["lang", "score"])
        release()

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the whole text alone.

    ``score`` is the posterior of the predicted language under equal priors.
    Texts that are null, empty or hold no letter are ``und`` with score 0; so
    is every text when there is nothing to learn from.  Ties go to the
    language first in code point order.  Rows with a null id count as held
    out by the crc32 of the empty text.  Repeated rows come out as often as
    they go in; an empty table gives an empty table.
    """
    predict = predictor(docs, model or train(docs))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        predict(F.col("text").cast("string")).alias("p"),
    ).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def accepted(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least ``min_score``; nothing is added or renamed."""
    predict: Column = predictor(docs, model or train(docs))(F.col("text").cast("string"))
    return docs.filter(predict["score"] >= min_score)
