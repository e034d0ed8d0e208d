"""Language-model scores from the lattice of all segmentations into subwords.

The pieces of an existing subword vocabulary are the arcs of a lattice over a
token, and the weights of its segmentations add up to the token's probability:
a forward recursion over byte positions in log space.  A piece that opens a
token begins with a space, so the pieces of a document never cross tokens, and
the probabilities of all tokens sum to one.

The vocabulary file brings pieces and scores.  Its scores are merge ranks, not
probabilities, so rank r weighs 1 / (r + 1) at first; forward-backward passes
over the different training words then turn expected counts into weights, with
the first weights as prior.  The vocabulary itself is never changed.

A token that the training texts hold has one arc more, over its whole length.
By absolute discounting its weight is (c - D) / N, and what the discounts leave
free, D * V / N, goes to the subword arcs.  The marginal probability of a
document is the product over its tokens and its end.

Scale: words are counted inside the tasks and once more by word; the lattice
is run once per different word, whatever its count.  Words with at least
1/HOT of all tokens, of which there are at most HOT, with no more than HOT
times the mean token length in bytes, are broadcast.  A document asks for its
other words by a join, in which no word is hot, so no text is moved.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import fold
from cardloom.session import checkpointed

FOLDS, HELD_OUT = 7, 2
ROUNDS = 2
"""Passes of expected counts over the training words."""
PRIOR = 10_000.0
"""Weight of the vocabulary's own scores against expected counts, in pieces."""
END_SHARE = 1 / 1024
"""Share of the end among tokens that are not known."""
HOT = 1 << 20
_HELD = 1 << 18
_SHORT = 64
_AT_ONCE = 1 << 12
_LOT = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GROWTH, _EXACT = np.uint64(257), 7
"""Keys are numbers to the base 257, exact for up to 7 bytes."""
_ONE = np.uint64(1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a leading space where they open a token, and their first weights.

    Pieces for single bytes, which have no score, and a lone space weigh as
    the last rank.  Pieces of white space or with a zero among other bytes are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights, last = {}, 1.0 / (model.get_piece_size() + 1)
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            piece, weight = bytes([int(model.id_to_piece(i)[3:-1], 16)]), last
        else:
            piece, weight = model.id_to_piece(i).replace("▁", " ").encode(), 1.0 / (1.0 - min(0.0, model.get_score(i)))
        if len(piece) > 1 and (piece.isspace() or b" " in piece[1:] or b"\0" in piece) or piece == b" ":
            continue
        weights[piece] = weights.get(piece, 0.0) + weight
    for byte in range(256):
        weights.setdefault(bytes([byte]), last)
    pieces = sorted(weights)
    return pieces, np.array([weights[p] for p in pieces])


class Lattice:
    """Weighted pieces; ``log_marginals`` and ``expected`` run over many tokens at once."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.pieces, self.log = pieces, np.log(weights / weights.sum())
        self.longest = max(map(len, pieces))
        self._ready = False

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "log": self.log, "longest": self.longest, "_ready": False}

    def _prepare(self) -> None:
        self._by_piece = dict(zip(self.pieces, range(len(self.pieces))))
        keys, begun = np.zeros(len(self.pieces), np.uint64), set()
        for i, piece in enumerate(self.pieces):
            key = 0
            for byte in piece:
                begun.add(key)
                key = (key * int(_GROWTH) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            keys[i] = key
        order = np.argsort(keys)
        self._keys, self._of = keys[order], order
        if (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two pieces with one key")
        self._sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self._bytes = np.frombuffer(b"".join(p.ljust(self.longest, b"\0") for p in self.pieces), np.uint8).reshape(-1, self.longest)
        # bit 0: perhaps a piece, bit 1: perhaps the start of a longer one
        self._state = np.zeros(1 << 20, np.uint8)
        self._state[self._slot(self._keys)] |= 1
        self._state[self._slot(np.array(sorted(begun), np.uint64))] |= 2
        self._ready = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _STEP) >> np.uint64(44)

    def _arcs(self, tokens: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) by start; no piece of several bytes holds the zero that stands behind a token."""
        found, length = [], tokens.shape[1]
        for start in range(length):
            rows = np.arange(np.searchsorted(lengths, start, "right"), len(tokens))
            key = np.zeros(len(rows), np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                key = key * _GROWTH + (tokens[rows, end - 1].astype(np.uint64) + _ONE)
                state = self._state[self._slot(key)]
                maybe = np.flatnonzero(state & 1)
                if len(maybe):
                    hit, of = self._pieces_of(key[maybe], end - start)
                    maybe = maybe[hit]
                    if end - start > _EXACT:  # longer keys are hashes, so the bytes decide
                        same = (self._bytes[of, : end - start] == tokens[rows[maybe], start:end]).all(axis=1)
                        maybe, of = maybe[same], of[same]
                    if len(maybe):
                        found.append((start, end, rows[maybe], of))
                more = np.flatnonzero(state & 2)
                if not len(more):
                    break
                rows, key = rows[more], key[more]
        return found

    def _pieces_of(self, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are those of a piece of ``size`` bytes, and the pieces."""
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        hit = np.flatnonzero((self._keys[at] == keys) & (self._sizes[self._of[at]] == size))
        return hit, self._of[at[hit]]

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, lengths, matrix of bytes) of short words with the opening space, shortest first, zeros behind each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        order = order[: np.searchsorted(lengths[order], _SHORT)]
        for at in range(0, len(order), _AT_ONCE):
            part = order[at : at + _AT_ONCE]
            width = int(lengths[part[-1]])
            flat = np.frombuffer(b"".join((b" " + words[i]).ljust(width, b"\0") for i in part), np.uint8)
            yield part, lengths[part], flat.reshape(len(part), width)

    def _forward(self, tokens: np.ndarray, arcs: list) -> np.ndarray:
        alpha = np.full((tokens.shape[1] + 1, len(tokens)), -np.inf)
        alpha[0] = 0.0
        for start, end, rows, of in arcs:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.log[of])
        return alpha

    def log_marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all segmentations, per word."""
        if not self._ready:
            self._prepare()
        out = np.zeros(len(words))
        for at, lengths, tokens in self._groups(words):
            out[at] = self._forward(tokens, self._arcs(tokens, lengths))[lengths, np.arange(len(at))]
        for i, word in enumerate(words):
            if len(word) + 1 >= _SHORT:
                out[i] = self._long_forward(b" " + word)[-1]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected number of uses of each piece over ``words``, segmentations weighted by their posterior."""
        if not self._ready:
            self._prepare()
        used = np.zeros(len(self.pieces))
        for at, lengths, tokens in self._groups(words):
            arcs, all_rows = self._arcs(tokens, lengths), np.arange(len(at))
            alpha, beta = self._forward(tokens, arcs), np.full((tokens.shape[1] + 1, len(tokens)), -np.inf)
            beta[lengths, all_rows] = 0.0
            whole, shares = alpha[lengths, all_rows], []
            for start, end, rows, of in reversed(arcs):
                behind = beta[end, rows] + self.log[of]
                beta[start, rows] = np.logaddexp(beta[start, rows], behind)
                shares.append(alpha[start, rows] + behind - whole[rows])
            used += np.bincount(np.concatenate([arc[3] for arc in reversed(arcs)]), np.exp(np.concatenate(shares)), len(used))
        for word in words:
            if len(word) + 1 >= _SHORT:
                self._long_expected(b" " + word, used)
        return used

    def _long_forward(self, token: bytes) -> np.ndarray:
        """The same recursion for one long token."""
        alpha = np.full(len(token) + 1, -np.inf)
        alpha[0] = 0.0
        for end in range(1, len(token) + 1):
            into = [alpha[start] + self.log[of] for start, of in self._into(token, end)]
            top = max(into)
            alpha[end] = top + math.log(sum(math.exp(x - top) for x in into)) if top > -math.inf else top
        return alpha

    def _into(self, token: bytes, end: int) -> list[tuple[int, int]]:
        found = ((start, self._by_piece.get(token[start:end])) for start in range(max(0, end - self.longest), end))
        return [(start, of) for start, of in found if of is not None]

    def _long_expected(self, token: bytes, used: np.ndarray) -> None:
        alpha, beta = self._long_forward(token), np.full(len(token) + 1, -np.inf)
        beta[-1] = 0.0
        for end in range(len(token), 0, -1):
            for start, of in self._into(token, end):
                beta[start] = np.logaddexp(beta[start], beta[end] + self.log[of])
                used[of] += math.exp(alpha[start] + self.log[of] + beta[end] - alpha[-1])


def _in_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, small ones joined to some ``_LOT`` rows."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _LOT:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lowered; bytes split at space and 9 to 13."""
    return (text or b"").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n) from (learns, text): tokens in the texts to learn from, and in all."""

    def rows(learned: Counter, other: Counter) -> pa.RecordBatch:
        words = list(learned.keys() | other.keys())
        c = [learned.get(w, 0) for w in words]
        n = [k + other.get(w, 0) for w, k in zip(words, c)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, other = Counter(), Counter()
        for batch in batches:
            for learns, text in zip(batch.column("learns").to_pylist(), batch.column("text")):
                (learned if learns else other).update(tokens_of(text.as_py()))
                if len(learned) + len(other) > _HELD:
                    yield rows(learned, other)
                    learned, other = Counter(), Counter()
        yield rows(learned, other)

    counted = docs.select("learns", "text").mapInArrow(run, "word binary, c bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


class Model:
    """Corpus totals and the lattice; gives each word its scores."""

    def __init__(self, lattice: Lattice, n: int, v: int, ends: int, discount: float):
        self.lattice, self.n, self.v, self.ends, self.discount = lattice, n, v, ends, discount

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + 1.0 * (self.v + 1.0)))

    def _mixed(self, c: np.ndarray, log_free: np.ndarray) -> np.ndarray:
        """log10 of the whole-token arc and the subword arcs together."""
        if not self.n:
            return log_free / math.log(10)
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - self.discount, 0.0) / self.n)
        return np.logaddexp(whole, math.log(self.discount * self.v / self.n) + log_free) / math.log(10)

    def words(self, words: list[bytes], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, score, lattice score) of each word with its training count, as log10."""
        log = self.lattice.log_marginals(words)
        return self.base(c), self._mixed(c, math.log1p(-END_SHARE) + log), log / math.log(10)

    def end(self) -> tuple[float, float, float]:
        c = np.array([float(self.ends)])
        return float(self.base(c)[0]), float(self._mixed(c, np.array([math.log(END_SHARE)]))[0]), math.log10(END_SHARE)


def train(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> Model:
    """Model from (word, c, n); the driver sees one number per piece and round, and four totals."""
    context = words.sparkSession.sparkContext
    pieces, weights = vocabulary(path)
    prior = weights / weights.sum()
    lattice = Lattice(pieces, weights)
    for _ in range(rounds):
        shared = context.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used = np.zeros(len(shared.value.pieces))
            for batch in _in_lots(batches):
                used += shared.value.expected(batch.column("word").to_pylist())
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(used[at])], ["piece", "used"])

        found = words.filter("c > 0").select("word").mapInArrow(run, "piece bigint, used double").groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
        used = np.zeros(len(pieces))
        used[found["piece"].to_numpy()] = found["used"].to_numpy()
        lattice = Lattice(pieces, used + PRIOR * prior)
    known = words.filter("c > 0").agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice")
    ).first()
    discount = min(0.9, max(0.1, known["once"] / (known["once"] + 2 * known["twice"]))) if known["once"] else 0.5
    return Model(lattice, (known["n"] or 0) + ends, known["v"] + (ends > 0), ends, discount)


def scored_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, known, base, score, lattice) of every word."""
    shared = words.sparkSession.sparkContext.broadcast(model)
    names = ["word", "n", "known", "base", "score", "lattice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_lots(batches):
            c = batch.column("c").to_numpy()
            scores = shared.value.words(batch.column("word").to_pylist(), c.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(c > 0), *map(pa.array, scores)], names)

    return words.mapInArrow(run, "word binary, n bigint, known boolean, base double, score double, lattice double")


def _asked(docs: DataFrame, hot: pa.Table, end: tuple[float, float, float], end_known: bool) -> DataFrame:
    """Rows of documents with what the broadcast words and the end give them, and rows of other words with the places that hold them."""
    columns = ["known", "base", "score", "lattice"]
    shared = docs.sparkSession.sparkContext.broadcast(
        ({w: i for i, w in enumerate(hot["word"].to_pylist())}, np.column_stack([hot[c].to_numpy().astype(np.float64) for c in columns]))
    )
    doc_types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    word_types = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["part", "row", "doc_id", "held_out", "n_tokens", *columns, "word", "rows", "times"]

    def words_out(part: int, places: dict) -> pa.RecordBatch:
        n = len(places)
        rows, times = zip(*places.values()) if places else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), *[pa.nulls(n, t) for t in doc_types[1:]]]
            + [pa.array(list(places), pa.binary()), pa.array(rows, word_types[1]), pa.array(times, word_types[2])],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_word, table = shared.value
        part, row, places = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            sums, sizes, first = [], [], row
            for text in batch.column("text"):
                tokens = tokens_of(text.as_py())
                at = np.fromiter(map(at_word.get, tokens, repeat(-1)), np.int64, len(tokens))
                sums.append(table[at[at >= 0]].sum(axis=0))
                for word, n in Counter(tokens[i] for i in np.flatnonzero(at < 0).tolist()).items():
                    place = places.setdefault(word, ([], []))
                    place[0].append(row)
                    place[1].append(n)
                sizes.append(len(tokens) + 1)
                row += 1
                if len(places) > _HELD:
                    yield words_out(part, places)
                    places = {}
            sums = np.array(sums) + np.array([end_known, *end])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(first, row), pa.int32()), batch.column("doc_id"), batch.column("held_out")]
                + [pa.array(sizes, pa.int64()), pa.array(np.rint(sums[:, 0]).astype(np.int64)), *[pa.array(sums[:, i]) for i in (1, 2, 3)]]
                + [pa.nulls(n, t) for t in word_types],
                names,
            )
        yield words_out(part, places)

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run,
        "part int, row int, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, lattice double, "
        "word binary, rows array<int>, times array<int>",
    )


def score(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) of every row.

    ``score`` is the log10 probability of the text under the model,
    ``lattice_score`` the same from subword arcs alone, ``base_score`` that
    of a smoothed count of words.  A null or empty text is its end alone.  A
    null id falls into the fold of the empty text.  Repeated rows are rows
    of their own, in counts and result.  Tokens of any length are scored
    whole.  Without texts to learn from all tokens are unknown and weighted
    by the vocabulary's own scores.  An empty table gives an empty table.
    Other columns are not read.
    """
    spark = docs.sparkSession
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out.alias("held_out"),
        (~held_out).alias("learns"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    words = checkpointed(word_counts(rows))
    model = train(words, rows.filter("learns").count(), path or default_vocabulary(), rounds)
    scores = checkpointed(scored_words(words, model))
    total = scores.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT >= total
    asked = checkpointed(_asked(rows, scores.filter(is_hot).toArrow(), model.end(), model.ends > 0))
    times = F.col("at.times")
    rest = (
        asked.filter("word is not null")
        .select("word", "part", F.arrays_zip("rows", "times").alias("ats"))
        .join(scores.filter(~is_hot), "word")
        .select("part", F.explode("ats").alias("at"), "known", "base", "score", "lattice")
        .select(
            "part",
            F.col("at.rows").alias("row"),
            F.when(F.col("known"), times).otherwise(0).cast("bigint").alias("known"),
            *[(F.col(c) * times).alias(c) for c in ("base", "score", "lattice")],
        )
    )
    own = asked.filter("word is null").select("part", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "lattice")
    return (
        own.unionByName(rest, allowMissingColumns=True)
        .groupBy("part", "row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.lit(model.n).cast("bigint").alias("train_tokens"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
            F.sum("lattice").alias("lattice_score"),
        )
        .drop("part", "row")
    )
