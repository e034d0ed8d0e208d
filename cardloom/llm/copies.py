"""Near copies among texts: five-word shingles with a Jaccard similarity of at least 0.8.

Each document has the SimHash fingerprint of its set of hashed shingles, and
fingerprints that differ in two bits at most, found by ``simhash.links``, make
their documents candidates.  Most texts at a similarity of 0.8 differ in more
bits, so each document also has ``BANDS`` keys of ``ROWS`` minima of hashed
shingles each, and documents that share a key are candidates too: two at a
similarity of 0.8 share none of 40 keys in 5 of a million cases.  Every link is
decided by the exact Jaccard similarity of the two sets of 64-bit shingle hashes.

Scale: documents shrink to their keys and a digest of their set, and those
with equal sets to one row, whose text is the only one of them that is ever
fetched.  Texts travel only where a key is shared, and are hashed again for
the pairs that are compared, which takes less room than the sets.  Sets with
one fingerprint are compared with one of them, and linked fingerprints by one
set of each, in the first round; what that leaves over the keys find.  Pairs are
cut by size before any text is fetched: sets of less than 0.8 of the other's
size are never that similar.  What is compared with one text comes in blocks
of ``MEMBERS`` at most (on average), sorted behind it, so a task holds two
sets, and a text is copied once a block instead of once a pair.  A key that
very many share does not emit its pairs at first: in each of ``STARS``
rounds, all rows of a key are compared with one of them drawn by hash, and
what is linked becomes one component.  What still shares a key with another
component is then joined on its rarest shingles instead: of two sets that are
similar each holds one of the other's ``size - 0.8 size + 1`` rarest, whatever
the order, so no pair is lost, while a passage that very many texts share is
none of their rarest unless it is nearly all of them.  Two bounds cut those
pairs inside the join, before any text is fetched, and lose none: what two sets
share is no rarer than the rarest shingle they share, so their places of it
bound how many that are; and each set has a mark of ``BITS`` bits, where a
shingle flips one, so two sets differ in at least as many shingles as their
marks do in bits.  Each round links components of the round before, so no link
is looked at twice.  Rows are counted where they may have become few, and what
works on them has the tasks that they are worth (``fewer``): otherwise files and
log lines of rounds without work fill more disk than the work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import by_shuffle, fewer, slices
from cardloom.llm.components import components
from cardloom.llm.simhash import MASKS, SEED, links, majority
from cardloom.scale import clustered
from cardloom.session import checkpointed

SIMILARITY = 0.8
WORDS = 5
ROWS, BANDS = 6, 40
STARS = 3
MEMBERS = 1024
BITS = 1024
"""Bits of a set's mark; sets of several thousand shingles fill it, and are then compared more often, never less."""
SETS_A_TASK, TEXTS_A_TASK = 20_000, 1_000
"""Rows that are worth a task of their own, where they hold keys and marks, or texts."""
_AT_ONCE = 1 << 12
_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _DRAW.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def hashes(text: str | None) -> np.ndarray:
    """Sorted different hashes of the shingles of a text, taken in slices so that a long one is never held as shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    found = [np.zeros(0, np.uint64)]
    for at in range(0, len(words) and max(1, len(words) - WORDS + 1), _AT_ONCE):
        some = words[at : at + _AT_ONCE + WORDS - 1]
        grams = zip(*(some[i:] for i in range(WORDS))) if len(some) >= WORDS else [some]
        found.append(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64))
    return np.unique(np.concatenate(found))


def keys(found: np.ndarray) -> np.ndarray:
    """One key per band; a set without hashes has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _AT_ONCE):
        part = found[at : at + _AT_ONCE]
        least = np.minimum(least, (_FACTORS[:, None] * part + _OFFSETS[:, None]).min(axis=1))
    out = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.astype("<u8").reshape(BANDS, ROWS))]
    return np.array(out, np.uint64).view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed long; 0 for no hashes."""
    bits = majority(found[at : at + _AT_ONCE] for at in range(0, len(found), _AT_ONCE))
    return bits - (1 << 64) if bits >> 63 else bits


def mark(found: np.ndarray) -> np.ndarray:
    """``BITS`` bits as longs, each the parity of the hashes that fall on it."""
    odd = np.bincount((found % BITS).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.astype("<u8").tobytes())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    kinds = (("digest", pa.binary()), ("size", pa.int64()), ("fp", pa.int64()), ("mark", longs), ("keys", longs))
    for batch in slices(batches):
        rows = []
        for text in batch.column(1):
            found = hashes(text.as_py())
            rows.append((_digest(found), len(found), fingerprint(found), mark(found), keys(found)))
        columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *[name for name, _ in kinds]])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        digests = pa.array([_digest(hashes(t.as_py())) for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([digests, *batch.columns], ["digest", "doc_id", "text"])


def _close(n: str, m: str, least: float) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(n, m) >= least * F.greatest(n, m)


def _apart(n: str, m: str, least: float) -> Column:
    """How many shingles similar sets of these sizes can differ in."""
    return (F.col(n) + F.col(m)) * ((1 - least) / (1 + least)) + 1e-6


def _flips(a: str, b: str) -> Column:
    """Bits that two marks differ in."""
    apart = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))  # unrolled, its code is large in every executor
    return F.aggregate(apart, F.lit(0), lambda n, m: n + m)


def _linked(pairs: DataFrame, texts: DataFrame, least: float, n: int) -> DataFrame:
    """(a, b): the labels (there, label) of the ``n`` pairs (centre, node) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in slices(batches):
            alike = []
            for node, text in zip(batch.column("node"), batch.column("text")):
                found = hashes(text.as_py())
                if not node.is_valid:  # the centre comes before its block
                    own = found
                alike.append(node.is_valid and similarity(own, found) >= least)
            yield batch.select(["there", "label"]).filter(pa.array(alike, pa.bool_())).rename_columns(["a", "b"])

    sizes = fewer(pairs.groupBy("centre").agg(F.floor(F.count("*") / MEMBERS).alias("more")), n)
    dealt = fewer(pairs.join(by_shuffle(sizes), "centre"), n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("more") + 1)).drop("more")
    none = F.lit(None).cast("bigint")
    heads = fewer(dealt.select("centre", "block").distinct(), n).withColumns({"node": none, "there": none, "label": none})
    rows = dealt.unionByName(heads).withColumn("fetch", F.coalesce("node", "centre"))
    told = rows.join(texts.withColumnRenamed("node", "fetch"), "fetch").select("centre", "block", "node", "there", "label", "text")
    blocks = fewer(clustered(fewer(told, n, TEXTS_A_TASK), ["centre", "block"], ["node"]), n, TEXTS_A_TASK)  # one sorted part behind another
    return blocks.mapInArrow(run, "a bigint, b bigint")


def _near_prints(sets: DataFrame, least: float, n: int) -> DataFrame:
    """(centre, node, there, label): of at most ``n`` sets, those of one fingerprint beside one of them, and one set each of fingerprints within two bits."""
    heads = checkpointed(fewer(sets.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head")).select("fp", "head.*"), n))
    centres = heads.select("fp", F.col("node").alias("centre"), F.col("size").alias("m"))
    same = fewer(sets.select("fp", "node", "size").join(by_shuffle(centres), "fp").filter("node <> centre"), n)
    found = links(heads.select("fp"), at_most=n)
    few = n * len(MASKS)  # links come from so many keys
    near = fewer(fewer(found.distinct(), few).join(by_shuffle(centres.withColumnRenamed("fp", "a")), "a"), few)
    near = fewer(near.join(by_shuffle(heads.withColumnRenamed("fp", "b")), "b"), few)
    columns = ["centre", "node", "size", "m"]
    both = same.select(*columns).unionByName(near.select(*columns)).filter(_close("size", "m", least))
    return fewer(both.select("centre", "node", F.col("centre").alias("there"), F.col("node").alias("label")), few)


def _met(left: DataFrame, least: float, n: int) -> DataFrame:
    """(centre, node, there, label): the rows of each key that are not of its centre's component, beside the centre; ``left`` has ``n`` rows."""
    centre = left.filter("node = centre").select("key", F.col("label").alias("there"), F.col("size").alias("m"))
    met = left.join(by_shuffle(centre), "key").filter((F.col("label") != F.col("there")) & _close("size", "m", least))
    return fewer(fewer(met.select("centre", "node", "there", "label"), n).distinct(), n)


def _rarest(left: DataFrame, texts: DataFrame, marks: DataFrame, least: float, n: int) -> DataFrame:
    """(key, node, label, size, at, mark): the rarest shingles of each node, enough of them that similar sets share one; only those of several labels.

    ``at`` is the place of the shingle in its set, counted from the commonest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for node, size, text in zip(batch.column("node"), batch.column("size"), batch.column("text")):
                found = hashes(text.as_py()).view(np.int64)
                columns = [np.full(len(found), node.as_py()), np.full(len(found), size.as_py()), found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "size", "key"])

    nodes = fewer(left.select("node", "label", "size").distinct(), n)
    grams = texts.join(nodes, "node").select("node", "size", "text").mapInArrow(run, "node bigint, size bigint, key bigint")
    several = grams.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    commonest = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("key"))  # shingles of one node only would come last
    rare = grams.join(several, "key").withColumn("at", F.row_number().over(commonest)).filter(
        F.col("at") >= F.ceil(F.col("size") * least - 1e-9)
    )
    told = fewer(nodes.select("node", "label").join(by_shuffle(marks), "node"), n, SETS_A_TASK)
    kept = checkpointed(rare.join(told, "node").select("key", "node", "label", "size", "at", "mark"))
    mixed = kept.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return kept.join(by_shuffle(mixed.select("key")), "key")


def _all_met(left: DataFrame, least: float) -> DataFrame:
    """(centre, node, there, label): the pairs of a key of different components that can be similar, the smaller set as centre.

    Sizes fall into bands as wide as similar sets can differ, so partners lie in the same or the next band.
    At the rarest shingle of both, what they share is counted by neither place of it beyond that place,
    so a pair that is similar passes there, whatever its places of other keys say.
    """
    width = max(-math.log(least), 1e-6) * (1 + 1e-9)
    banded = left.select("key", "node", "label", "size", "at", "mark", F.floor(F.log("size") / F.lit(width)).alias("band"))
    small = banded.select(
        "key",
        F.explode(F.array("band", F.col("band") + 1)).alias("band"),
        F.col("node").alias("centre"),
        F.col("label").alias("there"),
        F.col("size").alias("m"),
        F.col("at").alias("place"),
        F.col("mark").alias("other"),
    )
    ordered = F.struct("m", "centre") < F.struct(F.col("size").alias("m"), F.col("node").alias("centre"))
    shared = 2 * F.least("at", "place") >= F.col("size") + F.col("m") - _apart("size", "m", least)
    can = shared & (_flips("mark", "other") <= _apart("size", "m", least))
    met = small.join(banded, ["key", "band"]).filter(ordered & (F.col("label") != F.col("there")) & _close("size", "m", least) & can)
    return met.select("centre", "node", "there", "label")


def near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row; ``component_id`` is the smallest doc_id reachable over links, the own one included.

    Null, empty and wordless texts are copies of each other; a text of fewer
    than five words is one shingle.  Rows with a null doc_id link like any
    other.  An empty table gives an empty table.
    """
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = checkpointed(text.mapInArrow(_signed, "doc_id bigint, digest binary, size bigint, fp bigint, mark array<bigint>, keys array<bigint>"))
    docs_n = signed.count()
    whole = signed.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("size", "fp", "mark", "keys")], F.min("doc_id").alias("pick"))
    sets = checkpointed(fewer(whole, docs_n, SETS_A_TASK).withColumn("node", F.monotonically_increasing_id()))
    sets_n = sets.count()
    keyed = sets.select("node", "size", F.explode("keys").alias("key"))
    shared = fewer(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), sets_n * BANDS)
    live = checkpointed(fewer(keyed.join(by_shuffle(shared), "key"), sets_n * BANDS))
    prints = checkpointed(_near_prints(sets, least, sets_n))
    named = fewer(signed.join(sets.select("digest", "node"), "digest").select("doc_id", "node"), docs_n)
    nodes = live.select("node").unionByName(prints.select(F.explode(F.array("node", "centre")).alias("node")))
    nodes = checkpointed(fewer(nodes.distinct(), sets_n))
    asked = fewer(sets.select(F.col("digest").alias("of"), "pick", "node").join(by_shuffle(nodes), "node"), sets_n)
    drawn = (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("pick"))
    named_so = F.col("doc_id").eqNullSafe(F.col("pick"))
    picked = fewer(text.join(fewer(asked.select("pick").distinct(), sets_n), named_so, "left_semi"), docs_n, TEXTS_A_TASK)
    again = picked.mapInArrow(_digested, "digest binary, doc_id bigint, text string")
    texts = fewer(again.join(asked, drawn), docs_n, TEXTS_A_TASK).groupBy("node").agg(
        F.min("text").alias("text")  # of rows repeated under one id; texts with equal sets are as good as each other
    )
    texts = checkpointed(fewer(texts, sets_n, TEXTS_A_TASK))

    marks = sets.select("node", "mark")
    labels = nodes.withColumn("label", F.col("node"))
    state, n = live.withColumn("label", F.col("node")), live.count()
    for turn in range(STARS + 1):
        several = state.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("centre")
        )
        several = fewer(several.filter("low < high").select("key", "centre"), n)
        left = checkpointed(fewer(state.join(by_shuffle(several), "key"), n))
        n = left.count()
        if turn and not n:
            break
        pairs = checkpointed(_met(left, least, n) if turn < STARS else _all_met(_rarest(left, texts, marks, least, n), least).distinct())
        pairs_n = pairs.count()
        found = _linked(pairs, texts, least, pairs_n)
        if not turn:
            prints_n = prints.count()
            found = found.unionByName(_linked(prints, texts, least, prints_n))
            pairs_n += prints_n
        merged = components(found, "a", "b", pairs_n).withColumnRenamed("node", "label")
        told = fewer(labels.join(by_shuffle(merged), "label", "left"), sets_n).select("node", F.coalesce("component", "label").alias("label"))
        labels = checkpointed(told)
        state = fewer(left.select("key", "node", "size").join(by_shuffle(labels), "node"), n)

    named = fewer(named.join(by_shuffle(labels), "node", "left"), docs_n).select("doc_id", F.coalesce("label", "node").alias("label"))
    smallest = fewer(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), docs_n)
    return fewer(named.join(by_shuffle(smallest), "label"), docs_n).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller doc_id; repeated rows stay or go together.

    Rows with a null doc_id cannot be named and stay.
    """
    gone = near_copies(docs, least).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
