"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into five blocks.  Two fingerprints that differ in at
most two bits agree in at least three of them, so every choice of three
blocks (ten masks, 38 or 39 bits each) is a join key, and each pair within a
key is verified by its Hamming distance.

Scale: documents shrink to (doc_id, fingerprint) before any shuffle, and equal
fingerprints to one row.  Keys that one fingerprint alone has are dropped by a
pre-aggregated count.  A key shared by more than ``PAIRS_UP_TO`` fingerprints
never emits its pairs: they agree in three blocks, so they can only differ in
the other two, and each is filed under itself with every single bit of those
two blocks flipped.  Two of them within two bits meet at a common centre, at
most 27 meet at one, and the smallest stands for the others.  Rows are then 27
times the key's fingerprints instead of their square, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import by_shuffle, fewer
from cardloom.llm.components import components
from cardloom.session import checkpointed

DISTANCE = 2
SHINGLE = 3
SEED = 42
PAIRS_UP_TO = 32
_WIDTHS = (13, 13, 13, 13, 12)
_HASHES_AT_ONCE = 1 << 15


def _blocks() -> list[int]:
    masks, low = [], 0
    for width in _WIDTHS:
        masks.append(((1 << width) - 1) << low)
        low += width
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


MASKS = [_signed(a | b | c) for a, b, c in combinations(_blocks(), len(_WIDTHS) - DISTANCE)]


def shingles(text: str | None, n: int = SHINGLE) -> list[bytes]:
    """Word n-grams of the text with A-Z lower-cased; a shorter text is one shingle, none has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    join = b" ".join
    return [join(gram) for gram in zip(*(words[i:] for i in range(n)))]


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes; 0 without words."""
    grams = shingles(text, n)
    digest = xxhash.xxh64_intdigest
    parts = (grams[at : at + _HASHES_AT_ONCE] for at in range(0, len(grams), _HASHES_AT_ONCE))
    return majority(np.fromiter((digest(g, SEED) for g in part), np.uint64, len(part)) for part in parts)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes, which come in parts."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts, n = counts + bits.sum(axis=0, dtype=np.int64), n + len(hashes)
    ones = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, fp bigint"
    )


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def links(distinct: DataFrame, pairs_up_to: int = PAIRS_UP_TO, at_most: int | None = None) -> DataFrame:
    """(a, b) of different fingerprints that connect what is within ``DISTANCE`` bits; input: distinct ``fp``.

    ``at_most``: a number of fingerprints that is known not to be exceeded.
    Keys with few fingerprints give each verified pair, larger keys a star at
    each common centre; both connect exactly the same fingerprints.
    """
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS])).alias("mask", "key")
    )
    n = None if at_most is None else at_most * len(MASKS)
    shared = fewer(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), n)
    live = checkpointed(fewer(keyed.join(by_shuffle(shared), ["mask", "key"]), n))

    few = live.filter(F.col("n") <= pairs_up_to).select("mask", "key", F.col("fp").alias("a"))
    pairs = fewer(
        few.join(by_shuffle(few.withColumnRenamed("a", "b")), ["mask", "key"])
        .filter((F.col("a") < F.col("b")) & _near("a", "b"))
        .select("a", "b"),
        n,
    )

    free = F.element_at(F.array(*[F.lit(_signed(~m & (1 << 64) - 1)) for m in MASKS]), F.col("mask") + 1)
    bits = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
        lambda bit: bit.bitwiseAND(free) != 0,
    )
    flips = F.transform(bits, lambda bit: F.col("fp").bitwiseXOR(bit))
    centred = (
        live.filter(F.col("n") > pairs_up_to)
        .select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("centre"))
        .groupBy("centre")
        .agg(F.collect_set("fp").alias("near"))  # at most the centre and its 64 neighbours
        .filter(F.size("near") > 1)
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
        .filter((F.col("a") != F.col("b")) & _near("a", "b"))
    )
    return pairs.unionByName(fewer(centred, n))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest doc_id reachable over links of at most
    two differing bits, the own one included.  Texts that are null, empty or
    without words have the fingerprint zero, which links like any other.
    Rows with a null doc_id get a fingerprint and their component's smallest
    id, null if it has none.  Repeated rows come out as often as they go in.
    An empty table gives an empty table; other columns are not read.
    """
    prints = checkpointed(fingerprints(docs))
    found = components(links(prints.select("fp").distinct(), at_most=prints.count()), "a", "b")
    members = (
        prints.groupBy("fp")
        .agg(F.min("doc_id").alias("least"))
        .join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp"))
    )
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = members.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller doc_id; repeated rows stay or go together.

    Rows with a null doc_id cannot be named and stay.
    """
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
