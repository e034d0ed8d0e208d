"""Importance resampling towards a target: hashed n-gram features, gains, Gumbel top-k.

A text's A-Z are lowered and its separators collapsed to single spaces.  One
regular expression per n, run with overlapping matches and with lookarounds at
both ends, then finds every run of n words as a span, and the CRC32 of the span
is the feature's bucket.  A bucket's gain compares how often the target and the
raw documents fill it; a document's weight is the sum of its features' gains.
Weight plus Gumbel noise, drawn from a hash of the id, is the score: the
highest scores are a sample without replacement, in proportion to the weights.

Scale: texts are read once.  What stays of a text is two or four bytes a
feature, checkpointed.  Totals per bucket are added up inside the task, so at
most ``buckets`` rows of each task are shuffled and ``buckets`` numbers reach
the driver.  The draw is a range sort of rows without texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.scale import ranked
from cardloom.session import checkpointed

MAX_N = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
_PLAIN = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else (b | 0x20 if chr(b).isupper() else 0x20) for b in range(256)
)
_GAPS = regex.compile(rb" +")


def collapsed(text: bytes | None) -> bytes:
    """Lower-case words, one space between two of them.  UTF-8 bytes do: all separators are ASCII."""
    return _GAPS.sub(b" ", (text or b"").translate(_PLAIN)).strip(b" ")


def patterns(max_n: int) -> list[regex.Pattern]:
    """One per n: n words that neither side goes on; a match may start at each word."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(1, max_n + 1)]


def spans(text: bytes | None, max_n: int = MAX_N) -> list[tuple[int, int]]:
    """(start, end) in the collapsed text of every run of 1 to ``max_n`` words."""
    plain = collapsed(text)
    return [m.span() for pattern in patterns(max_n) for m in pattern.finditer(plain, overlapped=True)]


def feature_codes(docs: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, codes): ``codes`` packs the bucket of each feature, repeats included."""
    kind = _code_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = patterns(max_n)
        for batch in batches:
            n_words, n_features, codes = [], [], []
            for text in batch.column("text"):
                plain = collapsed(text.as_py())
                found = [
                    np.fromiter((zlib.crc32(m.group()) for m in pattern.finditer(plain, overlapped=True)), np.uint32)
                    for pattern in compiled
                ]
                n_words.append(len(found[0]))
                n_features.append(sum(map(len, found)))
                codes.append((np.concatenate(found) % np.uint32(buckets)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(codes, pa.binary())],
                ["doc_id", "n_words", "n_features", "codes"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, codes binary"
    )


def _code_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def bucket_totals(codes: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket; each task adds up its own, so the driver gets one number a bucket."""
    kind = _code_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            packed = b"".join(c.as_buffer() for c in batch.column("codes"))
            totals += np.bincount(np.frombuffer(packed, kind), minlength=buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["bucket", "n"])

    found = codes.select("codes").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(buckets, np.int64)
    totals[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return totals


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the two smoothed shares) per bucket."""
    buckets = len(raw)
    raw_all, target_all = float(raw.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log((float(t) + 1) * raw_all / ((float(s) + 1) * target_all))) for s, t in zip(raw, target)], np.int64
    )


def weighted(codes: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    kind = _code_type(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains[np.frombuffer(packed.as_buffer(), kind)].sum()) for packed in batch.column("codes")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n_words", "n_features")] + [pa.array(weights, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return codes.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where a row is not drawn.

    ``target`` needs a column ``text``.  Of the N rows with at least
    ``least_words`` words, the floor(percent * N / 100) highest scores are
    drawn; ties go to the smaller doc_id, a null one before all others, and
    rows equal in both are interchangeable.  Null and empty texts have no
    feature and weight 0.  A null id draws the noise of the empty id.
    Repeated rows are rows of their own.  An empty ``docs`` gives an empty
    table; an empty ``target`` leaves gains that favour rare buckets.  Other
    columns are not read.
    """
    codes = checkpointed(feature_codes(docs, max_n, buckets))
    asked = feature_codes(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), max_n, buckets)
    gains = bucket_gains(bucket_totals(codes, buckets), bucket_totals(asked, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted(codes, gains).withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= least_words
    order = F.struct((-F.col("score")).alias("score"), "doc_id")
    placed = ranked(scored.filter(able).withColumn("order", order), "order", "place")
    quota = percent * placed.count() // 100
    rank = F.when(F.col("place") < quota, F.col("place") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, rank.alias("rank")).unionByName(scored.filter(~able).select(*out, F.lit(None).cast("bigint").alias("rank")))
