"""Signed hashed token vectors, as Spark expressions and as a per-batch helper for Arrow tasks."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed

# ---- Spark side -------------------------------------------------------------


def token_hash(token: Column) -> Column:
    """First eight hex digits of md5 as a number."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint")


def token_bucket(code: Column) -> Column:
    return F.pmod(code, F.lit(fixed.VECTOR_DIM))


def token_sign(code: Column) -> Column:
    return F.when(F.shiftright(code, 8).bitwiseAND(F.lit(1)) == 1, F.lit(1)).otherwise(F.lit(-1))


def sparse_vectors(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``(key, bucket, weight)`` with integer weights; each row's tokens are summed before the shuffle."""
    code = token_hash(F.col("_token"))
    return (
        df.select(key, F.explode(tokens).alias("_token"))
        .select(key, token_bucket(code).alias("bucket"), token_sign(code).alias("_sign"))
        .groupBy(key, "bucket")
        .agg(F.sum("_sign").cast("bigint").alias("weight"))
        .filter(F.col("weight") != 0)
    )


# ---- inside Arrow tasks -----------------------------------------------------

_WORD = re.compile(r"[A-Za-z0-9]+")
_CJK = re.compile(r"[一-鿿]+")


def token_list(text: str) -> list[str]:
    """Python twin of :func:`cardloom.functions.text.tokens`."""
    clean = text.lower()
    if not clean.isascii():
        clean = unicodedata.normalize("NFKC", clean)
    found = _WORD.findall(clean)
    if not clean.isascii():
        for run in _CJK.findall(clean):
            found += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
    return found


class TokenCodes(dict):
    """Bounded cache from a token to ``2 * bucket + positive``, one per task."""

    limit = 100_000

    def __missing__(self, token: str) -> int:
        value = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16)
        if len(self) >= self.limit:
            self.clear()
        code = self[token] = value % fixed.VECTOR_DIM * 2 + (value >> 8 & 1)
        return code


def count_matrix(texts, codes: TokenCodes, tokens_at_once: int = 250_000) -> np.ndarray:
    """Rows of signed token counts, one row per text; exact integers held in float64."""
    out = np.zeros((len(texts), fixed.VECTOR_DIM))
    first, lists, held = 0, [], 0

    def flush(stop: int) -> None:
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        code = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=held)
        cell = np.repeat(np.arange(len(lists)), sizes) * fixed.VECTOR_DIM + (code >> 1)
        sums = np.bincount(cell, (code & 1) * 2.0 - 1.0, len(lists) * fixed.VECTOR_DIM)
        out[first:stop] = sums.reshape(len(lists), fixed.VECTOR_DIM)

    for row, text in enumerate(texts):
        found = token_list(text) if text else []
        lists.append(found)
        held += len(found)
        if held >= tokens_at_once:
            flush(row + 1)
            first, lists, held = row + 1, [], 0
    if lists:
        flush(len(texts))
    return out


def norms(matrix: np.ndarray) -> np.ndarray:
    """Euclidean norms; a zero vector counts as norm 1 so that its cosine is 0."""
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return np.where(length == 0, 1.0, length)
