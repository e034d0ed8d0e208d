"""Column functions for text: lines, trimming, tokens, timestamps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import fixed_values as fixed

# Characters that keep their form under NFKC; any other character sends the
# row's text through the Arrow function below, all other rows stay in the JVM.
_NFKC_STABLE = (
    "^[\\u0000-\\u009F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB"
    "\\u00BF-\\u012F\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u2010\\u2012-\\u2016\\u2018-\\u201F"
    "\\u3001-\\u3029\\u4E00-\\u9FFF]*$"
)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def folded(text: Column) -> Column:
    """Lower case, then NFKC.

    Only rows that NFKC may change are shipped to Python; the others travel
    as nulls and keep their JVM value.
    """
    changing = F.when(~text.rlike(_NFKC_STABLE), F.lower(text))
    return F.coalesce(_nfkc(changing), F.lower(text))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, also when ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def lines(text: Column) -> Column:
    """Array of lines; a final line break opens no further line and '' has none."""
    plain = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    exotic = F.regexp_replace(text, f"(?:{fixed.LINE_BREAK})\\z", "")
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.rlike(fixed.OTHER_BREAK), F.split(exotic, fixed.LINE_BREAK, -1))
        .otherwise(F.split(plain, "\n", -1))
    )


def tokens(text: Column, normalise: bool = True) -> Column:
    """Multiset of tokens: ASCII runs in order, then per CJK run its character pairs (or the lone character)."""
    clean = folded(text) if normalise else F.lower(text)
    words = F.regexp_extract_all(clean, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    runs = F.regexp_extract_all(clean, F.lit("([一-鿿]+)"), F.lit(1))
    pairs = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
            ),
        )
    )
    return F.concat(words, pairs)


def squash(text: Column, limit: int) -> Column:
    """One line, cut to ``limit`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x{1C}-\x{1F}]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def clock(seconds: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from one hour on."""
    whole = seconds.cast("bigint")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%02d:%02d", minutes, rest)
    )


def clock_seconds(text: Column) -> Column:
    """Seconds of the first clock time anywhere in the text, null without one."""
    hour, minute, second = (F.regexp_extract(text, fixed.TIMESTAMP, i) for i in (1, 2, 3))
    return F.when(
        second != "",
        F.coalesce(F.nullif(hour, F.lit("")).cast("bigint"), F.lit(0)) * 3600
        + minute.cast("bigint") * 60
        + second.cast("bigint"),
    )


def cut(text: Column, limit: int, tail: str) -> Column:
    """At most ``limit`` characters, ``tail`` appended when something was cut off."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))).otherwise(text)


def exact_round(value: Column, places: int) -> Column:
    """Round half to even on the exact binary value, so 2.675 gives 2.67 and 0.125 gives 0.12."""
    formatted = F.regexp_replace(F.format_number(value, places), ",", "").cast("double")
    if places == 0:
        return formatted
    # the number formatter misjudges halves of the last place itself, so those are compared directly
    unit = float(f"1e-{places}")
    half = float(f"5e-{places + 1}")
    up = F.abs(value) >= half if round(half, places) > 0 else F.abs(value) > half
    tiny = F.when(up, F.lit(unit)).otherwise(F.lit(0.0)) * F.signum(value)
    return F.when(F.abs(value) < unit, tiny).otherwise(formatted)
