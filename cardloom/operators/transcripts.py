"""Lecture transcripts: captions, segments, time-anchored paragraphs, source links, part choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import fixed_values as fixed
from cardloom.functions.text import clock, clock_seconds, strip
from cardloom.scale import clustered
from cardloom.schema import SUBTITLES

ANCHOR_BLOCK_SECONDS = 86_400.0

# ---- captions ---------------------------------------------------------------


def read_subtitles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Caption files ``p<N>.<lang>.json3`` as ``(part_no, name, raw)``."""
    name = F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1))
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(name, r"^p(\d+)\.", 1).try_cast("int").alias("part_no"), name.alias("name"), F.col("value").alias("raw")
    )


def choose_captions(files: DataFrame, keys: list[str]) -> DataFrame:
    """One caption file per part: human before machine captions, then by name."""
    rest = [c for c in files.columns if c not in keys]
    order = F.struct(F.contains(F.col("name"), F.lit(fixed.MACHINE_CAPTION)).alias("machine"), F.col("name"))
    return files.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(*keys, "_f.*")


def caption_segments(files: DataFrame, keys: list[str]) -> DataFrame:
    """Caption JSON to ``(seq, start, end, text, lang, source)``; events without text are skipped."""
    events = files.withColumn("_events", F.from_json("raw", SUBTITLES)["events"])
    rows = events.select(*keys, "name", F.posexplode("_events").alias("seq", "_e"))
    pieces = F.transform(F.coalesce("_e.segs", F.array()), lambda s: F.coalesce(s["utf8"], F.lit("")))
    text = strip(F.regexp_replace(F.array_join(pieces, ""), "\n", " "))
    start = F.coalesce("_e.tStartMs", F.lit(0)) / 1000
    parts = F.split(F.regexp_replace("name", r"\.[^.]*$", ""), r"\.")
    return rows.select(
        *keys,
        F.col("seq").cast("bigint").alias("seq"),
        start.alias("start"),
        (start + F.coalesce("_e.dDurationMs", F.lit(0)) / 1000).alias("end"),
        text.alias("text"),
        F.when(F.size(parts) > 1, parts[1]).otherwise("").alias("lang"),
        F.when(F.contains("name", F.lit(fixed.MACHINE_CAPTION)), F.lit("ai")).otherwise(F.lit("cc")).alias("source"),
    ).filter(F.col("text") != "")


def drop_music(segments: DataFrame) -> DataFrame:
    """Segments without the credits that speech recognition invents over music."""
    return segments.filter(~F.col("text").rlike(fixed.MUSIC_CREDIT))


# ---- time anchors -----------------------------------------------------------


def _next(starts: np.ndarray, at: float, gap: float, low: int = 0) -> int:
    """First position from ``low`` on whose start is at least ``gap`` after ``at``."""
    i = low + int(np.searchsorted(starts[low:], at + gap))
    while i > low and starts[i - 1] - at >= gap:
        i -= 1
    while i < len(starts) and starts[i] - at < gap:
        i += 1
    return i


def _whole_groups(
    batches: Iterator[pd.DataFrame], keys: list[str]
) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Complete groups of a stream sorted by ``keys``: rows with the start and stop position of every group."""
    held = None
    for pdf in batches:
        if pdf.empty:
            continue
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        for key in keys:
            values = rows[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        held = rows.iloc[starts[-1] :].reset_index(drop=True)
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], starts[:-1], starts[1:]
    if held is not None:
        yield held, np.array([0]), np.array([len(held)])


def _sum_up(starts: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Every opening a block can have first, and the last opening that follows from it."""
    possible = min(_next(starts, starts[0], gap) + 1, len(starts))
    last: dict[int, float] = {}
    for i in range(possible - 1, -1, -1):
        seen, at = [], i
        while at not in last:
            seen.append(at)
            following = _next(starts, starts[at], gap, at + 1)
            if following == len(starts):
                last[at] = starts[at]
            else:
                at = following
        for k in seen:
            last[k] = last[at]
    return starts[:possible], np.array([last[i] for i in range(possible)])


def _chain(blocks: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, gap: float) -> tuple[np.ndarray, list]:
    """Opening in force before every block of one key."""
    numbers, begin = np.unique(blocks, return_index=True)
    ends = np.r_[begin[1:], len(blocks)]
    before, at = [], None
    for b, e in zip(begin, ends):
        before.append(at)
        entry = b if at is None else b + _next(firsts[b:e], at, gap)
        if entry < e:
            at = float(lasts[entry])
    return numbers, before


def _openings(starts: np.ndarray, known: float, gap: float) -> np.ndarray:
    """Opening each segment of a block belongs to, given the one in force before it (NaN = none)."""
    opening = np.empty(len(starts))
    at, i = (starts[0], 0) if np.isnan(known) else (known, 0)
    while i < len(starts):
        following = _next(starts, at, gap, i)
        opening[i:following] = at
        if following == len(starts):
            break
        at, i = starts[following], following
    return opening


def paragraph_starts(
    segments: DataFrame,
    keys: list[str],
    gap: float = fixed.ANCHOR_SECONDS,
    block_seconds: float = ANCHOR_BLOCK_SECONDS,
) -> DataFrame:
    """Adds ``para_start``: a segment opens a paragraph when it starts ``gap`` seconds after the last opening.

    The rule is a chain, so each key is cut into time blocks.  A block is
    summed up as a small table "first opening -> last opening" for every
    opening it can have; the tables of a key are chained; then every block
    finishes alone, given the opening in force before it.  Segments are
    ordered by (start, seq).
    """
    fields = {f.name: f for f in segments.schema.fields}
    key_fields = [fields[k] for k in keys]
    blocked = segments.withColumn("_block", F.floor(F.col("start") / F.lit(float(block_seconds))))
    block = T.StructField("_block", T.LongType())
    group, columns = [*keys, "_block"], list(segments.columns)

    def tables_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins, ends in _whole_groups(batches, group):
            starts = rows["start"].to_numpy(np.float64)
            found = [_sum_up(starts[b:e], gap) for b, e in zip(begins, ends)]
            times = [len(f) for f, _ in found]
            yield rows[group].iloc[np.repeat(begins, times)].assign(
                first=np.concatenate([f for f, _ in found]), last=np.concatenate([x for _, x in found])
            )

    doubles = [T.StructField("first", T.DoubleType()), T.StructField("last", T.DoubleType())]
    tables = clustered(blocked.select(*group, "start"), group, ["start"]).mapInPandas(
        tables_of, T.StructType([*key_fields, block, *doubles])
    )

    def chains_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins, ends in _whole_groups(batches, keys):
            blocks, firsts, lasts = (rows[c].to_numpy() for c in ("_block", "first", "last"))
            found = [_chain(blocks[b:e], firsts[b:e], lasts[b:e], gap) for b, e in zip(begins, ends)]
            times = [len(n) for n, _ in found]
            yield rows[keys].iloc[np.repeat(begins, times)].assign(
                _block=np.concatenate([n for n, _ in found]),
                _before=np.array([x for _, known in found for x in known], dtype=np.float64),
            )

    carried = clustered(tables, keys, ["_block", "first"]).mapInPandas(
        chains_of, T.StructType([*key_fields, block, T.StructField("_before", T.DoubleType())])
    )

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins, ends in _whole_groups(batches, group):
            starts, known = rows["start"].to_numpy(np.float64), rows["_before"].to_numpy(np.float64)
            opening = np.concatenate([_openings(starts[b:e], known[b], gap) for b, e in zip(begins, ends)])
            yield rows[columns].assign(para_start=opening)

    out = T.StructType([*segments.schema.fields, T.StructField("para_start", T.DoubleType())])
    return clustered(blocked.join(carried, group), group, ["start", "seq"]).mapInPandas(finished, out)


def paragraphs(opened: DataFrame, keys: list[str]) -> DataFrame:
    """Anchored paragraphs ``[mm:ss] text``; a group spans little more than the anchor distance."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "seq", "text")))
    return opened.groupBy(*keys, "para_start").agg(
        F.concat(
            F.lit("["), clock(F.col("para_start")), F.lit("] "), F.array_join(F.transform(ordered, lambda s: s["text"]), "")
        ).alias("text"),
        F.count("*").alias("segments"),
    )


def transcript_text(paras: DataFrame, keys: list[str]) -> DataFrame:
    """One text per part, the unit that becomes a chapter."""
    ordered = F.array_sort(F.collect_list(F.struct("para_start", "text")))
    return paras.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def transcript_totals(segments: DataFrame, keys: list[str], duration: str | None = None) -> DataFrame:
    """Characters, last end and, given the duration, the covered share and whether to warn."""
    totals = segments.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.max_by("end", F.struct("start", "seq")).alias("last_end"),
        *([F.max(duration).alias("duration")] if duration else []),
    )
    if not duration:
        return totals
    share = F.try_divide(F.col("last_end"), F.col("duration"))
    return totals.withColumn("coverage", share).withColumn(
        "low_coverage", (F.col("duration") > fixed.COVERAGE_MIN_SECONDS) & (share < fixed.COVERAGE_WARN_RATIO)
    )


# ---- names and links --------------------------------------------------------


def video_id(url: Column) -> Column:
    found = F.regexp_extract(url, fixed.VIDEO_ID, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no video id in "), url)).cast("string"))


def part_name(title: Column) -> Column:
    """``<series> pNN <name>`` without the series."""
    tail = strip(F.regexp_extract(title, fixed.SERIES_PREFIX, 1))
    return F.when(title.rlike(fixed.SERIES_PREFIX), tail).otherwise(strip(title))


def part_chapter(part_no: Column, title: Column) -> Column:
    safe = strip(F.regexp_replace(title, fixed.TITLE_UNSAFE, " "))
    return F.substring(F.format_string("P%d %s", part_no, safe), 1, fixed.PART_TITLE_CHARS)


def attach_source(cards: DataFrame, video: Column, part_no: Column) -> DataFrame:
    """``source_page`` becomes ``P<n> <time>`` and ``source_url`` jumps to that time."""
    stamp = strip(F.regexp_replace(strip(F.coalesce("source_page", F.lit(""))), r"^[\[\]]+|[\[\]]+$", ""))
    seconds = clock_seconds(stamp)
    base = F.format_string(fixed.VIDEO_URL_FORMAT, video, part_no)
    head = F.concat(F.lit("P"), part_no.cast("string"))
    return cards.withColumns(
        {
            "source_page": F.when(stamp != "", F.concat_ws(" ", head, stamp)).otherwise(head),
            "source_url": F.when(seconds.isNotNull(), F.concat(base, F.lit("&t="), seconds.cast("string"))).otherwise(base),
        }
    )


def chosen_parts(spec: Column, total: Column) -> Column:
    """Sorted distinct part numbers within 1..total of a spec like ``1-3,5``.

    Null stands for all parts: an empty spec.  A spec wholly out of range
    selects nothing.  A malformed piece fails the job.
    """
    pieces = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")
    bad = F.filter(pieces, lambda p: ~p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    low = lambda p: F.greatest(F.regexp_extract(p, r"^(\d+)", 1).cast("bigint"), F.lit(1))
    high = lambda p: F.least(F.regexp_extract(p, r"(\d+)$", 1).cast("bigint"), total.cast("bigint"))
    numbers = F.array_sort(
        F.array_distinct(
            F.flatten(
                F.transform(
                    pieces,
                    lambda p: F.when(low(p) <= high(p), F.sequence(low(p), F.greatest(low(p), high(p)))).otherwise(
                        F.array().cast("array<bigint>")
                    ),
                )
            )
        )
    )
    return (
        F.when(strip(spec) == "", F.lit(None))
        .when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("bad part spec: "), spec)).cast("array<bigint>"))
        .otherwise(numbers)
    )


def without_cached(parts: DataFrame, transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts whose transcript is not stored yet."""
    return parts.join(transcripts.select(*keys).distinct(), keys, "left_anti")
