"""Documents to cards: clean, gate, chunk, extract, validate, number, flag, store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.operators import cards as cd
from cardloom.operators import chapters as ch
from cardloom.operators import denoise as dn
from cardloom.operators import external as ex
from cardloom.operators import transcripts as tr
from cardloom.scale import ranked
from cardloom.session import checkpointed
from cardloom.sources.cards import CardTable


def prepared(chapters: DataFrame, clean: bool = True, pattern: str | None = None) -> DataFrame:
    """Chapters worth extracting: name filter, line cleaning, size gate."""
    chosen = ch.filter_chapters(chapters, pattern)
    return dn.large_enough(dn.denoise(chosen) if clean else chosen)


def chapter_chunks(chapters: DataFrame, size: int = fixed.CHUNK_CHARS) -> DataFrame:
    """``(course, chapter, chapter_ord, chunk_no, chunk)``."""
    return ch.chunks(chapters.select("course", "chapter", "chapter_ord", "text"), size=size)


def answers(
    chunks: DataFrame, model: Callable[[dict], str] = ex.sample_cards, calls_at_once: int | None = None
) -> DataFrame:
    """Chunks with the model's ``answer``, or with ``call_error`` where every try failed."""
    return ex.call_rows(chunks, ex.with_json_repair(ex.with_retries(model)), "answer", calls_at_once, "call_error")


def failed_chunks(answered: DataFrame) -> DataFrame:
    """Chunks without an answer and why; ask again with these alone."""
    return answered.filter(F.col("call_error").isNotNull()).drop("answer")


def extract(
    chunks: DataFrame,
    model: Callable[[dict], str] = ex.sample_cards,
    calls_at_once: int | None = None,
    own_names: bool = False,
) -> DataFrame:
    """Parsed model items of the chunks; see ``parsed_items``."""
    return parsed_items(answers(chunks, model, calls_at_once), own_names)


def parsed_items(answered: DataFrame, own_names: bool = False) -> DataFrame:
    """Model items with ``card`` and ``error``; failed chunks have none.

    Course and chapter come from the chunk; ``own_names`` keeps the names the
    model put into its items instead.
    """
    found = ex.items(answered.drop("call_error"), "answer", "cards").withColumnsRenamed({"course": "_course", "chapter": "_chapter"})
    parsed = cd.parse_cards(found, course=F.col("_course"), chapter=F.col("_chapter"))
    if not own_names:
        parsed = parsed.withColumn(
            "card", F.col("card").withField("course", F.col("_course")).withField("chapter", F.col("_chapter"))
        )
    return parsed


def to_cards(parsed: DataFrame) -> DataFrame:
    """Valid items in (chapter, chunk, item) order: first of its kind wins, then numbered and flagged.

    ``parsed`` is read twice (chapter sizes, then cards), so store the model's answers first.
    """
    place = F.struct("chapter_ord", "chunk_no", "item_no")
    rows = ranked(cd.valid_cards(parsed, place.alias("_place")), "_place", "ord").drop("_place")
    return cd.flag_reference(cd.dedup_and_number(rows))


def ingest(
    chapters: DataFrame,
    store: CardTable,
    model: Callable[[dict], str] = ex.sample_cards,
    clean: bool = True,
    chunk_chars: int = fixed.CHUNK_CHARS,
    calls_at_once: int | None = None,
    failures_path: str | None = None,
) -> int:
    """``chapters``: course, chapter, chapter_ord, text.  Returns the number of new cards.

    Chunks that the model could not answer do not end the run; they are
    written as JSON to ``failures_path``.
    """
    ready = prepared(chapters, clean)
    answered = checkpointed(answers(chapter_chunks(ready, chunk_chars), model, calls_at_once))
    if failures_path:
        failed_chunks(answered).write.mode("overwrite").json(failures_path)
    return store.save(to_cards(checkpointed(parsed_items(answered))))


_PART = ["course", "video", "part_no"]


def video_chapters(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """``segments``: course, video, part_no, seq, start, end, text.  ``parts``: course, video, part_no, title.

    Gives a chapter per part of every video; ``chapter_ord`` is the part number.
    """
    opened = tr.paragraph_starts(segments, _PART)
    text = tr.transcript_text(tr.paragraphs(opened, _PART), _PART)
    return dn.large_enough(
        text.join(parts.select(*_PART, "title"), _PART).select(
            "course",
            tr.part_chapter(F.col("part_no"), F.col("title")).alias("chapter"),
            F.col("part_no").cast("bigint").alias("chapter_ord"),
            "video",
            "part_no",
            "text",
        )
    )


def video_cards(cards: DataFrame, chapters: DataFrame) -> DataFrame:
    """Cards of video chapters with page and jump link.

    ``cards`` carry the ``video`` they come from, as a course may hold several
    videos with chapters of the same name.
    """
    numbered = cards.join(chapters.select("course", "video", "chapter", "part_no"), ["course", "video", "chapter"])
    return tr.attach_source(numbered, F.col("video"), F.col("part_no")).drop("part_no", "video")
