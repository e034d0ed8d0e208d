"""Study notes of many courses as ordered text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.operators import render

_PAGE_HEAD = (
    '<!DOCTYPE html>\n<html lang="{lang}"><head><meta charset="utf-8"><title>%s</title>\n'
    "<style>body {{ margin: 0 }} .{holder} svg {{ display: block; width: 100vw; height: 100vh }}</style>\n"
    '<script src="{script}"></script></head>\n<body><div class="{holder}"><script type="text/template">\n{options}'
)
_PAGE_TAIL = "</script></div></body></html>"


def _framed(rows: DataFrame, heads: DataFrame, tail: str | None) -> DataFrame:
    """Body rows between a head row and an optional tail row per course, in ``place`` order."""
    body = rows.withColumn("place", F.lit(1))
    empty = {"chapter": F.lit(""), "level": F.lit(0), "card_no": F.lit(0).cast("bigint"), "id": F.lit("")}
    framed = body.unionByName(heads.withColumns({**empty, "place": F.lit(0)}))
    if tail is None:
        return framed
    ends = heads.select("course").withColumns({**empty, "text": F.lit(tail), "place": F.lit(2)})
    return framed.unionByName(ends)


def mindmap(cards: DataFrame) -> DataFrame:
    heads = cards.select("course").distinct().withColumn("text", F.concat(F.lit("# "), "course", F.lit("\n")))
    return _framed(render.mindmap_rows(cards), heads, None)


def mindmap_page(cards: DataFrame, script: str = fixed.MINDMAP_SCRIPT) -> DataFrame:
    page = _PAGE_HEAD.format(
        lang=fixed.MINDMAP_LANG, holder=fixed.MINDMAP_CLASS, script=script, options=fixed.MINDMAP_OPTIONS
    )
    title = F.format_string(page, F.format_string(fixed.MINDMAP_TITLE, "course"))
    heads = cards.select("course").distinct().withColumn("text", F.concat(title, F.lit("\n# "), "course", F.lit("\n")))
    return _framed(render.mindmap_rows(cards), heads, _PAGE_TAIL)


def notes(cards: DataFrame) -> DataFrame:
    return _framed(render.notes_rows(cards), render.notes_head(cards), None)


def write_rows(rows: DataFrame, path: str) -> None:
    """One folder per course; its part files, read in name order, are the document.

    Range partitioning splits a large course over several files instead of
    handing it to one task.
    """
    order = ["course", "place", *render.ROW_ORDER[1:]]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("course", F.col("text").alias("value"))
        .write.mode("overwrite")
        .partitionBy("course")
        .text(path)
    )


def write_notes(cards: DataFrame, path: str, kinds: str | None = None, script: str = fixed.MINDMAP_SCRIPT) -> None:
    """Mind map (Markdown and HTML) and review notes below ``path``."""
    kept = render.of_kinds(cards, kinds)
    if kept.isEmpty():
        raise ValueError("no cards to write (check the kinds)")
    write_rows(mindmap(kept), f"{path}/mindmap_md")
    write_rows(mindmap_page(kept, script), f"{path}/mindmap_html")
    write_rows(notes(kept), f"{path}/notes_md")
