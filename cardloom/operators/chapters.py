"""Pages to chapters: page markers, headings, page lists, oversize split, chunks.

Pages are cut into heading-led segments inside their rows.  Chapter numbers
and character offsets are blocked running sums over the segments, and text is
assembled only per final part of bounded length, so a source holding a third
of all pages, or one chapter without any heading, never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions.text import lines, strip
from cardloom.scale import ordinal_block, running
from cardloom.session import checkpointed

PAGES_PER_BLOCK = 2_000


def split_pages(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``<!-- page N -->`` markers to rows ``(page_ord, page_no, text)``.

    No marker: one page numbered 1.  Text before the first marker and blank
    pages are dropped; if all are blank the whole text is page 1.
    """
    numbers = F.regexp_extract_all(F.col(text), F.lit(fixed.PAGE_MARK), F.lit(1))
    bodies = F.split(text, fixed.PAGE_MARK, -1)
    marked = F.arrays_zip(numbers.alias("page_no"), F.slice(bodies, 2, F.greatest(F.size(numbers), F.lit(0))).alias("text"))
    pages = F.filter(
        F.transform(
            marked, lambda p: F.struct(p["page_no"].try_cast("int").alias("page_no"), strip(p["text"]).alias("text"))
        ),
        lambda p: p["text"] != "",
    )
    whole = F.array(F.struct(F.lit(1).alias("page_no"), F.col(text).alias("text")))
    return (
        df.withColumn("_pages", pages)
        .withColumn("_pages", F.when(F.size("_pages") > 0, F.col("_pages")).otherwise(whole))
        .select(*keep, F.posexplode("_pages").alias("page_ord", "_page"))
        .select(*keep, F.col("page_ord").cast("bigint").alias("page_ord"), "_page.page_no", "_page.text")
    )


def heading_name(line: Column) -> Column:
    """Chapter name when the line is a heading and no table-of-contents entry, else null ('' = unnamed)."""
    return F.when(
        line.rlike(fixed.CHAPTER_HEADING) & ~line.rlike(fixed.TOC_ENTRY_END),
        strip(F.regexp_extract(line, fixed.CHAPTER_HEADING, 1)),
    )


def segments(pages: DataFrame, source: str = "source") -> DataFrame:
    """``(source, page_ord, page_no, seg, head, name, text)``; ``text`` is null for an empty page top."""
    marked = pages.withColumn(
        "_lines",
        F.transform(lines(F.col("text")), lambda line: F.struct(line.alias("line"), heading_name(line).alias("name"))),
    )
    # positions of heading lines; segment i runs from its start to the next start
    heads = F.filter(
        F.transform("_lines", lambda x, i: F.when(x["name"].isNotNull(), i + 1)), lambda p: p.isNotNull()
    )
    begins, ends = F.concat(F.array(F.lit(0)), heads), F.concat(heads, F.array(F.size("_lines") + 1))
    bounded = marked.withColumn("_spans", F.arrays_zip(begins.alias("begin"), ends.alias("end")))
    cut = F.transform(
        "_spans",
        lambda s: F.struct(
            (s["begin"] > 0).alias("head"),
            F.when(s["begin"] > 0, F.get(F.col("_lines"), s["begin"] - 1)["name"]).alias("name"),
            F.transform(F.slice("_lines", s["begin"] + 1, s["end"] - s["begin"] - 1), lambda x: x["line"]).alias("body"),
        ),
    )
    rows = bounded.select(source, "page_ord", "page_no", F.posexplode(cut).alias("seg", "_s"))
    name = F.when(F.col("_s.name") == "", F.format_string(fixed.PAGE_CHAPTER_FORMAT, "page_no")).otherwise(
        F.col("_s.name")
    )
    first_line = F.format_string(fixed.PAGE_MARK_FORMAT, "page_no")
    body = F.when(F.col("_s.head"), F.concat(F.array(first_line), F.col("_s.body"))).otherwise(F.col("_s.body"))
    return rows.select(
        source,
        "page_ord",
        "page_no",
        "seg",
        F.col("_s.head").alias("head"),
        F.when(F.col("_s.head"), name).alias("name"),
        F.when(F.size(body) > 0, F.array_join(body, "\n")).alias("text"),
    )


def split_chapters(
    pages: DataFrame,
    source: str = "source",
    max_chars: int = fixed.MAX_CHAPTER_CHARS,
    pages_per_block: int = PAGES_PER_BLOCK,
) -> DataFrame:
    """``pages``: source, page_ord, page_no, text  ->  source, chapter_no, part, chapter, text, pages.

    A chapter longer than ``max_chars`` becomes equal parts named ``name·i``
    with an empty page list.  Chapter 0 holds what stands before the first
    heading.  Page lists are ``array<int>`` in page order.

    Numbers and offsets are worked out on text-free rows, which are written to
    the checkpoint folder once; the text itself is shuffled twice, to meet its
    offsets and to meet its part.
    """
    cut = segments(pages, source)
    size = F.when(F.col("text").isNotNull(), F.length("text") + 1).otherwise(F.lit(0)).cast("bigint")
    light = cut.select(source, "page_ord", "page_no", "seg", "head", "name", size.alias("_size"))
    placed = checkpointed(
        running(
            light,
            [source],
            ["page_ord", "seg"],
            {"chapter_no": ("sum", F.col("head").cast("bigint")), "_end": ("sum", F.col("_size"))},
            ordinal_block("page_ord", pages_per_block),
        )
    )
    written = placed.filter("_size > 0").withColumn("_start", F.col("_end") - F.col("_size"))
    chapters = (
        written.groupBy(source, "chapter_no")
        .agg(
            F.min("_start").alias("_first"),
            (F.max("_end") - F.min("_start") - 1).alias("_chars"),
            F.max("name").alias("_name"),
        )
        .withColumn("_parts", F.greatest(F.ceil(F.col("_chars") / max_chars), F.lit(1)))
        .withColumn(
            "_each",
            F.when(F.col("_parts") > 1, F.ceil(F.col("_chars") / F.col("_parts"))).otherwise(
                F.greatest(F.col("_chars"), F.lit(1))
            ),
        )
    )
    spans = written.join(chapters, [source, "chapter_no"]).select(
        source,
        "page_ord",
        "seg",
        "chapter_no",
        "_parts",
        "_each",
        "_name",
        (F.col("_start") - F.col("_first")).alias("_from"),
        # the joining line break belongs to the segment, except after the chapter's last one
        (F.col("_end") - F.col("_first") - 1 < F.col("_chars")).alias("_joined"),
    )
    texts = cut.filter(F.col("text").isNotNull()).select(source, "page_ord", "seg", "text").join(
        spans, [source, "page_ord", "seg"]
    )
    whole = texts.withColumn("_text", F.concat("text", F.when(F.col("_joined"), F.lit("\n")).otherwise(F.lit("")))).drop(
        "text"
    )
    length = F.length("_text").cast("bigint")
    first = F.least(F.floor(F.col("_from") / F.col("_each")), F.col("_parts") - 1)
    last = F.least(F.floor((F.col("_from") + F.greatest(length, F.lit(1)) - 1) / F.col("_each")), F.col("_parts") - 1)
    skip = F.greatest(F.col("part") * F.col("_each") - F.col("_from"), F.lit(0))
    stop = F.least((F.col("part") + 1) * F.col("_each") - F.col("_from"), length)
    pieces = whole.withColumn("part", F.explode(F.sequence(first, last))).withColumn(
        "_piece", F.col("_text").substr((skip + 1).cast("int"), (stop - skip).cast("int"))
    )
    # each group is one part of at most max_chars characters
    in_order = F.array_sort(F.collect_list(F.struct("_from", "page_ord", "seg", "_piece")))
    parts = pieces.groupBy(source, "chapter_no", "part").agg(
        F.first("_parts").alias("_parts"),
        F.first("_name").alias("_name"),
        F.array_join(F.transform(in_order, lambda p: p["_piece"]), "").alias("text"),
    )
    base = F.coalesce(F.col("_name"), F.lit(fixed.UNTITLED_CHAPTER))
    number = (F.col("part") + 1).cast("string")
    named = parts.select(
        source,
        "chapter_no",
        (F.col("part") + 1).alias("part"),
        F.when(F.col("_parts") > 1, F.concat(base, F.lit(fixed.PART_SEPARATOR), number)).otherwise(base).alias("chapter"),
        "text",
    )
    unsplit = chapters.filter("_parts = 1").select(source, "chapter_no")
    listed = chapter_pages(placed, unsplit, source)
    return named.join(listed, [source, "chapter_no"], "left").withColumn(
        "pages", F.coalesce("pages", F.array().cast("array<int>"))
    )


def chapter_pages(placed: DataFrame, wanted: DataFrame, source: str) -> DataFrame:
    """Pages per wanted chapter: where its heading stands, and every page that ends inside it.

    Chapters over the size limit are not asked for, so a list is short;
    repeated numbers in a row are listed once.
    """
    ends = placed.groupBy(source, "page_ord", "page_no").agg(F.max("chapter_no").alias("chapter_no"))
    heads = placed.filter("head").select(source, "page_ord", "page_no", "chapter_no")
    listed = (
        ends.select(source, "page_ord", "page_no", "chapter_no")
        .unionByName(heads)
        .join(wanted, [source, "chapter_no"], "left_semi")
        .groupBy(source, "chapter_no", "page_ord")
        .agg(F.first("page_no").alias("page_no"))
    )
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "page_no"))), lambda p: p["page_no"])
    return (
        listed.groupBy(source, "chapter_no")
        .agg(numbers.alias("_all"))
        .select(
            source,
            "chapter_no",
            F.filter(
                "_all", lambda n, i: (i == 0) | (n != F.get(F.col("_all"), F.greatest(i - 1, F.lit(0))))
            ).alias("pages"),
        )
    )


def pages_text(pages: Column) -> Column:
    return F.array_join(pages.cast("array<string>"), ",")


def filter_chapters(chapters: DataFrame, pattern: str | None) -> DataFrame:
    """Literal substring of the chapter name; nothing given keeps all."""
    return chapters.filter(F.col("chapter").contains(pattern)) if pattern else chapters


def chunks(
    df: DataFrame, text: str = "text", size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    """Overlapping chunks, numbered from 1; the last one is the first to reach the end."""
    step = size - overlap
    count = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0))
    starts = F.sequence(F.lit(0).cast("bigint"), count)
    # cut inside the row: an explode before the cut would copy the whole text to every chunk
    cut = F.transform(starts, lambda i: F.substring(F.col(text), (i * step + 1).cast("int"), F.lit(size)))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(cut).alias("_i", "chunk")).select(
        *rest, "chunk", (F.col("_i") + 1).cast("bigint").alias("chunk_no")
    )
