"""Text sources: whole files, Markdown trees, slice plans and the choice of a reader."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions.text import lines, strip
from cardloom.operators import chapters as ch
from cardloom.scale import FILES_PER_BLOCK, ordinal_block, ranked, running


def _stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_texts(spark: SparkSession, path: str | list[str], course: str) -> DataFrame:
    """md/txt files: each file is one chapter, named by a heading in its first line or else by the file."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")
    )
    first = F.get(lines(F.col("text")), 0)
    heading = first.rlike(fixed.CHAPTER_HEADING)
    name = F.when(F.coalesce(heading, F.lit(False)), strip(F.regexp_extract(first, fixed.CHAPTER_HEADING, 1))).otherwise(
        F.url_decode(F.regexp_replace(_stem(F.col("path")), r"\+", "%2B"))
    )
    return files.select(
        F.lit(course).alias("course"), name.alias("chapter"), "text", F.array().cast("array<int>").alias("pages"), "path"
    )


def read_markdown_tree(spark: SparkSession, folder: str, course: str) -> DataFrame:
    """All ``*.md`` below a folder as one page stream ``(source, page_ord, page_no, text)``.

    ``page_ord`` counts on over the files in path order.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.md")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    names = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.md")
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"))
    )
    if names.isEmpty():
        raise FileNotFoundError(f"no Markdown file below {folder}")
    pages = ch.split_pages(files.join(ranked(names, "path", "file_ord"), "path"), ["file_ord"])
    counts = pages.groupBy("file_ord").agg((F.max("page_ord") + 1).alias("n"))
    ends = running(counts, [], ["file_ord"], {"_end": ("sum", F.col("n"))}, ordinal_block("file_ord", FILES_PER_BLOCK))
    starts = ends.select("file_ord", (F.col("_end") - F.col("n")).alias("_start"))
    return pages.join(starts, "file_ord").select(
        F.lit(course).alias("source"), (F.col("_start") + F.col("page_ord")).alias("page_ord"), "page_no", "text"
    )


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Chapter texts below ``course=<name>/file=<safe chapter name>``, for a look at the split."""
    name = F.substring(F.regexp_replace("chapter", fixed.FILE_UNSAFE, "_"), 1, fixed.FILE_NAME_CHARS)
    chapters.select("course", name.alias("file"), F.col("text").alias("value")).write.mode("overwrite").partitionBy(
        "course", "file"
    ).text(path)


def slice_plan(df: DataFrame, total: str | Column, size: int | Column) -> DataFrame:
    """Page slices ``(slice_no, first_page, last_page)``, zero-based and inclusive; none for totals or sizes <= 0."""
    total = F.col(total) if isinstance(total, str) else total
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(
        (total > 0) & (size > 0), F.sequence(F.lit(0).cast("bigint"), (total - 1).cast("bigint"), F.greatest(size, F.lit(1)).cast("bigint"))
    )
    return df.select("*", F.posexplode(starts).alias("_i", "first_page")).select(
        *df.columns,
        (F.col("_i") + 1).cast("bigint").alias("slice_no"),
        "first_page",
        (F.least(F.col("first_page") + size, total) - 1).cast("bigint").alias("last_page"),
    )


def batches(slices: DataFrame, batch_files: int = fixed.CONVERT_BATCH_FILES) -> DataFrame:
    """Request number of every slice: stable over runs because it depends on the slice number only."""
    return slices.withColumn("batch_no", F.floor((F.col("slice_no") - 1) / F.lit(batch_files)) + 1)


def remaining(slices: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Slices without output yet."""
    return slices.join(done.select(*keys).distinct(), keys, "left_anti")


def checked_results(slices: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Slices with their converted Markdown and an ``error`` for a missing or empty answer."""
    told = ["call_error"] if "call_error" in results.columns else []
    joined = slices.join(results.select(*keys, "md_content", *told), keys, "left")
    missing = F.coalesce(*told, F.lit("missing result"))
    return joined.withColumn(
        "error",
        F.when(F.col("md_content").isNull(), missing).when(F.col("md_content") == "", F.lit("empty result")),
    ).drop(*told)


def choose_backend(requested: str, default: str = "auto", cloud_key: bool = False, local_tool: bool = False) -> str:
    """``auto`` falls to the configured default, then to the cloud if it is the only usable one, else local."""
    if requested != "auto":
        return requested
    if default != "auto":
        return default
    return fixed.CLOUD_BACKEND if cloud_key and not local_tool else fixed.LOCAL_BACKEND


def reader_for(path: str, backend: str = "auto") -> str:
    """Which reader a file goes to: ``text``, ``auto`` (PDF, back-end still to choose) or a back-end name."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".pdf":
        if backend not in fixed.PDF_BACKENDS:
            raise ValueError(f"unknown PDF back-end {backend!r}; known: {', '.join(fixed.PDF_BACKENDS)}")
        return backend
    if suffix in fixed.OFFICE_SUFFIXES:
        if backend == fixed.LOCAL_BACKEND:
            raise ValueError("the local back-end reads PDF only; use the cloud back-end for office files")
        if backend in ("auto", fixed.CLOUD_BACKEND):
            return fixed.CLOUD_BACKEND
    return "text"


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page objects counted in the raw bytes of PDF files; null where none is visible."""
    raw = F.decode(F.col("content"), "ISO-8859-1")
    count = F.regexp_count(raw, F.lit(r"/Type\s*/Page(?!s)\b"))
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select("path", F.when(count > 0, count).cast("bigint").alias("total_pages"))
    )
