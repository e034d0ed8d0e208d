"""Card files and the card table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import fixed_values as fixed
from cardloom.functions.text import strip
from cardloom.operators import cards as ops
from cardloom.scale import FILES_PER_BLOCK, ordinal_block, ranked, running
from cardloom.schema import CARD, CARD_COLUMNS, QUESTION
from cardloom.session import checkpointed


def safe_name(name: Column) -> Column:
    """File-safe course name: word characters, dot, dash and blank stay."""
    clean = F.regexp_replace(strip(F.regexp_replace(name, fixed.NAME_UNSAFE, "_")), r"\.+$", "")
    return F.when(clean == "", F.lit("course")).otherwise(clean)


def safe_chapter_file(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, fixed.FILE_UNSAFE, "_"), 1, fixed.FILE_NAME_CHARS)


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parsed lines with ``card``, ``error``, ``file`` and ``ord``; blank lines are skipped.

    ``ord`` rises over the files in path order and over the lines of a file,
    however the files are split: the bytes of all files before, plus the start
    byte of the split, plus the row's position in its partition.  A row takes
    at least one byte, and a partition's splits are read one after the other,
    so the position counts from the first row of the split.
    """
    found = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length"))
    placed = running(ranked(found, "file", "_n"), [], ["_n"], {"_end": ("sum", F.col("length"))}, ordinal_block("_n", FILES_PER_BLOCK))
    files = placed.select("file", (F.col("_end") - F.col("length")).alias("_start"))
    rows = spark.read.text(path).select(
        F.col("value").alias("raw_json"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # one row per split: where its rows begin in the partition that reads it
    splits = rows.groupBy("file", "_split").agg(F.min("_at").alias("_first")).join(files, "file")
    placed = rows.join(F.broadcast(splits) if _few_files(spark, path) else splits, ["file", "_split"]).select(
        "raw_json", "file", (F.col("_start") + F.col("_split") + F.col("_at") - F.col("_first")).alias("ord")
    )
    return ops.parse_cards(placed.filter(strip(F.col("raw_json")) != ""))


MAX_BROADCAST_SPLITS = 100_000


def _few_files(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether the splits of the files, known from the scan's own partitions and files, are few enough to broadcast."""
    scan = spark.read.text(path)
    return len(scan.inputFiles()) + scan.rdd.getNumPartitions() <= MAX_BROADCAST_SPLITS


def load_cards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Valid cards of course files; ``ord`` is their place over all files."""
    return ops.valid_cards(read_jsonl(spark, path), "ord")


def write_jsonl(cards: DataFrame, path: str) -> None:
    """One folder per course, records in card order."""
    cards.repartitionByRange("course", "ord").sortWithinPartitions("course", "ord").select(
        "course", F.to_json(F.struct(*CARD_COLUMNS)).alias("value")
    ).write.mode("overwrite").partitionBy("course").text(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path).filter(F.col("question").isNotNull())


class CardTable:
    """Parquet card table partitioned by course and, within a course, by a hash bucket of the id.

    ``buckets`` is fixed when the table is made; a batch rewrites only the
    (course, bucket) partitions that its ids fall into.
    """

    MAX_PRUNED = 10_000

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _stored(self) -> DataFrame:
        schema = T.StructType([*CARD.fields, T.StructField("ord", T.LongType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().select(*CARD_COLUMNS, "ord")

    def _parts(self, incoming: DataFrame) -> DataFrame:
        """Partitions that a batch falls into; kept, since they are read several times."""
        return checkpointed(incoming.select("course", self._bucket().alias("bucket")).distinct())

    def touched(self, incoming: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """Stored rows, with ``bucket``, of the partitions that a batch falls into.

        The batch's partitions, at most ``MAX_PRUNED``, reach the scan as
        partition filters; a batch of more is joined.
        """
        parts = self._parts(incoming) if parts is None else parts
        known = parts.limit(self.MAX_PRUNED + 1).collect()
        stored = self._stored()
        if len(known) <= self.MAX_PRUNED:
            stored = stored.filter(
                F.col("course").isin(*{r["course"] for r in known}) & F.col("bucket").isin(*{r["bucket"] for r in known})
            )
            parts = F.broadcast(parts)
        return stored.join(parts, ["course", "bucket"], "left_semi")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def courses(self) -> DataFrame:
        """Course names, read from the partition values."""
        return self.read().select("course").distinct().orderBy("course")

    def save(self, incoming: DataFrame) -> int:
        """Upsert; rewrites the touched partitions only and returns how many ids were new.

        A batch's positions are ranked to dense numbers first and follow the
        largest position of its courses, so they never run out.  The new rows
        are checkpointed before their partitions are replaced, so the table
        never overwrites files it is still reading.
        """
        incoming = ranked(incoming.select(*CARD_COLUMNS, "ord"), "ord", "_place").drop("ord").withColumnRenamed("_place", "ord")
        if not self.exists():
            merged = ops.last_per_id(incoming).withColumn("is_new", F.lit(True))
        else:
            # only positions are read of the courses' other partitions
            parts = self._parts(incoming)
            ends = self._stored().join(parts.select("course").distinct(), "course", "left_semi")
            end = ends.agg(F.max("ord")).first()[0]
            merged = ops.upsert(self.touched(incoming, parts).drop("bucket"), incoming, end=end)
        merged = checkpointed(merged.withColumn("bucket", self._bucket()))
        (
            merged.drop("is_new")
            .repartitionByRange("course", "bucket", "ord")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("course", "bucket")
            .parquet(self.path)
        )
        return merged.filter("is_new").count()

    def flag_reference(self) -> int:
        """Write the reference-only flag where it is missing; returns the number of changed cards."""
        changed = checkpointed(ops.flag_preview(self.read()).withColumn("reference_only", F.lit(True)))
        count = changed.count()
        if count:
            self.save(changed)
        return count
