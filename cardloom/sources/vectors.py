"""The stored vector table: token counts of every card, written once and read by the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.operators import retrieval as rt
from cardloom.session import checkpointed

_TYPES = {
    "course": T.StringType(),
    "card_id": T.StringType(),
    "ord": T.LongType(),
    "boosted": T.BooleanType(),
    "reference_only": T.BooleanType(),
    "keyword_tokens": T.ArrayType(T.StringType()),
    "lexical_counts": T.ArrayType(T.IntegerType()),
    "document_counts": T.ArrayType(T.IntegerType()),
    "document": T.StringType(),
    "chapter": T.StringType(),
    "kind": T.StringType(),
    "topic": T.StringType(),
}


class VectorTable:
    """Parquet table partitioned by course and by a hash bucket of the card id, like the card table."""

    MAX_PRUNED = 10_000

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _stored(self) -> DataFrame:
        fields = [T.StructField(name, kind) for name, kind in _TYPES.items()]
        return self.spark.read.schema(T.StructType([*fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        """Rows that ``candidates``, ``lexical_topk``, ``vector_topk`` and ``hybrid_topk`` take in place of cards."""
        return self._stored().drop("bucket")

    def _save(self, rows: DataFrame) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("course", "bucket")
            .parquet(self.path)
        )

    def _rows(self, cards: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("card_id"), F.lit(self.buckets)).cast("int")
        return rt.counted_cards(cards).select(*_TYPES).withColumn("bucket", bucket)

    def rebuild(self, cards: DataFrame) -> None:
        """Vectors of all ``cards`` (unique ids per course), in place of whatever was stored."""
        rows = checkpointed(self._rows(cards))  # cards may come from this table's own neighbours
        rows.repartitionByRange("course", "bucket", "ord").write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).partitionBy("course", "bucket").parquet(self.path)

    def upsert(self, cards: DataFrame) -> None:
        """Vectors of new and changed cards (unique ids per course); only their partitions are read and rewritten.

        Stored and new rows meet in one range shuffle by (course, bucket, id), where a stored row goes if a new one has its id.
        """
        incoming = checkpointed(self._rows(cards))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            self._save(incoming.repartitionByRange("course", "bucket", "ord"))
            return
        parts = checkpointed(incoming.select("course", "bucket").distinct())
        known = parts.limit(self.MAX_PRUNED + 1).collect()
        stored = self._stored()
        if len(known) <= self.MAX_PRUNED:
            stored = stored.filter(
                F.col("course").isin(*{r["course"] for r in known}) & F.col("bucket").isin(*{r["bucket"] for r in known})
            )
            parts = F.broadcast(parts)
        touched = stored.join(parts, ["course", "bucket"], "left_semi")
        both = touched.select(*incoming.columns, F.lit(False).alias("_new")).unionByName(incoming.withColumn("_new", F.lit(True)))
        keys = ["course", "bucket", "card_id"]
        newest = F.max("_new").over(Window.partitionBy(*keys))
        met = both.repartitionByRange(*keys).withColumn("_newest", newest)
        merged = met.filter(F.col("_new") | ~F.col("_newest") | F.col("card_id").isNull()).drop("_new", "_newest")
        self._save(checkpointed(merged))
