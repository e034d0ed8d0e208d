"""Raw card records as a stream into the card table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardloom.operators import cards as ops
from cardloom.sources.cards import CardTable


def store_stream(raw: DataFrame, store: CardTable, checkpoint: str, rejects_path: str | None = None) -> StreamingQuery:
    """``raw``: a stream with ``raw_json`` and ``ord``.  Every micro-batch is validated and upserted by id.

    Saving the same batch again after a failure gives the same table and the
    same rejects, which have a folder per batch.
    """

    def save(batch: DataFrame, number: int) -> None:
        parsed = ops.parse_cards(batch)
        valid = ops.valid_cards(parsed, "ord")
        if not valid.isEmpty():
            store.save(valid)
        if rejects_path:
            ops.rejects(parsed).select("raw_json", "error").write.mode("overwrite").json(f"{rejects_path}/batch={number}")

    return (
        raw.select("raw_json", F.col("ord").cast("bigint").alias("ord"))
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
