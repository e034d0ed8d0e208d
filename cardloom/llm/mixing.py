"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue up in a fixed shuffled order, over and over for
at most ``epochs`` rounds.  A copy that ends after ``c`` words of its source
has the virtual finish time ``c / target``, so all sources reach their
targets at the virtual time 1.  Sorting all copies by finish time gives the
mix; it is cut at the virtual time at which the total budget is served.  A
copy in service at that moment is cut at the word where its source's share
ends, so every source takes its target to the word.  With ``whole``, copies
that end after that moment are left out instead, so no text is cut and every
source falls short of its target by less than one document; a source whose
target is below its first document takes nothing.

Scale: one scan of the texts for the word counts.  Prefix sums per source are
split into ``BLOCKS`` hash blocks per source: a window inside (source, block),
and a window over the at most ``BLOCKS`` block sums of a source.  A source
that holds a third of all rows is spread over all its blocks.  Source sums are
combined before the shuffle; sources are ranked by a range sort, and their
targets are settled by a few aggregations that bring two numbers to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import WORD, hash_order
from cardloom.scale import ranked
from cardloom.session import checkpointed

WEIGHTS = (5, 2, 1)
EPOCHS = 3
_BLOCK_DIGITS = 3
BLOCKS = 16**_BLOCK_DIGITS


def words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def _source_key(source: str) -> Column:
    """Sorts by code point with null last, and joins without nulls."""
    return F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(src, source_size, target) from (src, size).

    Sources in key order take the weights in turn and share the total of all
    sizes; a target stops at ``epochs`` times its source's size, and the
    excess is shared again by weight until none is above.
    """
    sums = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limit = epochs * F.col("source_size")
    sources = checkpointed(
        ranked(sums, "src", "_rank").select(
            "src",
            "source_size",
            F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")).alias("weight"),
        )
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, None
    while True:  # the level only rises, so sources that have stopped stay stopped
        stopped = F.lit(level) * F.col("weight") > limit
        row = sources.agg(
            F.sum(F.when(stopped, limit).otherwise(0)).alias("fixed"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not row["free"] or (row["fixed"], row["free"]) == free:
            break
        free = (row["fixed"], row["free"])
        level = (total - row["fixed"]) / row["free"]
    stopped = F.lit(level) * F.col("weight") > limit
    return sources.select(
        "src",
        "source_size",
        F.when(stopped, limit.cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"),
    )


def fair_queue(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    budget: int | None = None,
    keep: Sequence[str] | None = None,
    whole: bool = False,
) -> DataFrame:
    """One row per document: ``doc`` (its columns, or those in ``keep``), size, source_size, target, copies, taken.

    ``copies`` holds (epoch, finish, words) of each copy the mix takes, in
    service order; ``taken`` is the sum of their words.  ``budget`` (words,
    default: all sizes) cuts all queues at the same virtual time.  ``whole``
    leaves out the copies that this moment would cut.

    Null texts have no words and are never taken.  A null source is a source
    of its own, last in order.  Repeated rows are separate documents; ties of
    the shuffle order fall to doc_id and size, and rows equal in all three are
    interchangeable.  Null ids queue by the md5 of the empty text.  An empty
    table gives an empty table.  Columns keep their names inside ``doc``.
    """
    shuffle = hash_order(F.col("doc_id"))
    keyed = docs.select(
        _source_key("source").alias("src"),
        F.substring(shuffle, 1, _BLOCK_DIGITS).alias("block"),
        shuffle.alias("turn"),
        words("text").alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in sorted({*(keep or docs.columns), "doc_id"}, key=docs.columns.index)]).alias("doc"),
    )
    sums = checkpointed(keyed.groupBy("src", "block").agg(F.sum("size").alias("size")))
    targets = source_targets(sums, weights, epochs)
    share = 1.0
    if budget is not None:
        planned = targets.agg(F.sum("target")).first()[0] or 0.0
        share = min(1.0, budget / planned) if planned else 0.0
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("carry", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .drop("size")
        .join(targets, "src")
    )
    inside = Window.partitionBy("src", "block").orderBy("turn", "doc.doc_id", "size")
    end = F.col("carry") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    served = F.floor(F.col("target") * share * (1 + 1e-12 if whole else 1))  # a copy that ends at the cut is in, whatever the rounding
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(epochs - 1)),
        lambda e: F.struct(
            e.alias("epoch"),
            ((e * F.col("source_size") + F.col("end")) / F.col("target")).alias("finish"),
            F.greatest(
                F.lit(0),
                F.least(F.col("size"), F.col("served") - e * F.col("source_size") - (F.col("end") - F.col("size"))),
            )
            .cast("bigint")
            .alias("words"),
        ),
    )
    return (
        keyed.join(starts, ["src", "block"])
        .withColumns({"end": end, "served": served})
        .withColumn("copies", F.filter(F.when(F.col("size") > 0, copies), lambda c: c["words"] >= (F.col("size") if whole else 1)))
        .select(
            "doc",
            "size",
            "source_size",
            "target",
            F.coalesce("copies", F.array().cast("array<struct<epoch:int,finish:double,words:bigint>>")).alias("copies"),
        )
        .withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda s, c: s + c["words"]))
    )


def mixed(queue: DataFrame) -> DataFrame:
    """The mix itself: one row per copy taken, with the document's columns, range-sorted by finish time.

    A copy cut by the budget carries the text up to the end of its last word
    taken, and the matching ``n_chars`` where there is such a column.
    """
    copies = queue.select("doc", "size", F.explode("copies").alias("copy"))
    order = copies.repartitionByRange(F.col("copy.finish"), F.col("doc.doc_id")).sortWithinPartitions(
        F.col("copy.finish"), F.col("doc.doc_id")
    )
    whole = F.col("copy.words") >= F.col("size")
    text = F.when(whole, F.col("doc.text")).otherwise(_first_words("doc.text", "copy.words"))
    names = [f.name for f in queue.schema["doc"].dataType.fields]
    columns = {name: F.col(f"doc.`{name}`") for name in names}
    columns["text"] = text
    if "n_chars" in columns:
        columns["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(F.length(text).cast("bigint"))
    return order.select(*[column.alias(name) for name, column in columns.items()])


def _first_words(text: str, n: str) -> Column:
    """The text from its start to the end of word ``n``; only for the few copies that the budget cuts."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(found, F.lit(1), F.col(n).cast("int")), "")
