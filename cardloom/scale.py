"""Building blocks that keep ordered and ranked operators safe on hot keys.

A plain window sends all rows of one key to one task.  ``running`` instead
splits every key into ordered blocks: rows are windowed inside
``(key, block)``, each block is summed up map-side, the few block sums are
windowed per key, and the carry is joined back.  One hot user, source or
course is then spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cardloom.session import checkpointed

BLOCK = "_block"
ROWS_PER_BLOCK = 1_000_000
FILES_PER_BLOCK = 50_000
ROWS_AT_ONCE = 1_000

# "max_before" leaves out the current row
_AGGREGATES = {"sum": F.sum, "max": F.max, "max_before": F.max}


def _merged(op: str, carry: Column, own: Column) -> Column:
    return F.coalesce(carry + own, own, carry) if op == "sum" else F.greatest(carry, own)


def _running(op: str, value: Column, window: WindowSpec) -> Column:
    last = -1 if op == "max_before" else 0
    return _AGGREGATES[op](value).over(window.rowsBetween(Window.unboundedPreceding, last))


def sized_block(
    df: DataFrame, keys: Sequence[str], position: Column, rows_per_block: int = ROWS_PER_BLOCK
) -> Column | None:
    """Block column over a numeric ``position``, sized so that the hottest key gets about ``rows_per_block`` rows a block.

    Returns None when every key is measured to fit one block, so the caller
    may use a plain window.  One aggregated row reaches the driver.
    """
    hottest = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"), (F.max(position) - F.min(position)).alias("span"))
        .agg(F.max(F.struct("n", "span")).alias("h"))
        .first()["h"]
    )
    if hottest is None or hottest["n"] <= rows_per_block:
        return None
    blocks = -(-hottest["n"] // rows_per_block)
    return F.floor(position / F.lit(max((hottest["span"] or 0.0) / blocks, 1e-3)))


def time_block(df: DataFrame, keys: Sequence[str], ts: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column | None:
    """``sized_block`` over a timestamp column."""
    return sized_block(df, keys, F.col(ts).cast("timestamp").cast("double"), rows_per_block)


def ordinal_block(ordinal: str | Column, rows_per_block: int = ROWS_PER_BLOCK) -> Column:
    """Block column for a near-dense ordinal such as a line, page or row number."""
    col = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(col / F.lit(rows_per_block))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, tuple[str, Column]],
    block: Column | None,
) -> DataFrame:
    """Running ``sum``, ``max`` and ``max_before`` (current row left out) per key in ``order``.

    ``block`` must never decrease in ``order`` within a key.  Null keys are keys
    of their own; rows without a block (a null position) come first, as nulls
    do in ``order``, and form a block of their own.
    """
    if block is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: _running(op, e, window) for n, (op, e) in values.items()})

    blocked = df.withColumn(BLOCK, F.coalesce(block.cast("double"), F.lit(float("-inf"))))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    rows = blocked.withColumns({n: _running(op, e, inside) for n, (op, e) in values.items()})
    sums = blocked.groupBy(*keys, BLOCK).agg(
        *[_AGGREGATES[op](e).alias(f"_sum_{n}") for n, (op, e) in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *keys,
        BLOCK,
        *[_AGGREGATES[op](f"_sum_{n}").over(before).alias(f"_carry_{n}") for n, (op, _) in values.items()],
    )
    own = carry.withColumnsRenamed({k: f"_key_{k}" for k in (*keys, BLOCK)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in (*keys, BLOCK)]
    joined = rows.join(own, reduce(and_, same))
    return joined.withColumns(
        {n: _merged(op, F.col(f"_carry_{n}"), F.col(n)) for n, (op, _) in values.items()}
    ).select(*df.columns, *values)


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    salt: Column | None = None,
    salts: int = 32,
) -> DataFrame:
    """First ``n`` rows per key.

    ``row_number() <= n`` is cut map-side by Spark's group limit; ``salt``
    adds a second, spread-out cut so that a key present in very many input
    partitions does not hand n rows from each of them to one task.
    """
    if salt is not None:
        pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
            .withColumn(rank, F.row_number().over(pre))
            .filter(F.col(rank) <= n)
            .drop("_salt", rank)
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than cores, before heavy per-row work.

    Large inputs already have more partitions than cores and pass unchanged.
    Meant for plain scans: the partition count of a scan is known without running it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """Position of every row in the order of ``by``, counted from 0.

    Rows are range-partitioned and sorted, written to the checkpoint folder
    with their place in the partition, and shifted by the sizes of the
    partitions before.  No task sees more than its own range.
    """
    placed = checkpointed(
        df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    # kept, or every reader of the result would count all rows again
    starts = checkpointed(sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + inside)
        .select(*df.columns, name)
    )


def slices(frames: Iterator[pd.DataFrame], rows: int = ROWS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """Frames of at most ``rows`` rows, for functions whose memory grows with the rows they hold at once."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows].reset_index(drop=True)


def clustered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows of a key in one partition, sorted by key and ``order``, for functions over sorted streams.

    The shuffle is on a hash of the keys on purpose.  A repartition by the
    keys themselves is dropped when a join below already has that
    partitioning, and the adaptive skew join may then split a key over
    several tasks, which a partition function would not notice.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
