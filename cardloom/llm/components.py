"""Connected components of a link table by alternating large and small stars.

Every round replaces the links by links to smaller neighbours until each
component is a star around its smallest node.  A round is two aggregations
and two joins on node ids; no neighbour list is ever collected, so a node
with very many links is spread over tasks like any skewed join.  Rounds are
cut by checkpoints in the shared folder; the number of rounds grows with the
logarithm of the longest chain.  A round has the tasks that its links are worth,
and of its rows none is fetched to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import by_shuffle, fewer
from cardloom.session import checkpointed


def _starred(links: DataFrame, both_ways: bool, n: int) -> DataFrame:
    """Links (node > low) after one star step over ``n`` links; ``both_ways`` is the large star."""
    seen = links.select("node", F.col("low").alias("near"))
    if both_ways:
        seen = seen.unionByName(links.select(F.col("low").alias("node"), F.col("node").alias("near")))
    least = fewer(seen.groupBy("node").agg(F.min("near").alias("least")), n)
    joined = fewer(seen.join(by_shuffle(least.withColumn("least", F.least("least", "node"))), "node"), n)
    if both_ways:  # larger neighbours hang on the least one
        moved = joined.filter("near > node").select(F.col("near").alias("node"), F.col("least").alias("low"))
    else:  # smaller neighbours, and the node itself, hang on the least one
        moved = joined.select(F.col("near").alias("node"), F.col("least").alias("low")).unionByName(
            joined.select("node", F.col("least").alias("low"))
        )
    return fewer(moved.filter("node > low").distinct(), n)


def components(links: DataFrame, a: str, b: str, at_most: int | None = None) -> DataFrame:
    """(node, component) for every node that has a link to another; component = smallest reachable node.

    ``at_most``: a number of links that is known not to be exceeded.  Null ends
    and links of a node to itself count for nothing.  An empty table gives an
    empty table.
    """
    ordered = (
        links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("low"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("node") > F.col("low")))
        .distinct()
    )
    now = checkpointed(fewer(ordered, at_most))
    state = None
    while True:
        row = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("node", "low").cast("decimal(38,0)")).alias("h"),
        ).first()
        if row == state or row["n"] == 0:
            break
        state = row
        now = checkpointed(_starred(_starred(now, True, state["n"]), False, state["n"]))
    roots = fewer(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct(), row["n"])
    return now.select("node", F.col("low").alias("component")).unionByName(roots)
