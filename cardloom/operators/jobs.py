"""Ingest job records: stored history overlaid with live jobs, and log tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.scale import top_per_key

LIVE_FIELDS = ("status", "exit", "error", "log_tail", "started_at", "finished_at", "cards")


def job_history(stored: DataFrame, live: DataFrame) -> DataFrame:
    """One row per known job, newest first.  A live job's field replaces the stored one, null included.

    Both sides have one row per ``jid``.  Jobs known only from memory have
    their live fields and no others, so they carry no id of their own and are
    not listed, as for a job whose upload was never recorded.
    """
    fields = [c for c in LIVE_FIELDS if c in live.columns]
    running = live.select("jid", F.struct(*fields).alias("_live"))
    joined = stored.join(running, "jid", "left")
    return joined.select(
        *[
            (F.when(F.col("_live").isNotNull(), F.col(f"_live.{c}")).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c)
            for c in stored.columns
        ]
    ).orderBy(F.desc(F.coalesce("started_at", "finished_at", F.lit(""))))


def log_tail(lines: DataFrame, n: int = fixed.JOB_LOG_TAIL) -> DataFrame:
    """Last ``n`` log lines per job (columns jid, line_no, line)."""
    return top_per_key(lines, ["jid"], [F.desc("line_no")], n, rank="age", salt=F.col("line_no"))
