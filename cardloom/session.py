"""Session defaults and the shared checkpoint folder."""

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "cardloom") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder the cluster names in ``spark.checkpoint.dir``.

    Where a session on one machine names none, as in tests, a temporary one is
    set.  On a cluster that is an error: executors would write to disks of their own.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cardloom-checkpoint-"))
    return context.getCheckpointDir()


def shared_table(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, for a table that is written and read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per context; Arrow functions import it there."""
    context = spark.sparkContext
    if getattr(context, "_cardloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="cardloom-package-"), "cardloom")
    context.addPyFile(shutil.make_archive(base, "zip", root, "cardloom"))
    context._cardloom_shipped = True
