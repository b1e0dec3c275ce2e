"""Session helpers: a tuned local builder and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "tabscope", partitions: int | None = None) -> SparkSession:
    """A session for tests and the local benchmark.  On a cluster use the cluster's own session."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(partitions or (os.cpu_count() if cores == "*" else cores)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("TABSCOPE_DRIVER_MEMORY", "8g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder the session names.

    Executors may be lost at any time, so the result has to live outside them.  A
    folder of our own is made only where none is set and the session is local.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            shared = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(shared)
    return df.checkpoint()
