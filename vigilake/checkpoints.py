"""Cutting lineage where a result must be the same for all that read it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if it isn't yet.

    It is the cluster's own, spark.checkpoint.dir, or one that the caller has set on the context. A folder of our own choice would be
    one machine's: executors elsewhere couldn't read it, and what a lost one wrote would be gone. Only where all of Spark is one process, as in tests, one is made.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vigilake-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
