"""Intermediate results that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster the folder has to be shared, so a missing setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there with a short lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
