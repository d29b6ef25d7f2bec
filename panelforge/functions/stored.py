"""Tables that a plan reads more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the context's checkpoint folder, which is the one that the session's
    spark.checkpoint.dir names unless it was set before.

    Local sessions without either get a temporary one; on a cluster that is an error, as each machine would write to a folder of its own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelforge-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` worked out once and written to the shared folder, so that plans over it begin there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
