"""Cutting lineage between rounds of an iteration, in the folder that the cluster shares; spreading small inputs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, made the session's checkpoint folder if it has none; a temporary one only where that is unset and Spark runs on this machine alone."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in shared_dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over all tasks if it comes from fewer files than there are shuffle partitions; a table of many files is read where it is."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if len(df._jdf.inputFiles()) < n else df  # the number alone: names stay in the JVM
