"""What the corpus operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine alone."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back.

    Everything after it starts from files that outlive an executor, and Spark knows their size when it chooses joins. What
    led to it is done with, so the collectors are asked to let its shuffle files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a table from durable, when nothing will read it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._siltstone_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def md5_number(text: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the MD5 of a string, as a long."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
