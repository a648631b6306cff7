"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

KEY = ["digest", "n_bytes", "check"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Each input partition is a run. Level 0 makes of every run one row for each digest it holds, with the identifier that
    stays and the number of copies; each later round merges fan_in neighbouring runs (fan_in = 2 is the binomial tree,
    8 takes three of its rounds at once) until one is left. The aggregate over a struct is Spark's sort aggregate: runs are
    sorted by digest, exchanged, and merged in that order. A merge takes rows for copies only if the SHA-256, the length in
    bytes and a second, independent 64-bit hash all agree. A digest has one row for each run at most, so a text that makes
    up a third of the corpus weighs no more in any exchange than one row for each run that is left.

    The decision goes back down by (run, digest), which no group of copies can make hot.

    keep: "smallest" or "largest" identifier stays. Null text counts as empty. A null identifier loses to any other; rows
    with equal identifier and text are copies like any others, and exactly one row of a group is kept. An empty table gives
    an empty result. Other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    if fan_in < 2:
        raise ValueError("fan_in is 2 or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    rows = durable(rows)
    # In a struct a null sorts first: under max it loses; for min, whether it is null comes first.
    own = F.struct("id", "row_no") if keep == "largest" else F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no")
    best = F.max if keep == "largest" else F.min
    level = run0 = rows.groupBy("run", *KEY).agg(best(own).alias("best"), F.count("*").alias("n"))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        level = level.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))
        runs = -(-runs // fan_in)
    groups = level.where("n > 1").select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row_no").alias("keep_row"), F.col("n").alias("group_size"))
    down = run0.select("run", *KEY).join(groups, KEY)
    return rows.join(down, ["run", *KEY], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_row", "row_no") == F.col("row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
