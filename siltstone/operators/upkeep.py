"""Keeping indexes in step with changing inputs: hashes, differences, merges, drift, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from siltstone.functions import text as tx

#: Settings whose change asks for a rebuild, and those that only call for a warning.
CRITICAL = ("embedding_model", "path", "chunker_version")
WARNING = ("extensions", "collection")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def partition_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status): unchanged, changed, added or removed. found and known have path and sha256; an unreadable file (null or empty hash) counts as changed."""
    both = found.select("path", F.coalesce("sha256", F.lit("")).alias("new")).join(known.select("path", F.coalesce("sha256", F.lit("")).alias("old")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when((F.col("new") == F.col("old")) & (F.col("new") != ""), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def merge_chunks(stored: DataFrame, fresh: DataFrame, status: DataFrame) -> DataFrame:
    """Stored chunks without those of changed and removed files, and the fresh chunks of changed and added ones."""
    gone = status.where(F.col("status").isin("changed", "removed")).select(F.col("path").alias("file_path"))
    come = status.where(F.col("status").isin("changed", "added")).select(F.col("path").alias("file_path"))
    return stored.join(gone, "file_path", "left_anti").unionByName(fresh.join(come, "file_path", "left_semi").select(*stored.columns))


def merge_postings(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Postings with those of touched chunks(id) replaced; term statistics are counted from postings, so this equals a rebuild."""
    return stored.join(touched.select("id"), "id", "left_anti").unionByName(fresh.select(*stored.columns))


def drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(setting, old, new, severity) for each setting that differs between two tables of (setting, value)."""
    both = stored.select("setting", F.col("value").alias("old")).join(current.select("setting", F.col("value").alias("new")), "setting", "full_outer")
    severity = F.when(F.col("setting").isin(*CRITICAL), "critical").when(F.col("setting").isin(*WARNING), "warning").otherwise("info")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("setting", "old", "new", severity.alias("severity"))


def debounced(events: DataFrame, key: str, at: str, action: str, quiet: str = "2 seconds") -> DataFrame:
    """(key, first_at, last_at, n_events, action): bursts of one key with no gap of quiet or more; the last action of a burst counts."""
    burst = events.groupBy(F.col(key).alias("key"), F.session_window(at, quiet)).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_events"), F.max_by(action, at).alias("action"))
    return burst.drop("session_window")


def detect_extensions(files: DataFrame, top_n: int = 10) -> DataFrame:
    """(extension, n): the commonest suffixes."""
    return files.groupBy(tx.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n")).where("extension <> ''").orderBy(F.col("n").desc(), "extension").limit(top_n)


def language_histogram(files: DataFrame, top_n: int = 8) -> DataFrame:
    """(language, n): the commonest languages of files by suffix."""
    return files.groupBy(tx.language(F.col("path")).alias("language")).agg(F.count("*").alias("n")).where("language is not null").orderBy(F.col("n").desc(), "language").limit(top_n)


def source_status(chunks: DataFrame) -> DataFrame:
    """(source, n_files, n_chunks, last_update) of each source."""
    return chunks.groupBy("source").agg(F.countDistinct("file_path").alias("n_files"), F.count("*").alias("n_chunks"), F.max("updated_at").alias("last_update"))


def feedback_summary(records: DataFrame) -> DataFrame:
    """(source, n, first_at, last_at) over feedback records, one for each source that they name."""
    each = records.select("at", F.explode_outer("sources").alias("source"))
    return each.groupBy("source").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def outline_savings(chunks: DataFrame, content: str = "content") -> DataFrame:
    """One row: tokens (characters / 4) of whole bodies and of their outlines, and the share that outlines save."""
    outline = F.length(F.concat_ws(" ", tx.signature(F.col(content)), tx.doc_line(F.col(content))))
    sums = chunks.agg(F.sum(F.floor(F.length(F.coalesce(content, F.lit(""))) / 4)).alias("full_tokens"), F.sum(F.floor(outline / 4)).alias("outline_tokens"))
    return sums.withColumn("saved", F.round(1 - F.col("outline_tokens") / F.col("full_tokens"), 6))


def last_of(rows: DataFrame, by: str, at: str, n: int) -> DataFrame:
    """The last n rows of each group; those of equal time in the order of their other values."""
    ties = [F.col(c) for c in rows.columns if c not in (by, at) and not isinstance(rows.schema[c].dataType, MapType)]
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(F.col(at).desc(), *ties))).where(F.col("nth") <= n).drop("nth")
