"""PDF files: the state of each, page rows, page files. The extractor itself is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_MB, MAX_PAGES, LEAST_CHARS = 100, 5_000, 100


def status_of(max_mb: float = MAX_MB, max_pages: int = MAX_PAGES, least_chars: int = LEAST_CHARS) -> Column:
    """ok, skipped_password, skipped_too_large, skipped_too_many_pages, skipped_empty or error, of the columns encrypted, size_mb, total_pages, n_chars, error; limits are tested before anything is extracted."""
    return (
        F.when(F.coalesce("encrypted", F.lit(False)), "skipped_password")
        .when(F.coalesce("size_mb", F.lit(0.0)) > max_mb, "skipped_too_large")
        .when(F.coalesce("total_pages", F.lit(0)) > max_pages, "skipped_too_many_pages")
        .when(F.coalesce("n_chars", F.lit(0)) < least_chars, "skipped_empty")
        .when(F.col("error").isNotNull(), "error")
        .otherwise("ok")
    )


def summary(states: DataFrame) -> DataFrame:
    """One row: n_ok, n_skipped, and the pages of those that are ok."""
    ok = F.col("status") == "ok"
    return states.agg(F.sum(ok.cast("long")).alias("n_ok"), F.sum(F.startswith("status", F.lit("skipped")).cast("long")).alias("n_skipped"), F.sum(F.when(ok, F.col("total_pages")).otherwise(0)).alias("pages"))


def discover(spark: SparkSession, root: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(path, size_mb, content) of the PDF files below root; not those in folders with a leading dot."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return found.where(F.lower("path").endswith(".pdf") & ~F.col("path").rlike(r"/\.[^/]+/")).select("path", (F.col("length") / 1048576.0).alias("size_mb"), "content")


def _extract(batches: Iterator[pa.RecordBatch], extractor: Callable[[bytes], list[str]], max_mb: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, mb, content in zip(*(c.to_pylist() for c in batch.columns)):
            pages, error = [], None
            if mb <= max_mb:
                try:
                    pages = extractor(content)
                except Exception as e:  # a broken file is a row with its error, not a failed job
                    error = f"{type(e).__name__}: {e}"[:500]
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([mb]), pa.array([pages], pa.list_(pa.string())), pa.array([error], pa.string())], names=["path", "size_mb", "pages", "error"])


def extract(files: DataFrame, extractor: Callable[[bytes], list[str]], max_mb: float = MAX_MB) -> DataFrame:
    """(path, size_mb, pages, error, total_pages, n_chars, encrypted, status): extractor turns a file's bytes into its pages' texts and may raise."""
    rows = files.select("path", "size_mb", "content").mapInArrow(partial(_extract, extractor=extractor, max_mb=max_mb), "path string, size_mb double, pages array<string>, error string")
    rows = rows.withColumns({"total_pages": F.size("pages"), "n_chars": F.aggregate("pages", F.lit(0), lambda n, p: n + F.length(p)), "encrypted": F.coalesce(F.contains(F.lower("error"), F.lit("password")), F.lit(False))})
    return rows.withColumn("status", F.when(F.col("error").isNotNull() & ~F.col("encrypted"), "error").otherwise(status_of(max_mb)))


def page_file(page: Column) -> Column:
    """The name of a page's file."""
    return F.format_string("page_%04d.md", page)


def page_rows(extracted: DataFrame) -> DataFrame:
    """(path, page, file, text) of the pages of files that are ok, from page 1, with the name of each page's file."""
    each = extracted.where("status = 'ok'").select("path", F.posexplode("pages").alias("nth", "text"))
    return each.select("path", (F.col("nth") + 1).alias("page"), page_file(F.col("nth") + 1).alias("file"), "text")


def refresh_pages(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """Stored page rows with all pages of the extracted files replaced, so a file that shrank leaves none behind."""
    return stored.join(extracted.select("path").distinct(), "path", "left_anti").unionByName(page_rows(extracted))
