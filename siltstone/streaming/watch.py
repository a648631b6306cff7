"""A folder as a stream of file events, and the loop that keeps an index in step with it."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources import files
from siltstone.sources.files import normal_extensions
from siltstone.sources.store import Log

from .live import commit_batch

EVENT = "path string, at timestamp, action string"


class FolderReader(api.SimpleDataSourceStreamReader):
    """Offsets are times: a batch has the files changed after its start and up to its end. That a file is gone its time doesn't tell; see watch()."""

    def __init__(self, root: str, extensions: list[str]):
        self.root, self.extensions = root, tuple(normal_extensions(extensions))

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def _found(self, since: int, until: int) -> Iterator[tuple]:
        for folder, inner, names in os.walk(self.root):
            inner[:] = sorted(d for d in inner if not d.startswith("."))
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not name.startswith(".") and name.lower().endswith(self.extensions):
                    try:
                        at = os.stat(path).st_mtime_ns
                    except FileNotFoundError:
                        continue  # gone since the listing
                    if since < at <= until:
                        yield path, datetime.fromtimestamp(at / 1e9, timezone.utc), "update"

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """All up to now; files written within the last moment wait for the next batch, as their clock may be coarse."""
        until = max(start["ns"], time.time_ns() - 50_000_000)
        return iter(list(self._found(start["ns"], until))), {"ns": until}  # Spark copies it

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self._found(start["ns"], end["ns"])))


class FolderSource(api.DataSource):
    """`format("siltstone_folder")`: options path and extensions, a list with commas. The listing runs on the driver, so the folder is one that the driver sees; one row a changed file leaves it."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_folder"

    def schema(self) -> str:
        return EVENT

    def simpleStreamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("extensions", "py").split(","))


def events(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, at, action) of the files below root as they change."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("siltstone_folder").option("path", root).option("extensions", ",".join(extensions)).load()


def watch(spark: SparkSession, root: str, extensions: list[str], log: Log, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a query that commits what changes below root to the log: once what has changed by now, or with every, such as "2 seconds", from then on.

    A batch reads its own files, as they are when it runs. Files that the log has chunks of and that the folder no longer has are deletions.
    """

    def one(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").distinct().collect()]  # what the driver's own listing found
        read = files.contents(spark, paths)
        there = files.paths_below(spark, root)
        state = log.state()
        known = log.table("chunks", state).select(F.col("file_path").alias("path")).distinct() if state and "chunks" in state.tables else there.limit(0)
        lost = known.join(there, "path", "left_anti").select("path", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("content"))
        changes = read.select("path", F.lit("update").alias("action"), "content").unionByName(lost).withColumn("at", F.current_timestamp())
        commit_batch(changes, number, log, chunker, stream=f"watch {root}")

    writer = events(spark, root, extensions).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
