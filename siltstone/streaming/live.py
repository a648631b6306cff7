"""Live upkeep: file events, debounced by path, applied to stored chunks batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siltstone.operators import postings
from siltstone.operators.lineage import checkpointed
from siltstone.sources.store import MANY, Change, Log


def moves_as_pairs(events: DataFrame) -> DataFrame:
    """(path, at, action): a move is a delete of the old path and an update of the new one; events have path, at, action, dest."""
    own = F.struct("path", "at", F.when(F.col("action") == "move", "delete").otherwise(F.col("action")).alias("action"))
    new = F.struct(F.col("dest").alias("path"), "at", F.lit("update").alias("action"))
    pairs = F.when((F.col("action") == "move") & F.col("dest").isNotNull(), F.array(own, new)).otherwise(F.array(own))
    return events.select(F.explode(pairs).alias("e")).select("e.*")


def debounce(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(path, action, at, n_events) by event time: a path's events with no gap of quiet are one, its last action counts. Runs on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("at", late)
    burst = events.groupBy("path", F.session_window("at", quiet)).agg(F.max_by("action", "at").alias("action"), F.max("at").alias("last"), F.count("*").alias("n_events"))
    return burst.select("path", "action", F.col("last").alias("at"), "n_events")


class Burst(StatefulProcessor):
    """The last action of a path and how many events it stands for, held until quiet_ms have passed without another; each event sets the timer anew."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "action string, at timestamp, n_events bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        action, at, n = self.burst.get() if self.burst.exists() else (None, None, 0)
        for frame in rows:
            if len(frame):
                last = frame.loc[frame["at"].idxmax()]
                if at is None or last["at"] >= pd.Timestamp(at):
                    action, at = last["action"], last["at"].to_pydatetime()
                n += len(frame)
        self.burst.update((action, at, n))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        action, _, n = self.burst.get()
        self.burst.clear()
        yield pd.DataFrame({"path": [key[0]], "action": [action], "n_events": [n]})

    def close(self) -> None:
        pass


def debounce_by_clock(events: DataFrame, quiet_ms: int = 2_000) -> DataFrame:
    """(path, action, n_events) by processing time: an event waits for quiet_ms without another for its path; a new one starts the wait again.

    What waits is kept in the stream's state with its timer, so a restart in between loses nothing. Only a path's last action is held. The session's state store is to be RocksDB, see with_timers.
    """
    return events.groupBy("path").transformWithStateInPandas(Burst(quiet_ms), "path string, action string, n_events bigint", "append", "processingTime")


def with_timers(spark: SparkSession) -> None:
    """Gives the session the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def apply_changes(stored: DataFrame, changes: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored chunks after changes(path, action, content): chunks of all changed paths go, those of updated ones with a content come from chunker."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("action", "content"), "at").alias("c")).select("path", "c.*")
    fresh = chunker(last.where("action = 'update' and content is not null").select("path", "content"))
    return stored.join(last.select(F.col("path").alias("file_path")), "file_path", "left_anti").unionByName(fresh.select(*stored.columns))


def commit_batch(batch: DataFrame, number: int, log: Log, chunker: Callable[[DataFrame], DataFrame], stream: str = "files", compact_at: int = MANY) -> None:
    """Commits one batch of (path, at, action, content) to the log's chunks and postings: the changed files' own chunks and the keys of what goes."""
    last = checkpointed(batch.groupBy("path").agg(F.max_by(F.struct("action", "content"), "at").alias("c")).select("path", "c.*"))
    if last.isEmpty():
        return
    fresh = checkpointed(chunker(last.where("action = 'update' and content is not null").select("path", "content")))
    paths, state = last.select(F.col("path").alias("file_path")), log.state()
    gone = checkpointed(log.table("chunks", state).join(paths, "file_path", "left_semi").select("id", "content")) if state and "chunks" in state.tables else None
    log.commit({"chunks": Change(fresh, paths, "file_path"), **postings.changes(fresh, gone)}, stream=stream, batch=number)
    if len(log.state().tables["chunks"]) >= compact_at:
        log.compact("chunks")


def keep_live(events: DataFrame, log: Log, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, stream: str = "files", compact_at: int = MANY):
    """Starts a query that commits each batch of changes to the log.

    What a batch writes grows with its files, not with the table; readers keep the commit they opened. A batch that runs again is known by its number and
    passed over. From compact_at segments on the chunks are merged into one.
    """
    each = lambda batch, number: commit_batch(batch, number, log, chunker, stream, compact_at)
    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
