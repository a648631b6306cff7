"""An index in numbered commits: tables of segments, changed by adding segments and tombstones, found through the newest commit.

root/commits/<number>.json names the segments of every table; root/data/<table>/seg=<id> holds them. A commit's file appears whole and only once, so
two writers can't take the same number, and a reader keeps what its own commit names whatever comes after.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

VERSION = 3
#: Tables that are kept in folders by a column, so that readers can leave most of them unread.
PARTED = {"blocks": ("bucket",), "cells": ("cell",)}
#: Segments of a table from which compact() is worth its writing.
MANY = 20


def _name() -> str:
    return "s" + uuid.uuid4().hex  # never to be taken for a number


class Conflict(RuntimeError):
    """Another commit changed what this one was made from; it is to be made anew."""


@dataclass(frozen=True)
class Segment:
    """Rows of a table, or with gone the keys whose rows in earlier segments no longer count."""

    id: str
    seq: int
    gone: bool = False


@dataclass(frozen=True)
class State:
    number: int
    tables: dict[str, list[Segment]] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)
    version: int = VERSION
    at: str = ""


@dataclass(frozen=True)
class Change:
    """What happens to a table: rows come in, and the rows of earlier segments whose key is in gone go. The empty key only adds; without a key (None) the rows take the place of all."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    key: str | None = None


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ---- commits ----

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def state(self, number: int | None = None) -> State | None:
        """The newest commit, or that of a number; None if there is none of this version, which asks for a full build."""
        numbers = [number] if number is not None else self.numbers()[-1:]
        if not numbers:
            return None
        stream = self._fs.open(self._path(self._file(numbers[0])))
        try:
            raw = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if raw.get("version") != VERSION:
            return None
        raw["tables"] = {t: [Segment(**s) for s in segments] for t, segments in raw["tables"].items()}
        return State(**raw)

    def _file(self, number: int) -> str:
        return f"{self.root}/commits/{number:020d}.json"

    def _put(self, state: State) -> bool:
        """Writes a commit; False if its number is taken. The file is written aside and gets its name in one step that fails if the name exists."""
        jvm = self.spark.sparkContext._jvm
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside), True)
        out.write(bytearray(json.dumps(asdict(state)).encode()))
        out.close()
        final = self._path(self._file(state.number))
        self._fs.mkdirs(final.getParent())
        local = self._fs.makeQualified(final).toUri()
        if local.getScheme() == "file":  # its rename would overwrite
            try:
                os.link(urlparse(self._fs.makeQualified(self._path(aside)).toUri().toString()).path, local.getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(self._path(aside), False)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf).rename(self._path(aside), final, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs.delete(self._path(aside), False)
            return False

    # ---- reading ----

    def table(self, name: str, state: State | None = None) -> DataFrame:
        """The rows of a table at a commit, the newest by default: one scan of all its segments, without the rows that a later tombstone names."""
        state = state or self.state()
        if state is None or name not in state.tables:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        rows, gone = self.segments(name, state)
        kept = rows if gone is None else self.without(rows, gone, state.keys[name])
        return kept.drop("__seq")

    def segments(self, name: str, state: State | None = None) -> tuple[DataFrame, DataFrame | None]:
        """All rows of a table's segments in one scan, with __seq, the commit that they came with; and the keys that are gone with __until, the commit that took them, if any."""
        state = state or self.state()
        kept, gone = [s for s in state.tables[name] if not s.gone], [s for s in state.tables[name] if s.gone]
        kind = StructType.fromJson(state.schemas[name])
        if not kept:
            return self.spark.createDataFrame([], StructType([*kind.fields, StructField("__seq", IntegerType())])), None
        with_segment = StructType([*kind.fields, StructField("seg", StringType())])
        rows = self.spark.read.schema(with_segment).option("basePath", self._table(name)).parquet(*[self._segment(name, s) for s in kept]).withColumn("__seq", _seq(kept)).select(*kind.names, "__seq")
        if not gone:
            return rows, None
        key = state.keys[name]
        names = self.spark.read.option("basePath", self._table(name)).parquet(*[self._segment(name, s) for s in gone])
        return rows, names.groupBy(key).agg(F.max(_seq(gone)).alias("__until"))

    @staticmethod
    def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
        """rows, which have key and __seq, without those that a later commit took."""
        last = gone.withColumnRenamed(key, "__gone")
        merged = rows.join(last, F.col(key).eqNullSafe(F.col("__gone")), "left")
        return merged.where(F.col("__until").isNull() | (F.col("__seq") >= F.col("__until"))).drop("__gone", "__until")

    def _table(self, name: str) -> str:
        return f"{self.root}/data/{name}"

    def _segment(self, name: str, segment: Segment) -> str:
        return f"{self._table(name)}/seg={segment.id}"

    # ---- writing ----

    def commit(self, changes: dict[str, Change], settings: dict[str, str] | None = None, since: State | None = None, stream: str = "", batch: int | None = None) -> State:
        """Writes the changes' files, then the commit; the state after it.

        Changes by key go on top of whatever is newest: of two that touch one key the later commit counts. A change without a key was made from
        all of its table, so if that has changed since the given state (None: since nothing), Conflict is raised and nothing of it shows. A batch of a
        stream that is in the log already is passed over, so that a batch run again after a failure does nothing.
        """
        newest = self.state()
        if batch is not None and newest and newest.applied.get(stream, -1) >= batch:
            return newest
        written = {name: self._write(name, c) for name, c in changes.items()}

        def edit(now: State) -> State:
            tables, keys, schemas = dict(now.tables), dict(now.keys), dict(now.schemas)
            for name, c in changes.items():
                if c.key is None and (since.tables.get(name) if since else None) != now.tables.get(name):
                    raise Conflict(f"{name} has changed since")
                own = [replace(s, seq=now.number + 1) for s in written[name]]
                tables[name] = (tables.get(name, []) if c.key is not None else []) + own
                if c.key:
                    keys[name] = c.key
                if c.rows is not None:
                    schemas[name] = json.loads(c.rows.schema.json())
            applied = now.applied | ({stream: batch} if batch is not None else {})
            return replace(now, tables=tables, keys=keys, schemas=schemas, applied=applied, settings=now.settings if settings is None else settings)

        return self._edit(edit, stream, batch)

    def _edit(self, edit, stream: str = "", batch: int | None = None) -> State:
        while True:
            now = self.state() or State((self.numbers() or [0])[-1])
            if batch is not None and now.applied.get(stream, -1) >= batch:
                return now
            after = replace(edit(now), number=now.number + 1, version=VERSION, at=datetime.now(timezone.utc).isoformat())
            if self._put(after):
                return after

    def _write(self, name: str, change: Change) -> list[Segment]:
        out = []
        if change.gone is not None:
            out.append(Segment(_name(), 0, True))
            change.gone.select(change.key).distinct().write.parquet(self._segment(name, out[-1]))
        if change.rows is not None:
            out.append(Segment(_name(), 0))
            parted = [c for c in PARTED.get(name, ()) if c in change.rows.columns]
            change.rows.write.partitionBy(*parted).parquet(self._segment(name, out[-1]))
        return out

    def compact(self, name: str, at_least: int = 2) -> State:
        """One segment in the place of all that a table has now, if those are at_least; segments of commits made meanwhile stay on top of it."""
        state = self.state()
        old = state.tables[name]
        if len(old) < at_least:
            return state
        new = Segment(_name(), max(s.seq for s in old))
        rows = self.table(name, state)
        rows.write.partitionBy(*[c for c in PARTED.get(name, ()) if c in rows.columns]).parquet(self._segment(name, new))

        def edit(now: State) -> State:
            if now.tables.get(name, [])[: len(old)] != old:
                raise Conflict(f"{name} has changed since")
            return replace(now, tables=now.tables | {name: [new, *now.tables[name][len(old) :]]})

        return self._edit(edit)

    def reset(self) -> State:
        """A commit without tables; older ones can still be read by number."""
        return self._edit(lambda now: State(now.number))

    def clean(self, keep: int = 2) -> int:
        """Removes segments that none of the newest keep commits names, and the older commits; how many segments went. Readers of those lose them."""
        numbers = self.numbers()
        named = {(t, s.id) for n in numbers[-keep:] for t, ss in (self.state(n) or State(n)).tables.items() for s in ss}
        gone = [(t, s.id) for n in numbers[:-keep] for t, ss in (self.state(n) or State(n)).tables.items() for s in ss if (t, s.id) not in named]
        for t, i in set(gone):
            self._fs.delete(self._path(f"{self._table(t)}/seg={i}"), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(self._file(n)), False)
        return len(set(gone))


def _seq(segments: list[Segment]) -> Column:
    """The number of the commit that a row's segment came with."""
    return F.element_at(F.create_map(*[F.lit(x) for s in segments for x in (s.id, s.seq)]), F.col("seg").cast("string"))


def current(spark: SparkSession, root: str) -> State | None:
    return Log(spark, root).state()


def read_tables(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a commit, the newest by default; blocks of postings, which aren't keyed by row, are read through PostingIndex."""
    log = Log(spark, root)
    state = log.state(number)
    if state is None:
        raise FileNotFoundError(f"no index in {root}")
    return {t: log.table(t, state) for t in state.tables if t not in PARTED}


def settings_table(spark: SparkSession, settings: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(settings.items()), "setting string, value string")
