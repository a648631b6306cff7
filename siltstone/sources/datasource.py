"""`USING siltstone`: the tables of a stored index as a data source, for catalogs and other people's SQL.

Options: index, the folder; table, chunks by default; number, a commit. The newest commit is looked up when a query is planned. Comparisons of a
column with a constant are pushed: they choose row groups and rows where the files are read. Reads go through pyarrow, so the index is to lie in a
store that pyarrow opens; Log.table reads the same with Spark's own reader.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.types import StructType

#: What each pushed filter is to pyarrow.
PUSHED = {
    api.EqualTo: lambda c, v: c == v,
    api.GreaterThan: lambda c, v: c > v,
    api.GreaterThanOrEqual: lambda c, v: c >= v,
    api.LessThan: lambda c, v: c < v,
    api.LessThanOrEqual: lambda c, v: c <= v,
    api.In: lambda c, v: c.isin(list(v)),
    api.StringStartsWith: lambda c, v: pc.starts_with(c, v),
    api.StringContains: lambda c, v: pc.match_substring(c, v),
}


@dataclass
class File(api.InputPartition):
    path: str
    seq: int


def _opened(index: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(index) if "://" in index or index.startswith("file:") else (fs.LocalFileSystem(), index)


def _state(index: str, number: int | None) -> dict:
    store, root = _opened(index)
    found = store.get_file_info(fs.FileSelector(f"{root}/commits"))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".json") and (number is None or int(f.base_name[:-5]) == number))
    if not names:
        raise FileNotFoundError(f"no index in {index}")
    with store.open_input_stream(f"{root}/commits/{names[-1]}") as f:
        return json.loads(f.read())


class IndexReader(api.DataSourceReader):
    def __init__(self, index: str, table: str, state: dict, schema: StructType):
        self.index, self.table, self.schema = index, table, schema
        self.segments, self.key = state["tables"][table], state["keys"].get(table)
        self.filters: list[api.Filter] = []

    def pushFilters(self, filters: list[api.Filter]) -> Iterator[api.Filter]:
        """Takes comparisons of whole columns; Spark does what is handed back."""
        for f in filters:
            plain = type(f) in PUSHED and len(f.attribute) == 1
            if plain:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        """One a file of the table's segments."""
        store, root = _opened(self.index)
        out = []
        for s in self.segments:
            if not s["gone"]:
                found = store.get_file_info(fs.FileSelector(f"{root}/data/{self.table}/seg={s['id']}", recursive=True))
                out += [File(f.path, s["seq"]) for f in found if f.base_name.endswith(".parquet")]
        return out or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, root = _opened(self.index)
        gone = [f"{root}/data/{self.table}/seg={s['id']}" for s in self.segments if s["gone"] and s["seq"] > partition.seq]
        where = None
        for f in self.filters:
            one = PUSHED[type(f)](pc.field(f.attribute[0]), f.value)
            where = one if where is None else where & one
        if gone:
            lost = pa.concat_tables([ds.dataset(g, filesystem=store, format="parquet").to_table(columns=[self.key]) for g in gone]).column(0)
            kept = ~pc.field(self.key).isin(lost.combine_chunks())
            where = kept if where is None else where & kept
        data = ds.dataset(partition.path, filesystem=store, format="parquet")
        yield from data.to_batches(columns=self.schema.names, filter=where)


class IndexSource(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone"

    def _read(self) -> tuple[str, dict]:
        if "index" not in self.options:
            raise ValueError("the option index names the folder of the index")
        number = self.options.get("number")
        return self.options.get("table", "chunks"), _state(self.options["index"], int(number) if number else None)

    def schema(self) -> StructType:
        table, state = self._read()
        if table not in state["tables"]:
            raise ValueError(f"no table {table}: one of {', '.join(sorted(state['tables']))}")
        return StructType.fromJson(state["schemas"][table])

    def reader(self, schema: StructType) -> IndexReader:
        table, state = self._read()
        return IndexReader(self.options["index"], table, state, schema)


def register(spark: SparkSession) -> None:
    """Makes the format siltstone known to a session, with push-down of filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexSource)
