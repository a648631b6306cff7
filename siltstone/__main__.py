"""python -m siltstone: build an index of a folder, search it, ask its graph."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import chunking, graph, postings, upkeep
from siltstone.operators.lineage import checkpointed
from siltstone.plans.engine import OPERATIONS, Engine
from siltstone.sources import files, store


#: Times that a build begins anew because another one came between.
ATTEMPTS = 5


def needs_update(spark: SparkSession, root: str, index: str, extensions: list[str], ignored: list[str]) -> bool:
    """Whether a build would write anything."""
    _, state, _, status = _difference(spark, root, index, extensions, ignored)
    return state is None or state.settings != _settings(root, extensions) or status.limit(1).count() > 0


def _settings(root: str, extensions: list[str]) -> dict[str, str]:
    return {"path": root, "extensions": ",".join(extensions)}


def _difference(spark: SparkSession, root: str, index: str, extensions: list[str], ignored: list[str]) -> tuple:
    log = store.Log(spark, index)
    state = log.state()
    found = files.read_files(spark, root, extensions, ignored)
    known = log.table("file_state", state) if state and state.tables else found.select("path", "sha256").limit(0)
    return log, state, found, checkpointed(upkeep.partition_files(found, known).where("status <> 'unchanged'"))


def build(spark: SparkSession, root: str, index: str, extensions: list[str], ignored: list[str], force: bool = False) -> int:
    """Brings the index of a folder in step with it; the number of the commit, that of the one before if nothing changed.

    Only changed and added files are chunked and parsed, and only what they give is written, with the keys of what goes: chunks and facts by file,
    postings by chunk. The graph is put together anew from all files' facts by joins. A build that another one overtakes begins
    again from the other's commit, so both count. force: everything is made anew in the place of what is there.
    """
    for _ in range(ATTEMPTS):
        try:
            return _build(spark, root, index, extensions, ignored, force)
        except store.Conflict:
            continue
    raise store.Conflict(f"{index} changes faster than it can be built")


def _build(spark: SparkSession, root: str, index: str, extensions: list[str], ignored: list[str], force: bool) -> int:
    log, state, found, status = _difference(spark, root, index, extensions, ignored)
    settings = _settings(root, extensions)
    if state and state.tables and not force and state.settings == settings and not status.limit(1).count():
        return state.number
    if not state or not state.tables or force:
        fresh = found.select("path", "content")
        chunks, facts = checkpointed(chunking.chunk_files(fresh).withColumn("source", F.lit("files"))), checkpointed(chunking.extract_facts(fresh))
        rows = {"chunks": chunks, "facts": facts, "file_state": found.select("path", "sha256"), **_graph(facts)} | {t: c.rows for t, c in postings.changes(chunks).items()}
        return log.commit({t: store.Change(df) for t, df in rows.items()}, settings, state).number
    touched = status.select("path")
    fresh = found.select("path", "content").join(status.where("status <> 'removed'").select("path"), "path", "left_semi")
    chunks, facts = checkpointed(chunking.chunk_files(fresh).withColumn("source", F.lit("files"))), checkpointed(chunking.extract_facts(fresh))
    gone = checkpointed(log.table("chunks", state).join(touched.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id", "content"))
    all_facts = log.table("facts", state).join(touched.select(F.col("path").alias("file")), "file", "left_anti").unionByName(facts)
    changes = {
        "chunks": store.Change(chunks, touched.select(F.col("path").alias("file_path")), "file_path"),
        "facts": store.Change(facts, touched.select(F.col("path").alias("file")), "file"),
        "file_state": store.Change(found.select("path", "sha256").join(touched, "path", "left_semi"), touched, "path"),
        **postings.changes(chunks, gone),
        **{t: store.Change(df) for t, df in _graph(all_facts).items()},
    }
    return log.commit(changes, settings, state).number


def _graph(facts: DataFrame) -> dict[str, DataFrame]:
    facts = checkpointed(facts)  # files are parsed once for the nodes, the edges and the references
    nodes, edges, calls, bases = chunking.graph_inputs(facts)
    nodes = graph.upsert_nodes(nodes)
    edges, stubs = graph.upsert_edges(edges, nodes)
    nodes = nodes.unionByName(stubs.select(*nodes.columns))
    return {"nodes": nodes, "edges": graph.resolve_all(nodes, edges, calls, bases)}


def main() -> None:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("--index", required=True, help="folder of the index")
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    b.add_argument("root")
    b.add_argument("--ext", nargs="+", default=["py"])
    b.add_argument("--ignore", nargs="*", default=[])
    b.add_argument("--force", action="store_true", help="make everything anew")
    b.add_argument("--check", action="store_true", help="only say whether anything changed")
    sub.add_parser("reset", help="empty the index; older commits stay readable")
    c = sub.add_parser("compact", help="merge the segments of tables that have many")
    c.add_argument("--at-least", type=int, default=store.MANY)
    s = sub.add_parser("search")
    s.add_argument("query", nargs="+")
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--outline", action="store_true")
    g = sub.add_parser("graph")
    g.add_argument("operation", choices=OPERATIONS)
    g.add_argument("symbol")
    g.add_argument("--target", default="")
    sub.add_parser("status")
    a = p.parse_args()
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    if a.what == "build":
        print(needs_update(spark, a.root, a.index, a.ext, a.ignore) if a.check else build(spark, a.root, a.index, a.ext, a.ignore, a.force))
        return
    if a.what in ("reset", "compact"):
        log = store.Log(spark, a.index)
        print(log.reset().number if a.what == "reset" else [log.compact(t, a.at_least).number for t in ("chunks", "facts", "file_state")][-1])
        return
    engine = Engine.open(spark, a.index)
    if a.what == "search":
        hits = engine.search(" ".join(a.query), a.top_k)
        rows = engine.outline_rows(hits) if a.outline else engine.hit_rows(hits)
    elif a.what == "graph":
        rows = engine.graph_query(a.operation, a.symbol, a.target)
    else:
        rows = engine.status()
    for r in files.json_lines(rows).toLocalIterator():
        print(r.value)


if __name__ == "__main__":
    main()
