"""A Merkle manifest of a dataset: one tree of digests a group, one tree over the groups, proofs for every row.

A tree's nodes have (g, level, idx, digest): g the group's key, level 0 the leaves, idx the place within the level. A node's
children are the fan-out places that its index stands for; the last node of a level has fewer. Nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, parts

FAN_OUT = 8
#: Leaves of one indexed partition, about; there are as many partitions as tasks at least.
PART_ROWS = 50_000


def field(value: Column) -> Column:
    """A value as it goes into a leaf: `-` if null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def level_sizes(n: int, fan_out: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, up to its one root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fan_out))
    return sizes


def inner_nodes(start: int, leaves: list[str], n: int, fan_out: int) -> dict[tuple[int, int], str]:
    """Of a tree of n leaves, all nodes (level, idx) whose leaves are among those from start on, the leaves with them.

    The mountain range: leaves come in turn, and each level keeps the nodes of the run that it is in. A full run carries its
    digest to the level above; a run that began before start never fills. At the tree's end the last, shorter runs close too.
    """
    tops = level_sizes(n, fan_out)
    found: dict[tuple[int, int], str] = {}
    stacks: list[list[str]] = [[] for _ in tops]

    def put(level: int, idx: int, digest: str) -> None:
        while True:
            found[level, idx] = digest
            if level + 1 == len(tops):
                return
            run = stacks[level]
            if idx % fan_out == 0:
                run.clear()
            run.append(digest)
            wanted = min(fan_out, tops[level] - idx // fan_out * fan_out)
            if idx % fan_out + 1 < wanted or len(run) < wanted:
                return
            level, idx, digest = level + 1, idx // fan_out, joined(run)

    for i, leaf in enumerate(leaves):
        put(0, start + i, leaf)
    return found


def outside(start: int, rows: int, n: int, fan_out: int) -> list[tuple[int, int]]:
    """The nodes that share a run with one of rows leaves from start, or with a node above one, and aren't whole within them."""
    out = []
    low, high, first, end = start, start + rows, start, start + rows  # of a level: nodes whole within the span, nodes above some of it
    for level, size in enumerate(level_sizes(n, fan_out)[:-1]):
        run = range(first // fan_out * fan_out, min(size, ((end - 1) // fan_out + 1) * fan_out))
        out += [(level, i) for i in run if not low <= i < high]
        low, high = -(-low // fan_out), -(-high // fan_out) if high == size else high // fan_out
        first, end = first // fan_out, (end - 1) // fan_out + 1
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf gives with the digests on its left and right, level by level."""
    for before, after in path:
        leaf = sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def paths_of(start: int, leaves: list[str], n: int, around: dict[tuple[int, int], str], fan_out: int) -> list[list[tuple[str, str]]]:
    """For each leaf, level by level, what its run has on the left and on the right of it; around holds the nodes of outside()."""
    found = inner_nodes(start, leaves, n, fan_out) | around
    sizes = level_sizes(n, fan_out)[:-1]

    def step(level: int, idx: int) -> tuple[str, str]:
        first = idx // fan_out * fan_out
        after = range(idx + 1, min(sizes[level], first + fan_out))
        return "".join(found[level, i] for i in range(first, idx)), "".join(found[level, i] for i in after)

    out, run, upper = [], None, []
    for idx in range(start, start + len(leaves)):
        if run != idx // fan_out:
            run, upper = idx // fan_out, [step(level, idx // fan_out**level) for level in range(1, len(sizes))]
        out.append([step(0, idx), *upper] if sizes else [])
    return out


# ---- a forest over a table ------------------------------------------------------------------------------------------

_NODES = "g string, level int, idx bigint, digest string, peak boolean"
_PATH = "array<struct<before: string, after: string>>"


@dataclass
class Forest:
    """leaves(g, part, idx, leaf, ...), indexed; spans(g, part, start, rows, n), one row an indexed partition; nodes(g, level, idx, digest, peak); roots(g, root)."""

    leaves: DataFrame
    spans: DataFrame
    nodes: DataFrame
    roots: DataFrame
    fan_out: int


def _indexed(leaves: DataFrame, order: str, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """leaves(g, leaf, ...) with part and idx, the place in its group by order, then leaf; and the spans.

    Rows are dealt by ranges and sorted where they are; what comes before a range is the sum over its group's ranges, one row each. Rows that agree in
    order and leaf are dealt by their number in the input and change places freely, as their leaves are equal.
    """
    keys = ["g", order, "leaf", "tie"]
    n = leaves.count()
    wanted = max(1, min(parts(leaves.sparkSession), n // 1_000), -(-n // part_rows))
    dealt = durable(leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(wanted, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()).drop("tie"))
    dealt = dealt.withColumn("part", F.shiftright("place", 33).cast("int"))
    spans = dealt.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = durable(spans.withColumns({"start": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("g"))}))
    return dealt, spans


def _starts(context: pa.Table) -> tuple[dict, int, int]:
    """The row of a partition's span, which is its row of level -1, with its start and the leaves of its group."""
    at = pa.compute.index(context.column("level"), -1).as_py()
    row = {c: context.column(c)[at].as_py() for c in context.column_names}
    return row, row["start"], row["n"]


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(rows.column("place").to_numpy(), kind="stable")))


def grow(leaves: DataFrame, order: str, fan_out: int = FAN_OUT, part_rows: int = PART_ROWS) -> Forest:
    """The trees of leaves(g, leaf, order, ...), one a group, their leaves ascending by order.

    Each indexed partition keeps a mountain range and gives its completed nodes. Those whose parent isn't among them are its peaks:
    their runs lie across an edge. Peaks are merged level by level from below; the peaks of a level and what the level before it made
    are whole runs, of fan_out rows at most, and a level has a few for each partition.
    """
    indexed, spans = _indexed(leaves, order, part_rows)

    def nodes_in(rows: pa.Table, span: pa.Table) -> pa.Table:
        row, start, n = _starts(span)
        found = inner_nodes(start, _in_order(rows).column("leaf").to_pylist(), n, fan_out)
        peak = {k: (k[0] + 1, k[1] // fan_out) not in found for k in found}
        keys = [k for k in found if k[0] > 0 or peak[k]]
        columns = [[row["g"]] * len(keys), [k[0] for k in keys], [k[1] for k in keys], [found[k] for k in keys], [peak[k] for k in keys]]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()))], names=["g", "level", "idx", "digest", "peak"])

    both = indexed.select("g", "part", "place", "leaf").groupBy("g", "part").cogroup(spans.select("g", "part", "start", "n", F.lit(-1).alias("level")).groupBy("g", "part"))
    grown = durable(both.applyInArrow(nodes_in, _NODES))
    deepest = len(level_sizes(spans.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0], fan_out)) - 1
    sizes = spans.select("g", "n").distinct()
    peaks, made = grown.where("peak"), []
    for level in range(deepest):
        here = peaks.where(F.col("level") == level).drop("peak")
        here = (here.unionByName(made[-1]) if made else here).join(sizes, "g").where(F.ceil(F.col("n") / fan_out**level) > 1)
        runs = here.groupBy("g", F.floor(F.col("idx") / fan_out).cast("long").alias("above")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        made.append(durable(runs.select("g", F.lit(level + 1).alias("level"), F.col("above").alias("idx"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest"))))
    nodes = reduce(DataFrame.unionByName, [m.withColumn("peak", F.lit(True)) for m in made], grown)
    height = reduce(lambda c, i: F.when(F.col("n") > fan_out**i, i + 1).otherwise(c), range(deepest), F.lit(0))
    roots = durable(nodes.where("peak and idx = 0").join(sizes, "g").where(F.col("level") == height).select("g", F.col("digest").alias("root")))
    return Forest(indexed, spans, nodes, roots, fan_out)


def _around(forest: Forest, upper: DataFrame) -> DataFrame:
    """For each indexed partition a row of level -1 with its span and upper(g, ...), and the digests outside of it that its proofs need, fewer than two runs a level."""
    fan_out = forest.fan_out

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *k) for i, span in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))) for k in outside(*span, fan_out)]
            at, levels, idxs = zip(*found) if found else ((), (), ())
            kept = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(levels, pa.int32()), pa.array(idxs, pa.int64())], names=["g", "part", "level", "idx"])

    needed = forest.spans.select("g", "part", "start", "rows", "n").mapInArrow(asked, "g string, part int, level int, idx bigint")
    digests = needed.join(forest.nodes.where("peak").select("g", "level", "idx", "digest"), ["g", "level", "idx"])
    return forest.spans.select("g", "part", "start", "n", F.lit(-1).alias("level")).join(upper, "g").unionByName(digests, allowMissingColumns=True)


def _proved(forest: Forest, upper: DataFrame, made, schema: str) -> DataFrame:
    """made(rows, span, paths) of each indexed partition: its rows in order, its row of level -1, and a path a row."""
    fan_out = forest.fan_out

    def one(rows: pa.Table, context: pa.Table) -> pa.Table:
        span, start, n = _starts(context)
        rows = _in_order(rows)
        keys = zip(context.column("level").to_pylist(), context.column("idx").to_pylist())
        around = {k: d for k, d in zip(keys, context.column("digest").to_pylist()) if k[0] >= 0}
        return made(rows, span, paths_of(start, rows.column("leaf").to_pylist(), n, around, fan_out))

    return forest.leaves.groupBy("g", "part").cogroup(_around(forest, upper).groupBy("g", "part")).applyInArrow(one, schema)


def whole_root(forest: Forest) -> DataFrame:
    """(g, subroot, root, path): one row a group. The groups' roots, by the bytes of g, are the leaves of one more tree of the same make."""
    above = grow(forest.roots.select(F.lit("").alias("g"), F.col("root").alias("leaf"), F.col("g").alias("name")), "name", forest.fan_out)

    def made(rows: pa.Table, span: dict, paths: list) -> pa.Table:
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        path = pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], kind)
        return pa.table([rows.column("name"), rows.column("leaf"), pa.array([span["root"]] * len(paths), pa.string()), path], names=["g", "subroot", "root", "path"])

    return durable(_proved(above, above.roots, made, f"g string, subroot string, root string, path {_PATH}"))


def merkle_manifest(rows: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", fan_out: int = FAN_OUT, changed: dict[str, Column] | None = None, part_rows: int = PART_ROWS) -> tuple[Forest, DataFrame]:
    """The manifest of a table, and one row for each of its rows: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of the columns' fields (see field). The rows of a group are the leaves of its tree, ascending by identifier; every fan_out
    nodes are the one above, the last of a level fewer. The groups' roots by key, null first, are the leaves of the whole tree. The Forest's nodes are the
    table to keep: with it a row is shown to belong by its own fields and a few digests. proof_sha256 is the digest of the
    siblings from the leaf up, left to right, and folded_root what they give with the leaf made anew: from the values of
    changed, an expression by column, where given and not null, else as it is. verified: whether that is the root.

    Nulls: each field tells null from the empty text; a null group is a group, before all others; null identifiers come first in theirs. Rows with equal
    identifiers are leaves each, in the order of their leaves. Texts of any length are hashed whole by Spark; only digests are exchanged, in
    partitions of about part_rows rows, whatever the groups' sizes. An empty table gives no rows and no nodes. Other columns are not read.
    """
    fields = {c: F.col(c) for c in columns}
    altered = fields | (changed or {})
    group = F.col(group_col).cast("string")
    is_changed = reduce(lambda a, b: a | b, [F.coalesce(~altered[c].eqNullSafe(fields[c]), F.lit(False)) for c in (changed or {})], F.lit(False))
    leaves = durable(
        rows.select(
            F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("g"),
            F.col(id_col).alias("id"),
            leaf_of(*fields.values()).alias("leaf"),
            F.when(is_changed, leaf_of(*altered.values())).alias("other"),
        )
    )
    forest = grow(leaves, "id", fan_out, part_rows)
    discard(leaves)

    def made(rows: pa.Table, span: dict, paths: list) -> pa.Table:
        above = [(s["before"], s["after"]) for s in span["path"]]
        proofs, roots = [], []
        for leaf, other, path in zip(rows.column("leaf").to_pylist(), rows.column("other").to_pylist(), paths):
            proofs.append(joined([part for step in path + above for part in step]))
            roots.append(folded(other or leaf, path + above))
        same = [[span[c]] * len(paths) for c in ("subroot", "root")]
        texts = [pa.array(c, pa.string()) for c in (*same, proofs, roots)]
        return pa.table([rows.column("id"), rows.column("leaf"), *texts, pa.array([r == span["root"] for r in roots], pa.bool_())], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = leaves.schema["id"].dataType.simpleString()
    out = _proved(forest, whole_root(forest), made, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return forest, out.withColumnRenamed("id", id_col)
