"""A stored vector index: cells around trained centres, vectors kept in blocks by cell, cells pruned by number or by bound, scores exact.

Tables of the log: cells(cell, ids, vectors), in folders by cell, a block a row; centres(cell, centre, radius, n), one row a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.store import Change, Log, State

from .lineage import checkpointed
from .ranking import top

#: Cells at most, vectors that the first centres are chosen among, and rounds of training; together they bound what the driver and tasks hold.
MAX_CELLS, FIT_ROWS, ROUNDS = 4_096, 65_536, 4
#: Vectors of a block, queries that are joined with a block at a time, cells that an exact search looks into before it prunes.
BLOCK, TILE, FIRST = 1_024, 256, 4
#: Allowance for rounding in a bound.
SLACK = 1e-5


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centres, centres)[None] - 2 * rows @ centres.T).argmin(axis=1)


def _sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vector) to one row a cell and task: how many vectors it has and the sum of each component."""
    n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
    for batch in batches:
        rows = _matrix(batch.column(0), centres.shape[1])
        own = _nearest(rows, centres)
        n += np.bincount(own, minlength=len(centres))
        np.add.at(total, own, rows)
    at = np.flatnonzero(n)
    offsets = pa.array(np.arange(len(at) + 1) * centres.shape[1], pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.ListArray.from_arrays(offsets, pa.array(total[at].ravel()))], names=["cell", "n", "total"])


def train(vectors: DataFrame, n_cells: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of cells for vectors(id, vector): about the square root of their number.

    The first are the vectors with the least hashes, among different ones. In each round all vectors go to their nearest centre where they are; a
    task gives one row of sums a cell, and the new centres, which the driver holds, are their means. An empty cell keeps its centre.
    """
    clean = vectors.where("vector is not null").select("id", "vector")
    n = clean.count()
    wanted = n_cells or max(1, min(MAX_CELLS, int(n**0.5)))
    first = clean.orderBy(F.xxhash64("id"), "id").limit(min(FIT_ROWS, wanted * 16)).select("vector").toArrow().column(0)
    if not n:
        return np.zeros((0, 0))
    width = len(first[0])
    sample = np.unique(_matrix(first.combine_chunks(), width), axis=0)
    centres = sample[np.linspace(0, len(sample) - 1, min(wanted, len(sample))).astype(int)]
    for _ in range(rounds):
        parts = clean.select("vector").mapInArrow(partial(_sums, centres=centres), "cell int, n bigint, total array<double>")
        added = parts.select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        means = added.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))), lambda s: s["x"]).alias("centre")).collect()  # one row a cell
        for r in means:
            centres[r.cell] = r.centre
    return centres


def _placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, vector) with its cell and its distance from the centre."""
    for batch in batches:
        rows = _matrix(batch.column(1), centres.shape[1])
        own = _nearest(rows, centres)
        away = np.linalg.norm(rows - centres[own], axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(away)], names=["id", "vector", "cell", "away"])


def changes(vectors: DataFrame, centres: np.ndarray) -> dict[str, Change]:
    """What stores vectors(id, vector) in a log: blocks of a cell's vectors, dealt by hash where a cell has many, and the cells."""
    kind = vectors.schema["vector"].dataType.simpleString()
    clean = vectors.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    placed = checkpointed(clean.mapInArrow(partial(_placed, centres=centres), f"id bigint, vector {kind}, cell int, away double"))
    cells = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    table = vectors.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>").join(cells, "cell")
    slices = table.select("cell", F.ceil(F.col("n") / BLOCK).alias("slices"))
    dealt = placed.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))  # MAX_CELLS rows
    blocks = dealt.groupBy("cell", "slice").agg(F.collect_list(F.struct("id", "vector")).alias("r")).select("cell", F.col("r.id").alias("ids"), F.flatten("r.vector").alias("vectors"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return {"cells": Change(blocks.repartition(n, "cell")), "centres": Change(table)}


def _asks(batches: Iterator[pa.RecordBatch], cells: list[int], centres: np.ndarray, radius: np.ndarray, since: int, until: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vector, floor) to a row for each cell whose bound is among the query's highest, from since to until, and reaches its floor."""
    for batch in batches:
        rows = _matrix(batch.column(1), centres.shape[1])
        bound = rows @ centres.T + np.linalg.norm(rows, axis=1)[:, None] * radius[None]
        near = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, since:until]
        floor = batch.column(2).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(rows)), near.shape[1])
        cell = near.ravel()
        kept = bound[row, cell] + SLACK >= floor[row]
        row, cell = row[kept], cell[kept]
        got = batch.take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(cells)[cell], pa.int32()), got.column(0), got.column(1)], names=["cell", "query_id", "vector"])


def _scored(batches: Iterator[pa.RecordBatch], width: int, top_n: int) -> Iterator[pa.RecordBatch]:
    """(query_ids, queries, ids, vectors) to the top_n of each query in each block."""
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            asked, own = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (0, 2))
            queries, rows = (np.asarray(batch.column(c)[i].values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, width) for c in (1, 3))
            scores = np.round(queries @ rows.T, 6)
            order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :top_n]
            out.append((np.repeat(asked, order.shape[1]), own[order].ravel(), np.take_along_axis(scores, order, 1).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])


class VectorIndex:
    """The vectors of a log's cells at a commit."""

    def __init__(self, log: Log, state: State | None = None):
        self.log, self.state = log, state or log.state()
        rows = log.table("centres", self.state).orderBy("cell").collect()  # one row a cell
        self.cells = [r.cell for r in rows]
        self.centres, self.radius = np.array([r.centre for r in rows]), np.array([r.radius for r in rows])

    def blocks(self, cells: list[int] | None = None) -> DataFrame:
        """The blocks of some cells; Spark reads those cells' folders only."""
        rows = self.log.table("cells", self.state)
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def flat(self) -> DataFrame:
        """(id, vector) of all vectors."""
        width = self.centres.shape[1]
        each = self.blocks().select("vectors", F.posexplode("ids").alias("i", "id"))
        return each.select("id", F.slice("vectors", F.col("i") * width + 1, width).alias("vector"))

    def _look(self, asked: DataFrame, since: int, until: int, top_n: int) -> DataFrame:
        pairs = checkpointed(asked.select("query_id", "vector", "floor").mapInArrow(partial(_asks, cells=self.cells, centres=self.centres, radius=self.radius, since=since, until=until), "cell int, query_id bigint, vector array<double>"))
        wanted = [r.cell for r in pairs.select("cell").distinct().collect()]  # MAX_CELLS at most
        self.read = self.read | set(wanted)
        tiles = pairs.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(max(1, asked.count() // TILE))).alias("tile"))
        packed = tiles.agg(F.collect_list(F.struct("query_id", "vector")).alias("q")).select("cell", F.col("q.query_id").alias("query_ids"), F.flatten("q.vector").alias("queries"))
        met = packed.join(self.blocks(wanted), "cell").select("query_ids", "queries", "ids", "vectors")
        return met.mapInArrow(partial(_scored, width=self.centres.shape[1], top_n=top_n), "query_id bigint, id bigint, score double")

    def search(self, queries: DataFrame, top_n: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) of queries(query_id, vector), scores as ranking.dense has them.

        With probes, the hits among the so many cells with the nearest centres. Without, exact: after the FIRST nearest cells, a query looks into every cell
        whose bound, qc + |q| r, reaches its top_n-th score so far. self.read has the cells that were read.
        """
        self.read: set[int] = set()
        asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(float("-inf")).alias("floor"))
        if not self.cells:
            return asked.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        asked = checkpointed(asked)
        first = checkpointed(top(self._look(asked, 0, probes or FIRST, top_n), top_n))
        if probes:
            return first.select("query_id", "id", "score", "rank")
        floors = first.where(F.col("rank") == top_n).select("query_id", F.col("score").alias("least"))
        again = checkpointed(asked.join(floors, "query_id", "left").select("query_id", "vector", F.coalesce("least", "floor").alias("floor")))
        rest = self._look(again, FIRST, len(self.cells), top_n)
        return top(first.select("query_id", "id", "score").unionByName(rest), top_n).select("query_id", "id", "score", "rank")

    def calibrate(self, queries: DataFrame, recall: float = 0.95, top_n: int = 10) -> int:
        """The fewest probes, to an eighth of the cells, with which these queries, a sample of some hundreds, find so many of their exact hits."""
        exact = checkpointed(self.search(queries, top_n).select("query_id", "id"))
        total = exact.count()
        for eighth in range(1, 8):
            probes = -(-len(self.cells) * eighth // 8)
            if self.search(queries, top_n, probes).join(exact, ["query_id", "id"], "left_semi").count() >= recall * total:
                return probes
        return len(self.cells)


def store(log: Log, vectors: DataFrame, n_cells: int | None = None) -> VectorIndex:
    """Trains centres, stores all vectors in the place of what the log has, and opens the index."""
    log.commit(changes(vectors, train(vectors, n_cells)), since=log.state())
    return VectorIndex(log)
